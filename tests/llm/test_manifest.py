"""The Merkle manifest against a plain recursive one."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from flowmetrics.llm import merkle  # noqa: E402


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return H.sha("".join(encoded(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes):
    """The root, and each leaf's siblings from below as (left, right)."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
    root, above = tree([H.sha("".join(r)) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1:])), *above[j]] for j, r in enumerate(runs) for k in range(len(r))]


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    per = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
           for x in langs}
    low = {x: tree([leaf(r) for r in per[x]]) for x in langs}
    root, above = tree([low[x][0] for x in langs]) if langs else (None, [])
    out = []
    for x, up in zip(langs, above):
        for r, mine in zip(per[x], low[x][1]):
            path = mine + up
            forged = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                forged["text"] = r["text"].translate(H.LOWER)
            f = leaf(forged)
            for left, right in path:
                f = H.sha(left + f + right)
            out.append((r["doc_id"], leaf(r), low[x][0], root, H.sha("".join(a + b for a, b in path)), f, f == root))
    return out


def same(df):
    def key(t):
        return tuple(map(str, t))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in merkle.manifest(df).select(*cols).collect()), key=key)
    rows = [r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got == sorted(brute(rows), key=key)
    return got


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 300, 513])
def test_positions_address_the_log(n):
    height = next(h for h in range(9) if 8 ** h >= n)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    log = merkle.append_log(leaves, height)
    level = [d.hex() for d in leaves]
    seen = set()
    for h in range(height + 1):
        for i, d in enumerate(level):
            p = merkle.position(n, height, h, i)
            seen.add(p)
            assert log[32 * p:32 * p + 32].hex() == d
        level = [H.sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
    assert seen == set(range(len(log) // 32))


def test_whole_table(spark):
    got = same(H.sample(spark))
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark):
    df = H.odd_documents(spark)
    same(df)
    assert merkle.manifest(df).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_empty_and_single(spark):
    assert merkle.manifest(H.no_documents(spark)).collect() == []
    got = same(spark.createDataFrame([(3, "Text", None, None, None)], H.DOCS))
    assert got[0][1] == got[0][2] == got[0][3]


def test_several_rounds_and_many_languages(spark, monkeypatch):
    """Blocks of 64 leaves: a hot language over several rounds, and more languages than a block."""
    monkeypatch.setattr(merkle, "SPAN", 64)
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "FEW_PARTS", 0)
    monkeypatch.setattr(merkle, "FEW_PATHS", 0)
    rows = [(i, f"Text {i}", "hot", "s", i) for i in range(4200)]
    rows += [(10_000 + i, f"Other {i}", f"l{i % 150}é" if i % 150 else None, "s", None) for i in range(400)]
    rows += [(7, "Repeated", "hot", "s", 7)] * 500
    same(spark.createDataFrame(rows, H.DOCS).repartition(7))


def test_forgery_is_found(spark):
    rows = [r.asDict() for r in H.sample(spark).collect()]
    changed = {r["doc_id"] for r in rows if r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
               and r["text"] != r["text"].translate(H.LOWER)}
    got = {r["doc_id"] for r in merkle.manifest(H.sample(spark)).filter("NOT verified").collect()}
    assert got == changed and changed
