"""Personal data and decontamination against plain Python."""

import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from flowmetrics.llm import decontaminate, pii  # noqa: E402

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) \
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) \
                    or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


TRICKY = [
    "a@b.c_d@e.f x@y x@y..z é a.b%c+d-e@q-r.s.t", "1.2.3.4.5.6.7.8 256.1.1.1 00.1.02.255 1.2.3", "4111 1111-1111 1111",
    "41111111111111111111111 4111111111111111 12", "+1 (269) 555-3296 4524132264652876", "+12345678 +1-2-3-4-5-6-7-8-9-0 +",
    "😀 mail a@b.cc 😀 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "", None, "@.@.@", "5" * 3000, "1 " * 3000,
    "+1" + "(" * 2000, "a" * 5000 + "@", "x@a.b" * 40, "name (at) host dot com and 1/2/3 4.5",
]


def test_base_spans_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = base_spans(TRICKY[r.doc_id])
        assert r.base_sha256 == H.sha(listed(want)), TRICKY[r.doc_id][:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_of_the_corpus(spark):
    texts = {r.doc_id: r.text for r in H.sample(spark).collect()}
    for r in pii.find(H.sample(spark)).collect():
        assert r.base_sha256 == H.sha(listed(base_spans(texts[r.doc_id])))


def test_pii_odd_rows_and_empty_table(spark):
    assert pii.find(H.odd_documents(spark)).count() == len(H.odd_rows())
    assert pii.find(H.no_documents(spark)).count() == 0


def test_redaction_replaces_spans_and_keeps_the_rest(spark):
    rows = [(1, "mail a@b.cc or +1 (269) 555-3296, 😀 10.0.0.1."), (2, "clean"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[1] == "mail <EMAIL> or <PHONE>, 😀 <IP>."
    assert got[2] == "clean" and got[3] is None
    odd = H.odd_documents(spark)
    assert pii.redact(odd).columns == odd.columns


def test_spans_that_the_base_patterns_run_over_are_added(spark):
    rows = [(i, f"text +1 (2{i % 90 + 10}) 555-{3000 + i} text") for i in range(40)] + \
        [(100 + i, "number 4111111111111111 here") for i in range(40)] + \
        [(200, "text +1 (269) 555-3296 4111111111111111 text"), (201, "the year 2024 and 555 people, 12-34"),
         (202, "order 555-3296 1234567890123")] + [(300 + i, f"call 269 555 {3000 + i} now") for i in range(20)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200].n_phone == got[200].n_card == 0
    assert got[200].spans == "phone:5:22,card:23:39"
    assert got[201].spans == got[202].spans == got[301].spans == ""


def test_evident_spans_are_found_at_any_share_of_the_corpus(spark):
    base = [(i, f"text a{i}@b.cc text") for i in range(5)]
    loose = {"write john{i} [at] site dot com today": "email", "the fax (269) 555-3{i} today": "phone",
             "call 269-555-3{i} now": "phone", "number 4111/1111/1111/1111 here {i}": "card", "see 10[.]0[.]0[.]1 x{i}": "ip"}
    plain = [(9000 + i, f"counted 269 555 3{100 + i} items") for i in range(200)]
    for n in (1, 200):
        rows = [(1000 * (j + 1) + i, t.format(i=100 + i)) for j, t in enumerate(loose) for i in range(n)]
        docs = spark.createDataFrame(base + rows + plain, "doc_id long, text string")
        got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
        for j, kind in enumerate(loose.values()):
            for i in range(n):
                assert got[1000 * (j + 1) + i].startswith(kind + ":"), (n, kind, i)
        assert all(got[i] == "" for i, _ in plain)
    alone = pii.find(spark.createDataFrame([(1, "the fax (269) 555-3296 today")], "doc_id long, text string")).first()
    assert alone.spans == "phone:8:22" and alone.n_phone == 0


def test_a_dropped_span_drops_no_other(spark):
    rows = [([(1.0, 8, 2, 12), (3.0, 0, 0, 5), (2.0, 4, 1, 9)],), ([],), ([(1.0, 0, 1, 4), (1.0, 2, 0, 6)],)]
    df = spark.createDataFrame(rows, "x array<struct<z:double,s:int,k:int,e:int>>")
    got = [[tuple(c) for c in r.y] for r in df.select(pii.chosen(df["x"]).alias("y")).collect()]
    assert got == [[(0, 0, 5), (8, 2, 12)], [], [(0, 1, 4)]]


def test_boosting_learns_the_table():
    counts = [(3, f, 90, 1) for f in range(4)] + [(3, 4096 + f, 1, 90) for f in range(4)]
    trees, cut = pii.fit(counts)
    high = sum(pii._tree_value(t, pii._unpack(0, 3)) for t in trees)
    low = sum(pii._tree_value(t, pii._unpack(4096, 3)) for t in trees)
    assert high >= cut > low
    assert pii.fit([]) is None and pii.fit([(0, 1, 5, 0)]) is None


def contamination(docs, items, n=10):
    grams = defaultdict(set)
    for item, text in items:
        w = H.words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[i:i + k])].add(item)
    sizes = {len(g) for g in grams}
    for doc, text in docs:
        w, hit, found = H.words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                g = tuple(w[i:i + k])
                if g in grams:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        yield doc, len(w), len(hit), len(found), H.sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_contamination_equals_plain_python(spark, bound):
    docs = [(i, r[1]) for i, r in enumerate(H.odd_rows())] + [(20, "x Alpha, beta! y alpha beta"), (21, "Ünï word1 word2")]
    items = [(1, " ".join(f"word{i}" for i in range(20, 45))), (2, "alpha beta"), (3, None), (4, ""), (10, "ünï"), (None, "word1"),
             (5, " ".join(f"w{i}" for i in range(300, 312))), (2, "alpha beta")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, broadcast_windows=bound).collect()
    assert sorted(map(tuple, got)) == sorted(contamination(docs, items))


def test_contamination_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    odd = H.odd_documents(spark)
    got = decontaminate.contamination(odd, none)
    assert got.count() == len(H.odd_rows()) and not got.filter("contaminated").count()
    assert decontaminate.contamination(H.no_documents(spark), H.sample(spark, "benchmark")).count() == 0
    one = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = decontaminate.clean(odd, one)
    assert kept.columns == odd.columns and kept.count() == len(H.odd_rows()) - 1


@pytest.mark.parametrize("bound", [0, 500_000])
def test_texts_are_split_once_for_windows_and_counts(spark, bound):
    """What is left after the probe does not read the documents again."""
    d, b = H.sample(spark), H.sample(spark, "benchmark")
    plan = decontaminate.contamination(d, b, broadcast_windows=bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "item_id#" in plan and "lang#" not in plan
