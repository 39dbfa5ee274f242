"""Near-duplicates, nearest neighbours and the pipeline against brute force."""

import random
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402
from flowmetrics.llm import ann, neardup  # noqa: E402


def plain_distance(a, b):
    """Least words to change, add or drop: the whole table."""
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def alike(a, b):
    n = max(len(a), len(b))
    common = sum((Counter(a) & Counter(b)).values())  # all other words need a step each
    if not a or not b or n - common > 0.2 * n + 1e-9:
        return False
    return plain_distance(a, b) <= 0.2 * n + 1e-9


def brute_classes(docs):
    """Smallest id of the connected component, by the edit distance of all pairs."""
    ids = sorted({d for d, _ in docs if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [(d, H.words(t)) for d, t in docs if d is not None]
    for (a, x), (b, y) in combinations(words, 2):
        if a != b and find(a) != find(b) and alike(x, y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def family(rng, start):
    """A text and copies of copies with a few edits each."""
    words = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([20, 30, 48, 70, 150]))]
    out = []
    for i in range(rng.randint(1, 25)):
        out.append((start + i, " ".join(words)))
        words = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, len(words) // 20])):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], [f"n{rng.randrange(5000)}"], [words[at], f"n{rng.randrange(5000)}"]])
    return out


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for f in range(25):
        docs += family(rng, 1000 * f)
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(50_000 + i, passage + " " + " ".join(f"z{rng.randrange(9999)}" for _ in range(40))) for i in range(60)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_copies_inside_a_body_of_texts_with_one_passage(spark):
    """40 of 54 words are the same in all texts (0.74 alike, not linked); every
    third text has a copy that keeps four more (0.81)."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(330):
        tail = [f"z{i}x{j}" for j in range(14)]
        docs.append((i, " ".join(passage + tail)))
        if i % 3 == 0:
            docs.append((10_000 + i, " ".join(passage + tail[:4] + [f"c{i}x{j}" for j in range(10)])))
    rng.shuffle(docs)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 10_000 for i, _ in docs}


def test_near_copies_are_paired_with_one_hub_a_round(spark, monkeypatch):
    """400 near copies share some ten thousand buckets; a round verifies no more
    pairs than there are texts, and labels spread over as many edges at most."""
    rng = random.Random(12)
    words = [f"q{i}" for i in range(120)]
    docs = []
    for i in range(400):
        own = list(words)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(len(own))] = f"r{rng.randrange(9999)}"
        docs.append((i, " ".join(own)))
    pairs, edges = [], []
    likely, components = neardup._likely, neardup.components
    monkeypatch.setattr(neardup, "_likely", lambda p, *a: (pairs.append(p.count()), likely(p, *a))[1])
    monkeypatch.setattr(neardup, "components", lambda e: (edges.append(e.count()), components(e))[1])
    got = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
    assert len(pairs) >= 2 and max(pairs) <= len(docs) and max(edges) <= len(docs)


def test_one_word_edits_of_short_texts(spark):
    """One word changed, dropped or added anywhere in 20 to 48 words."""
    rng = random.Random(3)
    docs, want = [], {}
    for f in range(120):
        words = [f"u{f}x{rng.randrange(99)}" for _ in range(20 + f % 29)]
        at = rng.randrange(len(words))
        other = words[:at] + [["new"], [], [words[at], "new"]][f % 3] + words[at + 1:]
        docs += [(f, " ".join(words)), (1000 + f, " ".join(other))]
        want |= {f: f, 1000 + f: f}
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_tenth_of_the_words_changed(spark):
    """Texts of 100 to 600 words with every tenth word changed at random."""
    rng = random.Random(5)
    docs, want = [], {}
    for f in range(100):
        words = [f"v{f}x{rng.randrange(9999)}" for _ in range(100 + 5 * f)]
        other = [f"w{rng.randrange(9999)}" if rng.random() < 0.1 else w for w in words]
        docs += [(f, " ".join(words)), (1000 + f, " ".join(other))]
        want |= {f: f, 1000 + f: f}
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[d] == c for d, c in want.items()) >= 0.98 * len(want)


def test_distances_equal_the_whole_table():
    rng = random.Random(6)
    for _ in range(400):
        a = [rng.randrange(rng.choice([3, 30, 3000])) for _ in range(rng.randint(0, 60))]
        b = list(a)
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(3)] = [rng.randrange(50) for _ in range(rng.randrange(3))]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        want = plain_distance(a, b)
        limit = rng.randrange(20)
        got = neardup.edit_distance(x, y, limit)
        assert got == want if want <= limit else got > limit
        if a and b:
            assert neardup.anchored_distance(x, y, neardup.shingle_labels(x), neardup.shingle_labels(y), 100) >= want
            assert neardup.linked(x, y) == alike(a, b)


def test_short_gaps_equal_the_band():
    g = np.random.default_rng(5)
    for _ in range(300):
        x, y = (g.integers(0, 4, g.integers(0, 10)).astype(np.uint64) for _ in range(2))
        assert neardup._short_distance(x.tolist(), y.tolist()) == neardup.edit_distance(x, y, 20)


def test_sketches_take_the_smallest_labels():
    g = np.random.default_rng(6)
    for n in (1, 2, 3, 60, 70, 500):
        labels = g.integers(0, 2 ** 63, n, dtype=np.uint64)
        keys, minima = neardup.sketches(labels)
        ranks = neardup._ranks(labels, neardup._ODD)
        assert (minima == ranks.min(axis=1).astype(np.uint32)).all()
        assert len(keys) == neardup.SINGLES * len(neardup.kinds_of(n))
        c = neardup.kinds_of(n)[0]
        for i in (0, 63):
            at = sorted(sorted(range(n), key=lambda k: ranks[i, k])[:neardup.TAKE[c]])
            key = np.array([i + 1000 * c + 1], np.uint64)
            for j in at:
                key = neardup.mix(key * np.uint64(31) + labels[j])
            assert key.view(np.int64)[0] == keys[i]


def test_classes_of_the_corpus(spark):
    docs = [(r.doc_id, r.text) for r in H.sample(spark).collect()]
    assert {r.doc_id: r.class_id for r in neardup.classes(H.sample(spark)).collect()} == brute_classes(docs)


def test_classes_odd_rows(spark):
    got = neardup.classes(H.odd_documents(spark)).collect()
    assert len(got) == len(H.odd_rows())
    assert {r.class_id for r in got if r.doc_id in (1, 2, 8)} == {1}
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    assert all(r.class_id == r.doc_id for r in got if r.doc_id in (3, 4, 6))
    assert neardup.classes(H.no_documents(spark)).count() == 0
    kept = neardup.keep_one(H.odd_documents(spark))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7]


def test_repeated_ids_keep_unique_texts(spark):
    """A row goes for its own text only, whatever other rows of its id hold."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (4, c), (None, a), (5, None), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], H.DOCS)
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (4, c), (None, a), (5, None)], key=str)
    assert neardup.keep_one(docs).columns == docs.columns
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (3, 2), (3, 2), (4, 4), (None, None), (5, 5), (5, 4)], key=str)


def test_alignment_needs_the_order():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.linked(a, a) and not neardup.linked(a, np.roll(a, 50))
    assert neardup.linked(a, np.delete(a, [3, 50])) and not neardup.linked(a, a[:70])
    assert neardup.linked(a, a[:80]) and not neardup.linked(a, a[:79])


def test_sketch_collisions_follow_similarity():
    rng = np.random.default_rng(4)
    for n in (20, 70, 300):
        same = 0
        for _ in range(20):
            a = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
            b = a.copy()
            edit = rng.choice(n, int(0.1 * n), replace=False)
            b[edit] = rng.integers(0, 2 ** 63, len(edit), dtype=np.uint64)
            same += bool(set(neardup.sketches(a)[0]) & set(neardup.sketches(b)[0]))
        assert same == 20


def nearest(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(v)
    out = []
    for q in sorted(good):
        if q % every == 0:
            scored = sorted((-max(float(np.dot(a, b)) for a in good[q] for b in good[c]), c) for c in good if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return out


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [3.0, -1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, [1.0, 0.0, 2.0]), (20, [1.0, 0.0]),
            (40, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as score", "3 as x")
    got = sorted(map(tuple, ann.search(df).collect()))
    assert got == nearest([r for r in rows if r[0] != 9], 20, 20)
    assert ann.search(df.limit(0)).count() == 0


def test_search_recall(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16)) * 2
    x = centre[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[1000:1800] = x[0]  # one very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 3000, 20):
        z = x @ x[q]
        z[q] = -np.inf
        want = np.lexsort((np.arange(3000), -z))[:20]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(abs(z[v] - s) < 1e-9 for _, v, s in rows)
        hit += sum(s >= z[want[-1]] - 1e-9 for _, _, s in rows)
        total += 20
    assert hit / total >= 0.9


def test_pipeline_stages(spark):
    sf = H.SF
    docs = H.sample(spark)
    extra = docs.selectExpr("*", "1 as score", "2 as lang_pred")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
    kept = corpus_pipeline.language_id(spark, H.odd_documents(spark), sf)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 1, 2, 5, 7, 8]
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert one == set(brute_classes(list(texts.items())).values())


def test_language_stage_rejects_noise_and_keeps_what_it_cannot_learn(spark):
    import base64
    import random
    g = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [(9001, base64.b64encode(g.randbytes(600)).decode()), (9002, " ".join(g.randbytes(4).hex() for _ in range(90))),
             (9003, g.randbytes(500).hex()), (9004, "12 !! 34")]
    extra = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in noise], H.DOCS)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(extra), H.SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}  # all clean ones, and no noise
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang", "source", "n_chars").unionByName(extra)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, blank, H.SF).collect()}
    assert 9004 not in kept and len(kept) == docs.count() + 3


def test_pipeline_runs_and_takes_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, H.SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    H.no_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    H.sample(spark, "benchmark").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_search_extreme_and_few(spark, monkeypatch):
    """Vectors of size 1e200 and 1e-200 neither lose the others nor get lost."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    x[7], x[20], x[40] = x[7] * 1e200, x[20] * 1e-200, x[40] * 1e160
    x[60], x[80] = [1e200, 1e200, 0, 0], [1e200, -1e200, 0, 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "PROBES_ROOT", 1000)  # all lists: exact
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    for q, rows in got.items():
        with np.errstate(over="ignore"):
            z = np.array([float((x[q].astype(np.longdouble) * v).sum()) for v in x])
        z[q] = np.nan
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-z[i], i))[:20]
        rows = sorted(rows)
        assert [v for _, v, _ in rows] == want or np.allclose(z[want], [s for _, _, s in rows], rtol=1e-12)
        assert len(rows) == 20


def test_search_widens_until_k(spark, monkeypatch):
    """Lists that hold too few rows: the rest is searched, so every query gets its k."""
    monkeypatch.setattr(ann, "LIST_ROWS", 4)
    monkeypatch.setattr(ann, "MIN_PROBES", 1)
    monkeypatch.setattr(ann, "PROBES_ROOT", 0)
    monkeypatch.setattr(ann, "COPIES", 1)
    monkeypatch.setattr(ann, "SHARD", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counts = {r["query_id"]: r["count"] for r in ann.search(df).groupBy("query_id").count().collect()}
    assert counts == {q: 20 for q in range(0, 300, 20)}
