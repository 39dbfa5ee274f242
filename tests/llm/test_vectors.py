"""Hard negatives and near-duplicate vectors against brute force."""

import math
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from flowmetrics.llm import hardneg, vecdedup  # noqa: E402

EMB = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")
CLASH = ["score", "rank", "size", "x", "u", "cell", "block", "chunk", "id", "low", "links", "copies", "key", "anchor_id",
         "home", "reach", "fp"]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


# -- hard negatives ----------------------------------------------------------------

def brute_negatives(rows):
    one = {}
    for i, v, label in rows:
        if i is None or label is None or not usable(v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        one[i] = min(one.get(i, (label, v)), (label, v))
    q = {i: [int(256 * c) if 256 * c == int(256 * c) else math.floor(256 * c) for c in v] for i, (_, v) in one.items()}
    out = []
    for a in (i for i in one if i % 100 == 0):
        scored = sorted((-max(-2 ** 62, min(2 ** 62, sum(x * y for x, y in zip(q[a], q[i])))), i)
                        for i in one if i != a and len(q[i]) == len(q[a]))
        for p, i in [(-s, i) for s, i in scored if one[i][0] == one[a][0]][:5]:
            held = [(-s, j) for s, j in scored if one[j][0] != one[a][0] and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, i, r + 1, j, p, s) for r, (s, j) in enumerate(held)]
    return sorted(out)


def check_negatives(spark, rows, extra=()):
    df = spark.createDataFrame(rows, EMB)
    from pyspark.sql import functions as F
    df = df.select("*", *[F.lit("x").alias(c) for c in extra])
    got = sorted(tuple(r) for r in hardneg.mine(df).collect())
    assert got == brute_negatives(rows)
    return got


def random_rows(seed, n, dim=8, labels=3, grid=None):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dim))
    if grid:
        x = np.round(x * grid) / grid
    return [(i, x[i].tolist(), int(g.integers(labels))) for i in range(n)]


def test_negatives_whole_table(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in H.sample(spark, "embeddings").collect()]
    assert len(check_negatives(spark, rows)) > 100


def test_negatives_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 50)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    monkeypatch.setattr(hardneg, "SLICE", 2)
    assert check_negatives(spark, random_rows(1, 900))


def test_negatives_ties_and_zero_scores(spark, monkeypatch):
    """Few different vectors, so most scores are equal; a third is one vector, some are zero."""
    monkeypatch.setattr(hardneg, "BLOCK", 64)
    rows = random_rows(2, 600, dim=2, grid=1)
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.0, 0.0] if i % 5 == 0 else v, y) for i, v, y in rows]
    got = check_negatives(spark, rows)
    assert any(r[4] == 0 for r in got)


def test_negatives_odd_rows(spark):
    rows = random_rows(3, 250)
    odd = [(None, [1.0] * 8, 1), (300, None, 1), (400, [1.0] * 8, None), (500, [NAN] + [1.0] * 7, 1), (501, [INF] * 8, 1),
           (600, [None] + [1.0] * 7, 1), (700, [1.0, 2.0], 1), (701, [1.0, 1.0], 2), (702, [1.0, 2.0], 2), (703, [2.0, 2.0], 2),
           (800, [], 1), (801, [], 2), (900, [0.0] * 8, 1), (900, [5.0] * 8, 0), (100, rows[100][1], rows[100][2]),
           (1000, [3e19] * 8, 1), (1001, [2e19] * 8, 2), (1002, [1e25] * 8, 2), (1003, [-1e19] * 8, 1), (-100, [1.0] * 8, -3)]
    check_negatives(spark, rows + odd, CLASH)
    assert hardneg.mine(spark.createDataFrame([], EMB)).collect() == []
    assert hardneg.mine(spark.createDataFrame([(0, [1.0], 1)], EMB)).collect() == []


def test_keys_order_as_the_stream_needs():
    keys = [(a, s, k, i) for a in (-5, 0, 9) for s in (2 ** 62, 7, 0, -7, -2 ** 62) for k in (0, 1) for i in (-3, 0, 8)]
    cols = [np.array(c, np.int64) for c in zip(*keys)]
    packed = [hardneg.packed(a[None], s[None], k, i[None])[0].tobytes() for a, s, k, i in zip(*cols)]
    assert packed == sorted(packed) and [hardneg.unpacked(p) for p in packed] == keys


# -- near-duplicate vectors ------------------------------------------------------------

def brute_links(rows, at=0.98):
    one = {}
    for i, v, y in rows:
        if i is not None:
            part = (y is None or not usable(v) or not any(v), y if y is not None else -1, v if v is not None else [])
            one[i] = min(one.get(i, part), part, key=lambda p: (p[0], p[1], [str(c) for c in p[2]] if p[0] else p[2]))
    parent = {i: i for i in one}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = {}
    for i, (bad, _, v) in one.items():
        if not bad:
            most = max(map(abs, v))
            w = [c / most for c in v]
            unit[i] = np.array(w) / math.sqrt(sum(c * c for c in w))
    n = dict.fromkeys(one, 0)
    for i in unit:
        for j in unit:
            if i < j and one[i][1] == one[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= at:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, n[i], find(i), find(i) == i) for i in one)


def clustered(seed, n, dim, spread, labels=2):
    """Random vectors, each third near an earlier one at about the limit."""
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = g.integers(labels, size=n)
    for i in range(1, n, 3):
        j = g.integers(i)
        x[i] = x[j] + g.normal(size=dim) * spread * g.random() / math.sqrt(dim)
        y[i] = y[j]
    return [(i, x[i].tolist(), int(y[i])) for i in range(n)]


def check_links(spark, rows, extra=()):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, EMB).select("*", *[F.lit("x").alias(c) for c in extra])
    got = sorted(tuple(r) for r in vecdedup.near_duplicates(df).collect() if r["vec_id"] is not None)
    assert got == brute_links(rows)
    return got


def test_links_in_one_cell_and_in_many(spark, monkeypatch):
    rows = clustered(1, 700, 24, 0.3)
    got = check_links(spark, rows, CLASH)
    assert sum(r[1] for r in got) > 100
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 8)  # a grid of 6 x 6 codes
    monkeypatch.setattr(vecdedup, "CHUNK", 16)
    monkeypatch.setattr(vecdedup, "BLOCK", 32)
    monkeypatch.setattr(vecdedup, "FEW_CELLS", 0)
    assert check_links(spark, rows) == got


def test_recall_of_a_fine_grid(monkeypatch):
    """Neighbours just inside the limit, on a grid of 16 x 16 codes: either side's traversal finds nearly all,
    and visits a part of the cells."""
    g = np.random.default_rng(5)
    x = g.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = g.normal(size=x.shape)
    step -= (step * x).sum(1, keepdims=True) * x
    y = 0.98001 * x + math.sqrt(1 - 0.98001 ** 2) * step / np.linalg.norm(step, axis=1, keepdims=True)
    grid = vecdedup.Grid(x, 16)
    mx, my = grid.margins(x), grid.margins(y)
    hx, hy = grid.home(mx), grid.home(my)
    cells = [set(grid.visits(mx, i)[0]) for i in range(600)]
    back = [set(grid.visits(my, i)[0]) for i in range(600)]
    found = sum(hy[i] in cells[i] or hx[i] in back[i] for i in range(600))
    assert found >= 0.995 * 600
    assert sum(map(len, cells)) < 0.5 * 600 * len(grid.books[0]) * len(grid.books[1])


def test_traversal_ascends_and_is_whole():
    g = np.random.default_rng(3)
    a, b = g.random(7), g.random(5)
    got = list(vecdedup.multi_sequence(a, b))
    assert [s for s, *_ in got] == sorted(s for s, *_ in got)
    assert {(i, j) for _, i, j in got} == {(i, j) for i in range(7) for j in range(5)}


def test_links_of_copies_and_chains(spark, monkeypatch):
    """A third of the rows is one vector (and its multiples), beside a chain of small turns."""
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 8)
    turn = [(1000 + i, [math.cos(0.15 * i), math.sin(0.15 * i)], 1) for i in range(30)]
    copies = [(i, [2.0 ** (i % 3), 0.0], 1) for i in range(200)]
    other = [(2000 + i, [1.0, 0.0], 2) for i in range(5)] + [(3000, [-1.0, 0.0], 1)]
    got = check_links(spark, copies + turn + other)
    assert {r[2] for r in got if 1000 <= r[0] < 1030} == {0}


def test_links_odd_rows(spark):
    v = [1.0, 0.5, 0.25]
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [], 1), (5, [0.0] * 3, 1), (6, [NAN, 1.0, 1.0], 1),
            (7, [None, 1.0, 1.0], 1), (8, [INF, 1.0, 1.0], 1), (9, [c * 1e200 for c in v], 1), (10, [c * 1e-200 for c in v], 1),
            (11, [1.0, 0.5], 1), (12, [2.0, 1.0], 1), (13, [-1.0, -0.5, -0.25], 1), (14, v, 2), (15, v, 1), (15, v, 1),
            (16, [-0.0, 1.0, 0.0], 3), (17, [0.0, 1.0, -0.0], 3), (18, [1e308, 5e307, 2.5e307], 1), (19, [5e-324, 0.0, 0.0], 1)]
    got = {r[0]: r for r in check_links(spark, rows, CLASH)}
    assert got[1][1] == 4 and got[18][2] == 1 and got[17][2] == 16 and got[12][2] == 11
    null = vecdedup.near_duplicates(spark.createDataFrame([(None, v, 1), (1, v, 1)], EMB)).collect()
    assert sorted(map(tuple, null), key=str) == [(1, 0, 1, True), (None, 0, None, None)]
    assert vecdedup.near_duplicates(spark.createDataFrame([], EMB)).collect() == []
