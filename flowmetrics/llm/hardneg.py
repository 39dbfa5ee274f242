"""Hard negatives by a secondary-sort shuffle.

Anchors are scored against all rows, and each anchor's scores are read in
descending order: a positive opens a window of negative scores, and negatives
are emitted to the open windows as they come by.

1. *Scores.*  Components become ``floor(256 x)``, so scores are integers and
   exact.  Rows are dealt by hash into blocks of about ``BLOCK`` and anchors into
   blocks of about ``ANCHORS`` (by counts); one group scores one pair of blocks.
2. *Positives.*  Each group keeps an anchor's best ``positives`` rows of the same
   label, which is lossless; the best of those over all blocks are its positives.
3. *Keys.*  Each group keeps, for every window of the anchor's positives, the
   window's best ``negatives`` of the block, which is lossless too, packed into
   25-byte keys: anchor, descending score, kind (positive before negative), id.
   So an anchor costs at most 50 keys a block whatever its ties.
4. *Stream.*  ``repartitionAndSortWithinPartitions`` sends the keys of an anchor
   to one partition in key order; an iterator over the partition holds the open
   windows of one anchor (at most ``positives`` counters) and nothing else.

A positive of score p opens the window ``low * p <= 100 * score <= high * p``.
Below zero it is empty; at zero it holds the scores of zero, which is why a
positive sorts before a negative of its own score.

Defined results: rows with a null id, label or vector or a null or non-finite
component take no part; vectors of different lengths have no score; rows of one
id count once (smallest label, then vector) and are never their own positives; a
score beyond +-2^62 counts as that; an anchor without positives or a window
without negatives gives no rows; an empty table gives no rows; other columns are
not read.  A component whose 256-fold leaves the range of doubles counts as the
largest double.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
EVERY = 100
SHIFT_EVERY = 7
CLASSES = 10
SCALE = 256
BLOCK = 4096
ANCHORS = 2048
#: anchors scored at once within a group
SLICE = 64
LIMIT = 1 << 62

_KEY = ">QQBQ"
_SIGN = 1 << 63
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# -- rows ------------------------------------------------------------------------

def _whole(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x, size) of the rows that take part, labels shifted,
    written once."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             x.alias("x")).dropna().filter(_whole(F.col("x")))
    moved = (F.col("label") + 1) % F.lit(CLASSES)
    rows = staged(rows.withColumn("label", F.when(F.col("vec_id") % SHIFT_EVERY == 0, moved).otherwise(F.col("label")))
                  .withColumn("size", F.size("x")), "vectors")
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).limit(1).count()
    if repeated:
        one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x", "size")).alias("r"))
        rows = staged(one.select("vec_id", "r.*"), "vectors")
    return rows


def quantised(column, rows: int) -> np.ndarray:
    """``floor(256 x)`` of an Arrow list column, one row each."""
    x = np.asarray(column.flatten(), dtype=np.float64)
    return np.floor(x * SCALE).reshape(rows, -1) if len(x) else np.zeros((rows, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; beyond +-2^62 they count as that."""
    size = a.shape[1]
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(size, 1)
    if most < 2 ** 53:
        return (a @ b.T).astype(np.int64)

    def exact(m):  # whole numbers of any size; a product that left the range of doubles is far beyond the limit
        top = np.finfo(np.float64).max
        return np.array([[int(v) for v in row] for row in np.clip(m, -top, top)], dtype=object).reshape(m.shape)

    z = exact(a).dot(exact(b).T)
    return np.array([[max(-LIMIT, min(LIMIT, int(v))) for v in row] for row in z], np.int64).reshape(z.shape)


# -- one pair of blocks ------------------------------------------------------------

def best(score: np.ndarray, ids: np.ndarray, take: np.ndarray, k: int):
    """(row, column) of the ``k`` highest scores per row where ``take`` holds,
    ties to the smaller id; ``ids`` ascend."""
    z = np.where(take, score, np.iinfo(np.int64).min)
    n = z.shape[1]
    if n > k:
        least = np.partition(z, n - k, axis=1)[:, n - k, None]
        take = take & (z >= least)
    row, col = np.nonzero(take)
    order = np.lexsort((ids[col], -z[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _blocks(rows: pa.Table, anchors: pa.Table):
    """Quantised rows and anchors, by ascending id, and the slices of anchors."""
    rows, anchors = (t.combine_chunks().sort_by("vec_id") for t in (rows, anchors))
    b = quantised(rows["x"].combine_chunks(), rows.num_rows)
    a = quantised(anchors["x"].combine_chunks(), anchors.num_rows)
    return rows, anchors, b, a


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)


def _nearest_same(k: int):
    """The best ``k`` other rows of the same label of each anchor in a block."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and anchors.num_rows:
            rows, anchors, b, a = _blocks(rows, anchors)
            ids, own, label, mine = (_column(t, c) for c in ("vec_id", "label") for t in (rows, anchors))
            for s in range(0, len(own), SLICE):
                e = slice(s, s + SLICE)
                score = products(a[e], b)
                r, c = best(score, ids, (label[None] == mine[e, None]) & (ids[None] != own[e, None]), k)
                parts.append((own[e][r], ids[c], score[r, c]))
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("anchor_id", "vec_id", "score"), map(pa.array, cols))))
    return run


def packed(anchor, score, kind: int, ids) -> np.ndarray:
    """Keys whose bytes order by anchor, descending score, kind and id."""
    out = np.empty(len(anchor), dtype=[("a", ">u8"), ("s", ">u8"), ("k", "u1"), ("i", ">u8")])
    out["a"] = anchor.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    out["s"] = ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN))
    out["k"] = kind
    out["i"] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return out


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """anchor, score, kind, id."""
    a, s, kind, i = struct.unpack(_KEY, key)
    return a - _SIGN, (_SIGN - 1) - s, kind, i - _SIGN


def partition_of(key: bytes) -> int:
    """Spreads anchors over partitions, alike on all machines."""
    return zlib.crc32(key[:8])


def _window_keys(k: int, low: int, high: int):
    """Packed keys of the best ``k`` rows of another label in each window of an
    anchor's positives, in a block."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys = []
        if rows.num_rows and anchors.num_rows:
            rows, anchors, b, a = _blocks(rows, anchors)
            ids, own, label, mine = (_column(t, c) for c in ("vec_id", "label") for t in (rows, anchors))
            scores = anchors["scores"].to_pylist()
            # whole bounds of each window; an empty one where there is no positive
            width = max(map(len, scores))
            lo = np.array([[-(-low * p // 100) for p in s] + [1] * (width - len(s)) for s in scores], np.int64)
            hi = np.array([[high * p // 100 for p in s] + [0] * (width - len(s)) for s in scores], np.int64)
            for s in range(0, len(own), SLICE):
                e = slice(s, s + SLICE)
                score = products(a[e], b)
                other = label[None] != mine[e, None]
                held = np.zeros(score.shape, bool)
                for w in range(width):
                    if (lo[e, w] > hi[e, w]).all():
                        continue
                    r, c = best(score, ids, other & (score >= lo[e, w, None]) & (score <= hi[e, w, None]), k)
                    held[r, c] = True
                r, c = np.nonzero(held)
                keys += [x.tobytes() for x in packed(own[e][r], score[r, c], 1, ids[c])]
        return pa.table({"key": pa.array(keys, pa.binary())})
    return run


def _paired(rows: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over every pair of a block of rows and a block of anchors."""
    n, m = rows.count(), anchors.count()
    n, m = max(1, -(-n // BLOCK)), max(1, -(-m // ANCHORS))

    def dealt(df, blocks, column, other, others):
        return df.withColumn(column, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    key = ["size", "block", "ablock"]
    left = dealt(rows, n, "block", "ablock", m)
    right = dealt(anchors, m, "ablock", "block", n)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


# -- the stream ----------------------------------------------------------------------

def emitted(keys, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH):
    """The result rows of keys in order.  Holds one anchor's open windows."""
    anchor, opened, windows = None, 0, []
    for key in keys:
        a, score, kind, i = unpacked(key)
        if a != anchor:
            anchor, opened, windows = a, 0, []
        if kind == 0:
            if opened < positives:
                opened += 1
                windows.append([i, score, 0])
            continue
        # windows below the stream are done, as are full ones
        windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield a, w[0], w[2], i, w[1], score


def mine(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score of the hard negatives of every anchor and positive."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    near = _paired(rows, anchors, _nearest_same(positives), "anchor_id long, vec_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = staged(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives), "positives")
    # at most ``positives`` scores an anchor
    windows = near.filter(F.col("score") >= 0).groupBy(F.col("anchor_id").alias("vec_id")) \
        .agg(F.collect_set("score").alias("scores"))
    open_ = staged(anchors.join(windows, "vec_id"), "anchors")
    found = _paired(rows, open_, _window_keys(negatives, low, high), "key binary")

    def openers(batches):
        for b in batches:
            keys = packed(*(b.column(c).to_numpy() for c in ("anchor_id", "score")), 0, b.column("vec_id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary())], ["key"])

    keys = near.select("anchor_id", "score", "vec_id").mapInArrow(openers, "key binary").unionByName(found)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        parts, partition_of)
    return spark.createDataFrame(
        in_order.mapPartitions(lambda it: emitted((k for k, _ in it), positives, negatives, low, high)), _OUT,
        verifySchema=False)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
