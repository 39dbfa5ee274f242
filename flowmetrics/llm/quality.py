"""Quality classifier: random-indexing word vectors pooled per document, then
a two-layer numpy network with temperature-calibrated probabilities.

Words are runs of bytes above the space, in their original case.  Each word
falls into one of ``WORD_BUCKETS`` hash buckets and, by its shape (letter case,
digits, other signs, last sign, length), into one of ``SHAPE_BUCKETS``; every
bucket has a sparse ternary index vector of ``DIM`` parts.  A bucket's context
vector is the sum of the index vectors of the two neighbours on either side of
all its occurrences in *all* documents: partial integer sums per task, added
up by bucket, so the table stays bounded (``WORD_BUCKETS`` + ``SHAPE_BUCKETS``
rows) at any corpus size and does not depend on task order.

A document is pooled over all its words: mean and deviation of the normed
vectors, the largest and smallest segment mean (``SEGMENT`` words), and how
alike neighbouring vectors are.  The network is fitted on at most ``N_LABELLED``
labelled texts outside the held-out fold; a fifth of them is kept from the
fit to choose its temperature.

Defined results: null and empty texts pool to zeros and get a score like any
other; without both label values every score is 0.5; a null id counts as the
text '' in the fold; repeated rows each get a result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, run_hashes, runs, utf8_blocks
from .sampling import labelled_texts

WORD_BUCKETS = 1 << 13
SHAPE_BUCKETS = 1 << 10
DIM = 24
NONZERO = 4
SEGMENT = 64
N_LABELLED = 12_000
HIDDEN = 32
_N = WORD_BUCKETS + SHAPE_BUCKETS


def index_vectors(seed: int = 5) -> np.ndarray:
    g = np.random.default_rng(seed)
    out = np.zeros((_N, DIM), np.float32)
    at = np.argsort(g.random((_N, DIM)), axis=1)[:, :NONZERO]
    out[np.arange(_N)[:, None], at] = g.choice([-1.0, 1.0], (_N, NONZERO))
    return out


_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 4 digit, 8 other sign, 16 beyond ASCII
_CLASS[33:127] = 8
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 4
_CLASS[128:] = 16


def buckets(data: np.ndarray, offsets: np.ndarray):
    """(word bucket, shape bucket, words before each row) of a block."""
    mask = data > 32
    starts, lengths, before = runs(mask, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), before
    h = run_hashes(data, mask, lengths)[0]
    kind = _CLASS[data]
    first = np.cumsum(lengths) - lengths
    flags = np.bitwise_or.reduceat(kind[mask], first).astype(np.uint64)
    last = data[starts + lengths - 1]
    last = np.where(_CLASS[last] == 8, last, 0).astype(np.uint64)
    size = np.minimum(lengths, 15).astype(np.uint64) // np.uint64(4)
    head = kind[starts].astype(np.uint64)
    shape = mix(flags + (head << np.uint64(8)) + (last << np.uint64(16)) + (size << np.uint64(24)))
    return ((h % np.uint64(WORD_BUCKETS)).astype(np.int64),
            (shape % np.uint64(SHAPE_BUCKETS)).astype(np.int64) + WORD_BUCKETS, before)


def _neighbours(v: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of the vectors of up to two words on either side, same row only."""
    out = np.zeros_like(v)
    for d in (1, 2):
        if len(v) > d:
            same = (row[d:] == row[:-d])[:, None]
            out[d:] += v[:-d] * same
            out[:-d] += v[d:] * same
    return out


def context_table(documents: DataFrame) -> np.ndarray:
    """Normed context vectors of all buckets, from all documents."""
    names = [f"d{i}" for i in range(DIM)]

    def run(batches):
        index = index_vectors()
        total = np.zeros((DIM, _N))
        for b in batches:
            for _, off, data in utf8_blocks(b.column("text"), 1 << 20):
                w, s, before = buckets(data, off)
                row = np.repeat(np.arange(len(off) - 1), np.diff(before))
                for ids in (w, s):
                    near = _neighbours(index[ids], row)
                    for d in range(DIM):
                        total[d] += np.bincount(ids, weights=near[:, d], minlength=_N)
        used = np.flatnonzero(np.abs(total).sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32))] + [pa.array(total[d][used].astype(np.int64)) for d in range(DIM)],
            ["bucket", *names])

    parts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect()  # _N rows at most
    table = np.zeros((_N, DIM), np.float64)
    for r in rows:
        table[r["bucket"]] = [r[n] for n in names]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One feature row per text of a block."""
    w, s, before = buckets(data, offsets)
    n = np.diff(before)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), 8 * DIM + 6), np.float32)
    if not len(full):
        return out
    at = before[:-1][full]
    row = np.repeat(np.arange(len(n)), n)
    count = n[full][:, None].astype(np.float32)
    pos = np.arange(len(w)) - before[:-1][row]
    seg_start = np.flatnonzero(pos % SEGMENT == 0)
    seg_row = np.searchsorted(seg_start, at)
    seg_n = np.diff(np.append(seg_start, len(w)))[:, None].astype(np.float32)
    col = 0
    for ids in (w, s):
        v = table[ids]
        mean = np.add.reduceat(v, at) / count
        dev = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / count - mean * mean, 0))
        seg = np.add.reduceat(v, seg_start) / seg_n
        for part in (mean, dev, np.maximum.reduceat(seg, seg_row), np.minimum.reduceat(seg, seg_row)):
            out[full, col:col + DIM] = part
            col += DIM
        like = np.zeros(len(v), np.float32)
        like[1:] = np.einsum("ij,ij->i", v[1:], v[:-1]) * (row[1:] == row[:-1])
        seg_like = np.add.reduceat(like, seg_start) / seg_n[:, 0]
        norm = np.linalg.norm(seg, axis=1)
        base = 8 * DIM + (0 if ids is w else 3)
        out[full, base] = np.add.reduceat(like, at) / count[:, 0]
        out[full, base + 1] = np.maximum.reduceat(seg_like, seg_row)
        out[full, base + 2] = np.maximum.reduceat(norm, seg_row)
    return out


class TwoLayer:
    """Standardised input, one hidden rectified layer, logistic output."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60,
            rate: float = 3e-3, l2: float = 1e-3) -> "TwoLayer":
        g = np.random.default_rng(seed)
        order = g.permutation(len(x))
        cut = max(1, len(x) // 5)
        check, learn = order[:cut], order[cut:]
        self.mean, self.std = x[learn].mean(0), x[learn].std(0) + 1e-4
        z = (x - self.mean) / self.std
        p = [g.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             g.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, t = [0 * a for a in p], [0 * a for a in p], 0
        for _ in range(epochs):
            o = g.permutation(learn)
            for i in range(0, len(o), 64):
                b, t = o[i:i + 64], t + 1
                h = np.maximum(z[b] @ p[0] + p[1], 0)
                d = (_sig(h @ p[2] + p[3][0]) - y[b]) / len(b)
                dh = np.outer(d, p[2]) * (h > 0)
                for j, gr in enumerate((z[b].T @ dh + l2 * p[0], dh.sum(0), h.T @ d + l2 * p[2],
                                        np.array([d.sum()]))):
                    m[j] = 0.9 * m[j] + 0.1 * gr
                    v[j] = 0.99 * v[j] + 0.01 * gr * gr
                    p[j] = p[j] - rate * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(v[j] / (1 - 0.99 ** t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, target = self.logits(x[check]), y[check]
        loss = lambda s: np.mean(np.logaddexp(0, logit / s) - target * logit / s)
        self.temperature = float(min(np.geomspace(0.5, 10, 60), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.std) @ self.p[0] + self.p[1], 0)
        return (h @ self.p[2] + self.p[3][0]) / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sig(self.logits(x))


def _sig(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(documents: DataFrame, labels: DataFrame, held_value: int = 1, mod: int = 3):
    """(context table, network); the network is ``None`` without both labels."""
    table = context_table(documents)
    sample = labelled_texts(documents, labels, "quality", fold(F.col("doc_id"), mod) != held_value,
                            N_LABELLED, "quality")

    def run(batches):
        for b in batches:
            for i0, off, data in utf8_blocks(b.column("text"), 1 << 20):
                f = pooled(data, off, table)
                yield pa.RecordBatch.from_arrays(
                    [b.column("y").slice(i0, len(f)), pa.array([r.tobytes() for r in f], pa.binary())], ["y", "f"])

    rows = sorted((r["y"], bytes(r["f"])) for r in
                  sample.select("y", "text").mapInArrow(run, "y int, f binary").collect())
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y)) < 2:
        return table, None
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows]).astype(np.float64)
    return table, TwoLayer().fit(x, y)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    table, net = train(documents, labels)
    held = fold(F.col("doc_id"), 3) == 1
    cols = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("__text"))
    schema = cols.drop("__text").schema.add("score", "double")

    def run(batches):
        for b in batches:
            s = np.full(b.num_rows, 0.5)
            if net is not None:
                for i0, off, data in utf8_blocks(b.column("__text"), 1 << 20):
                    s[i0:i0 + len(off) - 1] = net.probability(pooled(data, off, table))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    return cols.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
