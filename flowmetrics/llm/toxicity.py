"""Toxicity by non-negative positive-unlabelled learning in numpy.

Confirmed toxic texts (P) and unlabelled texts (U, any text of the training
fold, whatever its label) are all the fit sees, besides the class prior: the
share of toxic rows among the labelled ones of the training fold.  Features
are the words of a text and their first 4, 5 and 6 bytes, as 64-bit hashes,
present or not over the whole text; up to ``N_FEATURES`` are kept for which
``prior * share in P / share in U``, an estimate of the share of toxic texts
among those with the feature, is at least ``PRECISION``.  A logistic model minimises
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``; where the second term
falls below zero its gradient is reversed, as the non-negative estimator asks.

Fitting uses at most ``N_POSITIVE`` toxic and ``N_UNLABELLED`` unlabelled texts
(by a hash of the id).

Defined results: null and empty texts score as a text without any feature;
without toxic rows every score is 0.0; a null id counts as the text '' in the
fold; repeated rows each get a result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lower_latin, run_hashes, runs, utf8_blocks
from .sampling import labelled_texts, plain_texts

N_POSITIVE = 4000
N_UNLABELLED = 8000
N_FEATURES = 1024
THRESHOLD = 0.3
#: least estimated share of toxic texts among those with a feature
PRECISION = 0.7
PREFIXES = (4, 5, 6)

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def features(data: np.ndarray, offsets: np.ndarray):
    """All feature hashes of a block and the row of each (with repeats)."""
    low = lower_latin(data)
    mask = _WORD[low]
    _, lengths, before = runs(mask, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    hashes = run_hashes(low, mask, lengths, PREFIXES)
    out_h, out_r = [hashes[0]], [row]
    for k, h in zip(PREFIXES, hashes[1:]):
        longer = lengths > k
        out_h.append(h[longer])
        out_r.append(row[longer])
    return np.concatenate(out_h), np.concatenate(out_r)


class Lexicon:
    """Sorted feature hashes; finds the features present in each row."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def present(self, data, offsets):
        """(row, feature) pairs, each once."""
        h, r = features(data, offsets)
        maybe = self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        h, r = h[maybe], r[maybe]
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == h if len(self.hashes) else np.zeros(0, bool)
        pair = np.unique(r[hit].astype(np.int64) * len(self.hashes) + at[hit])
        return pair // max(len(self.hashes), 1), pair % max(len(self.hashes), 1)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400,
             rate: float = 0.05, l2: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model under the non-negative risk."""
    k = xp.shape[1]
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        gp, gu = xp @ w[:k] + w[k], xu @ w[:k] + w[k]
        # slope of the mean loss with respect to the score
        pos = -sig(-gp) / len(gp)
        neg_p, neg_u = sig(gp) / len(gp), sig(gu) / len(gu)
        rest = soft(gu).mean() - prior * soft(gp).mean()
        if rest >= 0:
            dp, du = prior * pos - prior * neg_p, neg_u
        else:
            dp, du = prior * neg_p, -neg_u
        g = np.empty(k + 1)
        g[:k] = xp.T @ dp + xu.T @ du + l2 * w[:k]
        g[k] = dp.sum() + du.sum()
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w[:k], float(w[k])


def _counts(sample: DataFrame, column: str) -> DataFrame:
    """(h, column): number of sample texts that hold each feature."""
    def run(batches):
        for b in batches:
            for _, off, data in utf8_blocks(b.column("text")):
                h, r = features(data, off)
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                u, c = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))],
                                                 ["h", column])
    return sample.select("text").mapInArrow(run, f"h long, {column} long") \
        .groupBy("h").agg(F.sum(column).alias(column))


def _vectors(sample: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """0/1 rows of the bounded sample over the chosen features."""
    def run(batches):
        lex = Lexicon(hashes)
        for b in batches:
            for _, off, data in utf8_blocks(b.column("text")):
                r, f = lex.present(data, off)
                cut = np.searchsorted(r, np.arange(len(off)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i:j].astype(np.int32) for i, j in zip(cut[:-1], cut[1:])],
                              pa.list_(pa.int32()))], ["f"])
    rows = sorted(tuple(r["f"]) for r in sample.select("text").mapInArrow(run, "f array<int>").collect())
    x = np.zeros((len(rows), len(hashes)), np.float32)
    for i, f in enumerate(rows):
        x[i, list(f)] = 1
    return x


def train(documents: DataFrame, labels: DataFrame, held_value: int = 2, mod: int = 4):
    """(hashes, weights, bias), or ``None`` without toxic training rows."""
    is_train = fold(F.col("doc_id"), mod) != held_value
    known = labels.filter(F.col("doc_id").isNotNull() & is_train & F.col("toxic").isin(0, 1)) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("s")).first()
    if not known["n"] or not known["s"]:
        return None
    prior = min(max(known["s"] / known["n"], 1e-4), 0.95)
    pos = labelled_texts(documents, labels, "toxic", is_train, N_POSITIVE, "toxic", value=1)
    unl = plain_texts(documents, is_train, N_UNLABELLED, "unlabelled")
    n_p, n_u = pos.count(), unl.count()
    if not n_p or not n_u:
        return None
    p, u = _counts(pos, "p"), _counts(unl, "u")
    least = max(4, int(0.01 * n_p)) if n_p >= 10 else 1
    rate_p, rate_u = F.col("p") / n_p, (F.coalesce(F.col("u"), F.lit(0)) + 0.5) / n_u
    best = p.filter(F.col("p") >= least).join(u, "h", "left") \
        .filter(F.lit(prior) * rate_p >= PRECISION * rate_u) \
        .select("h", (rate_p * F.log(rate_p / rate_u)).alias("gain")) \
        .orderBy(F.desc("gain"), "h").limit(N_FEATURES).collect()
    if not best:
        return None
    hashes = np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))
    w, bias = fit_nnpu(_vectors(pos, hashes), _vectors(unl, hashes), prior)
    return hashes, w, bias


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(documents, labels)
    held = fold(F.col("doc_id"), 4) == 2
    cols = documents.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("__text"))
    schema = cols.drop("__text").schema.add("score", "double")

    def run(batches):
        lex = Lexicon(model[0]) if model else None
        for b in batches:
            s = np.zeros(b.num_rows)
            if model:
                s[:] = model[2]
                for i0, off, data in utf8_blocks(b.column("__text")):
                    r, f = lex.present(data, off)
                    np.add.at(s, i0 + r, model[1][f])
                s = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    return cols.mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
