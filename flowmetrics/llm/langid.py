"""Language identification by a byte convolutional network in numpy.

Texts (ASCII and Latin-1 letters lowered) are cut into fixed windows of
``WINDOW`` bytes, the last one padded with spaces.  Each byte has a learned
vector; filters of several widths slide over a window, their maxima go
through a rectifier into a softmax over the languages.  A document's
probabilities are the mean over all its windows, weighted by their bytes, so
the whole text counts.

Fitting: up to ``DOCS_PER_LANG`` texts a language (by a hash of the id) and up
to ``WINDOWS_PER_DOC`` windows of each, spread over the text.

Filtering (:func:`in_a_language`): a network trained with one more class, made
of windows that are no language (learned windows with their bytes shuffled,
hexadecimal and base64 data, symbols).  A text is rejected if its mean
probability of that class is ``NOISE_SCORE`` or more over at least
``NOISE_BYTES`` (a line of numbers and addresses is too little to tell), or if
it has no letter.

Defined results: a null text, or one without any letter, is ``und`` with score
0.0; null ``lang`` values are not learned; a null id counts as the text '' in
the fold; with nothing to learn from every text is ``und``, and
filtering keeps all texts with a letter; repeated rows each
get a result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, lower_latin, utf8_blocks
from .sampling import hash_share

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBED = 8
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 12
UND = "und"
#: the class of windows that are no language; no value of ``lang``
NOISE = "\0noise"
NOISE_SCORE = 0.9
NOISE_BYTES = 2 * WINDOW
_ROWS = 128  # windows at once


def window_matrix(data: np.ndarray, offsets: np.ndarray):
    """All windows of a block: (windows, bytes in each, first window of each
    row); an empty row has no window."""
    low = lower_latin(data)
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.full(int(first[-1]) * WINDOW, 32, np.uint8)
    shift = np.repeat(first[:-1] * WINDOW - offsets[:-1], size)
    flat[np.arange(len(low)) + shift] = low
    used = np.full(int(first[-1]), WINDOW, np.int64)
    full = count > 0
    used[first[1:][full] - 1] = size[full] - (count[full] - 1) * WINDOW
    return flat.reshape(-1, WINDOW), used, first


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    ascii_before = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    out = np.diff(ascii_before[offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(c.isalpha() for c in text)
    return out


class ByteConvNet:
    def __init__(self, classes: list[str], seed: int = 7):
        g = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": g.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"K{w}"] = g.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["W"] = g.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes)))
        self.p["c"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pool(self, x: np.ndarray, arg: bool = False):
        n, length = x.shape
        emb = self.p["E"][x]
        s = emb.strides
        pooled, at = [], []
        for w in WIDTHS:
            m = length - w + 1
            cols = np.lib.stride_tricks.as_strided(emb, (n, m, w * EMBED), (s[0], s[1], s[2]))
            z = (np.ascontiguousarray(cols).reshape(n * m, -1) @ self.p[f"K{w}"]).reshape(n, m, FILTERS)
            if arg:
                a = z.argmax(1)
                at.append(a)
                pooled.append(np.take_along_axis(z, a[:, None], 1)[:, 0] + self.p[f"b{w}"])
            else:
                pooled.append(z.max(1) + self.p[f"b{w}"])
        return emb, np.concatenate(pooled, 1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), _ROWS):
            h = np.maximum(self._pool(x[i:i + _ROWS])[1], 0)
            out[i:i + _ROWS] = softmax(h @ self.p["W"] + self.p["c"])
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        emb, pooled, at = self._pool(x, arg=True)
        h = np.maximum(pooled, 0)
        d = softmax(h @ self.p["W"] + self.p["c"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"W": h.T @ d, "c": d.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = (d @ self.p["W"].T) * (pooled > 0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            dz = dh[:, k * FILTERS:(k + 1) * FILTERS]
            g[f"b{w}"] = dz.sum(0)
            kernel = self.p[f"K{w}"].reshape(w, EMBED, FILTERS)
            gk = np.empty_like(kernel)
            for j in range(w):
                spot = at[k] + j
                gk[j] = np.einsum("nfe,nf->ef", emb[rows, spot], dz)
                np.add.at(g["E"], x[rows, spot], dz[..., None] * kernel[j].T[None])
            g[f"K{w}"] = gk.reshape(w * EMBED, FILTERS)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 256,
            rate: float = 4e-3, seed: int = 11) -> "ByteConvNet":
        rng, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick, t = order[i:i + batch], t + 1
                lr = rate * (1 - 0.9 * t / steps)
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9 ** t))
                                 / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def noise_windows(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """``n`` windows that are no language: windows of ``x`` with their bytes
    shuffled, and runs of hexadecimal, base64 and symbol characters."""
    g = np.random.default_rng(seed)
    shuffled = g.permuted(x[g.integers(len(x), size=n)], axis=1)
    parts = [shuffled[:n // 2]]
    for signs in (b"0123456789abcdef", b"0123456789abcdefghijklmnopqrstuvwxyz+/", b"!#$%&()*+,-./:;<=>?@[]^_{|}~ 0123456789ax"):
        pool = np.frombuffer(signs, np.uint8)
        parts.append(pool[g.integers(len(pool), size=(n // 6, WINDOW))])
        spaced = parts[-1][::2]  # every other one with blanks
        spaced[g.random(spaced.shape) < 0.12] = 32
    return np.concatenate(parts)


def train(documents: DataFrame, is_train: Column, docs_per_lang: int = DOCS_PER_LANG,
          noise: bool = False) -> ByteConvNet | None:
    """Fit on a bounded sample; ``None`` when there is no labelled text.
    ``noise``: with the class of windows that are no language."""
    docs = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")) \
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_train)
    # one row per language
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & hash_share(F.col("doc_id"), "lang", n, docs_per_lang))
    sample = docs.filter(keep).limit(2 * docs_per_lang * len(counts))

    def windows(batches):
        for b in batches:
            lang = b.column("lang").to_pylist()
            for i0, off, data in utf8_blocks(b.column("text")):
                mat, used, first = window_matrix(data, off)
                ok = has_letter(data, off)
                for r in np.flatnonzero(ok):
                    n = int(first[r + 1] - first[r])
                    pick = first[r] + np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_DOC)).astype(np.int64))
                    pick = pick[(used[pick] >= 16) | (n == 1)]
                    if len(pick):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang[i0 + r]]), pa.array([mat[pick].tobytes()])], ["lang", "w"])

    rows = sample.mapInArrow(windows, "lang string, w binary").collect()
    if not rows:
        return None
    classes = sorted({r["lang"] for r in rows})
    x = np.concatenate([np.frombuffer(r["w"], np.uint8).reshape(-1, WINDOW) for r in rows])
    y = np.concatenate([np.full(len(r["w"]) // WINDOW, classes.index(r["lang"])) for r in rows])
    order = np.lexsort((y, x[:, 1], x[:, 0], x[:, 7], x[:, 31]))  # independent of task order
    x, y = x[order], y[order]
    if noise:
        extra = noise_windows(x, max(6, len(x) // len(classes)))
        x, y = np.concatenate([x, extra]), np.concatenate([y, np.full(len(extra), len(classes))])
        classes = [*classes, NOISE]
    return ByteConvNet(classes).fit(x, y)


def predict(documents: DataFrame, model: ByteConvNet | None, key: list[Column]) -> DataFrame:
    """The ``key`` columns with lang_pred and score, one row per document."""
    cols = documents.select(*key, F.col("text").cast("string").alias("__text"))
    names = cols.columns[:-1]
    schema = cols.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in batches:
            lang = np.full(b.num_rows, UND, object)
            score = np.zeros(b.num_rows)
            if model is not None:
                for i0, off, data in utf8_blocks(b.column("__text")):
                    mat, used, first = window_matrix(data, off)
                    ok = np.flatnonzero(has_letter(data, off))
                    if not len(ok):
                        continue
                    p = np.cumsum(np.vstack([np.zeros(len(model.classes)),
                                             model.probabilities(mat) * used[:, None].astype(np.float64)]), 0)
                    p = (p[first[ok + 1]] - p[first[ok]]) / (off[ok + 1] - off[ok])[:, None]
                    best = p.argmax(1)
                    lang[i0 + ok] = np.array(model.classes, object)[best]
                    score[i0 + ok] = np.clip(p[np.arange(len(ok)), best], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(score)],
                [*names, "lang_pred", "score"])

    return cols.mapInArrow(run, schema)


def in_a_language(documents: DataFrame) -> DataFrame:
    """The rows whose text is in a language, all columns; learns from the
    non-null ``lang`` values of the rows it is given."""
    model = train(documents, F.lit(True), noise=True)
    if model is None:
        return documents.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    row = F.struct(*[documents[c] for c in documents.columns]).alias("row")
    named = predict(documents, model, [row])
    noise = (F.col("lang_pred") == NOISE) & (F.col("score") >= NOISE_SCORE) \
        & (F.octet_length(F.col("row.text").cast("string")) >= NOISE_BYTES)
    return named.filter((F.col("lang_pred") != UND) & ~noise).select("row.*")


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows
    whose fold is not 2."""
    held = fold(F.col("doc_id"), 4) == 2
    model = train(documents, ~held)
    return predict(documents, model, [F.col("doc_id"), held.alias("held_out")])
