"""Best-fit packing of token sequences by length patterns.

1. Every text is tokenised (Arrow batches, a bounded cache of
   white-space-separated parts) and ended with ``END_ID``; only documents
   longer than ``MAX_LEN`` are cut, into pieces of ``MAX_LEN`` tokens.
2. The piece lengths are counted: ``MAX_LEN`` rows at most reach the driver.
3. There, patterns of few documents that fill a sequence exactly are
   enumerated over the lengths that occur; non-negative least squares fits
   their repeat counts to the histogram; the counts are rounded down to what
   the histogram allows; what remains is packed best-fit decreasing, a whole
   count of equal lengths at a time.
4. The plan says, for ranges of ranks within a length, which sequence and
   offset they get.  Ranks come from windows over (length, salt) with counts of
   the groups before, so one common length is no single task.

Defined results: a null or empty text is one piece holding the end id only;
null and repeated ids keep a row per piece of every row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

MAX_LEN = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_PARTS = 400_000
MAX_PATTERNS = 60_000
#: rows that one (length, salt) window should hold, about
GROUP_ROWS = 20_000
_SALTS = 1 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: one a Python worker, which does many tasks: a tokenizer read anew for each
#: would leave a few MB behind every time
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The worker's tokenizer of a file."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class PartCache(dict):
    """Ids, as little-endian bytes, of a text part without white space.  The
    tokenizer never joins across white space, so parts can be kept.  Parts of
    ASCII and Latin-1 signs are split into the tokenizer's words here and go
    to its merge model directly, by a second cache; others go through the
    whole tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.latin = {i: "".join(_BYTE_SIGN[b] for b in chr(i).encode()) for i in range(256)}

    def __missing__(self, part: str) -> bytes:
        if (part.isascii() or max(part) <= "\xff") and "<|" not in part:
            ids = b"".join([self.words.get(w) or self._word(w) for w in _LATIN_WORDS.findall(part.lower())])
        else:
            ids = self._whole(part)
        if len(part) <= 64:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(word.translate(self.latin))], "<u4").tobytes()
        if len(word) <= 64:
            if len(self.words) >= CACHE_PARTS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        # signs that Python and the tokenizer may not both take for white
        # space, and marks that could combine, go through the tokenizer whole
        if not text.isascii() and not unicodedata.is_normalized("NFC", text) or not _ODD.isdisjoint(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_BYTE_SIGN = _byte_signs()
#: the tokenizer's words, for lower-cased ASCII and Latin-1 text
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]"
                          "|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_ODD = frozenset("\x1c\x1d\x1e\x1f\x85᠎​﻿")
_PIECE = "piece integer, start long, length integer, ids_crc32 long"


def pieces(documents: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), tokens counted with the end id."""
    path = path or tokenizer_path()
    cols = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = cols.select("doc_id").schema
    for part in _PIECE.split(", "):
        schema = schema.add(*part.split(" "))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        cache = PartCache(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                ids = cache.ids(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * max_len):
                    part = ids[at:at + 4 * max_len]
                    row.append(i)
                    piece.append(at // (4 * max_len))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cols.mapInArrow(run, schema)


# -- the plan, from the histogram of lengths -----------------------------------

def patterns(lengths: np.ndarray, weight: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Patterns of one to three of ``lengths`` that fill ``size`` exactly:
    all singles and pairs, and triples whose middle part is one of the
    commonest lengths, spread over the range, ``MAX_PATTERNS`` in all."""
    have = set(int(x) for x in lengths)
    out = [(size,)] if size in have else []
    out += [(a, size - a) for a in sorted(have) if a >= size - a and size - a in have]
    per = max(1, MAX_PATTERNS // max(1, len(have)))
    common = [int(x) for x in lengths[np.argsort(-weight, kind="stable")][:4 * per]]
    common = sorted(common)[::max(1, len(common) // per)][:per]
    for a in sorted(have, reverse=True):
        for b in common:
            c = size - a - b
            if a >= b >= c > 0 and c in have:
                out.append((a, b, c))
    return out[:MAX_PATTERNS]


def fit_counts(pats: list[tuple[int, ...]], hist: dict[int, int], steps: int = 300) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 whose use of each
    length comes closest to the histogram (accelerated projected gradient;
    each pattern touches three lengths at most, so a step is a few gathers)."""
    lengths = np.array(sorted(hist))
    pos = {int(v): i for i, v in enumerate(lengths)}
    want = np.array([hist[int(v)] for v in lengths], float)
    which = np.array([i for i, p in enumerate(pats) for _ in p])
    what = np.array([pos[v] for p in pats for v in p])
    n, m = len(pats), len(lengths)
    use = lambda x: np.bincount(what, weights=x[which], minlength=m)
    back = lambda r: np.bincount(which, weights=r[what], minlength=n)
    step = 1.0 / max(1.0, float((use(np.ones(n))).max()) * 3)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(use(y) - want))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _best_fit(left: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram; equal lengths move together.
    Returns (content runs (length, times), sequences)."""
    open_: dict[int, list] = {}
    rooms: list[int] = []
    done = []

    def put(room, content, n):
        if room == 0:
            done.append((content, n))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([content, n])

    for length in sorted(left, reverse=True):
        m = left[length]
        while m > 0:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = size // length
                full, rest = divmod(m, each)
                if full:
                    put(size - each * length, ((length, each),), full)
                if rest:
                    put(size - rest * length, ((length, rest),), 1)
                break
            room = rooms[i]
            content, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // length
            full = min(n, m // each)
            if full:
                put(room - each * length, content + ((length, each),), full)
                m -= full * each
                n -= full
            if n and 0 < m < each:
                put(room - m * length, content + ((length, m),), 1)
                n, m = n - 1, 0
            if n:
                put(room, content, n)
    return done + [(c, n) for r in open_.values() for c, n in r]


def make_plan(hist: dict[int, int], size: int = MAX_LEN) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(content runs, sequences) for the whole histogram.  Patterns that do
    not save sequences over best fit alone are left out."""
    hist = {int(k): int(v) for k, v in hist.items() if v}
    if not hist:
        return []
    lengths = np.array(sorted(hist))
    pats = patterns(lengths, np.array([hist[int(v)] for v in lengths]), size)
    left, chosen = dict(hist), []
    if pats:
        x = fit_counts(pats, hist)
        for i in np.argsort(-x, kind="stable"):
            runs_ = {v: pats[i].count(v) for v in pats[i]}
            n = min([int(x[i] + 1e-6), *(left[v] // k for v, k in runs_.items())])
            if n > 0:
                for v, k in runs_.items():
                    left[v] -= n * k
                chosen.append((tuple(runs_.items()), n))
    plan = chosen + _best_fit({k: v for k, v in left.items() if v}, size)
    plain = _best_fit(hist, size)
    return min(plan, plain, key=lambda p: sum(n for _, n in p))


def _ranges(plan) -> dict[str, np.ndarray]:
    """Rank ranges by length: arrays sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for content, n in plan:
        at = 0
        for length, times in content:
            first = used.get(length, 0)
            rows.append((length, first, times, seq, at))
            used[length] = first + times * n
            at += length * times
        seq += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "seq", "at"), a.T))


def pack(documents: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    salted = pieces(documents, path, max_len).withColumn("__salt", F.floor(F.rand(17) * _SALTS).cast("int"))
    p = staged(salted, "pieces")  # tokenised once, read three times
    hist = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = _ranges(make_plan(hist, max_len))
    groups = max(64, sum(hist.values()) // GROUP_ROWS)
    p = p.withColumn("__salt", F.col("__salt") % F.lit(groups))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = p.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("__r", F.row_number().over(inside)).join(sizes, ["length", "__salt"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("__before") + F.col("__r") - 1).alias("__rank"))
    schema = ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        bounds = {}
        for i, v in enumerate(plan["length"]):
            bounds.setdefault(int(v), [i, i])[1] = i + 1
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("__rank").to_numpy()
            seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                i, j = bounds[int(v)]
                m = np.flatnonzero(length == v)
                k = i + np.searchsorted(plan["first"][i:j], rank[m], side="right") - 1
                nth, slot = np.divmod(rank[m] - plan["first"][k], plan["times"][k])
                seq[m] = plan["seq"][k] + nth
                at[m] = plan["at"][k] + slot * v
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(at)], schema.names)

    return ranked.mapInArrow(place, schema)
