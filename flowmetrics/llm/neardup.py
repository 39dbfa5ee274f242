"""Near-duplicates by Order MinHash with banded alignment.

A text is the sequence of its words (``common.WORD``, A-Z lowered).  Two texts are
linked if ``1 - d / max(n1, n2) >= 0.8``, where ``d`` is the least number of words
to change, add or drop to make one of the other.

1. Texts with the same words are collapsed by hash: one representative each.
2. Order MinHash: a text's five-word shingles (one to four words: one shingle)
   are labelled with their occurrence number.  For each of ``SINGLES`` hash
   functions the smallest labels are taken and kept *in text order*; hashed,
   they are one sketch: 2 labels below ``SHORT`` shingles, 3 above, both near the
   border.  The share of shingles that two texts have in common, ``j``, falls
   with the fifth power of the words they share: with words changed at random,
   ``j`` is 0.42 at a similarity of 0.9 and 0.2 at 0.8, where a pair shares a
   sketch with a probability of 1.00 and 0.92 (short), 0.99 and 0.38 (long); a
   copy is linked through any one member of its group.
3. Each bucket of equal sketches has two hubs, its text of smallest id and one
   drawn by hash.  A text is paired with one hub only, the one that most of its
   buckets have; pairs whose single minima disagree too much are skipped (kept
   with a probability above 0.95 at ``j = 0.2``, 0.9999 at 0.42), the others
   verified by alignment; linked texts are joined by repeated minimum labels.
   This is done ``STARS`` times, after the first time with hubs of other
   components only, one pair for two components; so the pairs of a round are no
   more than the texts, however many buckets a group of near copies shares.
4. All pairs of texts that share a bucket but are not yet joined are compared:
   in buckets of up to ``FULL`` texts as rows of pairs, in larger ones in pairs of
   blocks, one group each, where only the links found become rows.  A pair of
   texts is compared in the first bucket that both have; texts of the component
   that most of a bucket belongs to meet the other texts only.

Alignment: words in common (with their counts) bound ``d`` from below and rule most
pairs out.  Shingles in common, in order and within the band of diagonals that the
similarity allows, anchor the texts on each other; only the words between anchors
are aligned, which bounds ``d`` from above.  What neither bound decides takes the
exact alignment within the band.

Defined results: null texts and texts without words link to nothing, their
class is their own id; rows with a null id get a null class and take no part;
rows of one id are documents of their own, each with the class of its own text; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, staged, utf8_blocks, word_hashes

K = 5
SIMILARITY = 0.8
SHORT = 64
#: labels in a sketch below and from SHORT shingles
TAKE = (2, 3)
#: hash functions: sketches of a text, and single minima
SINGLES = 64
#: equal single minima that a pair must have to be verified
LEAST_EQUAL = 8
#: words between anchors are aligned up to so many comparisons a gap
GAP = 1 << 18
#: up to so many comparisons without arrays
SHORT_GAP = 100
DRAWS = 8
#: rounds of pairs with hubs
STARS = 2
#: buckets of more texts are compared in blocks of about so many texts or labels
FULL = 16
BLOCK = 256
BLOCK_LABELS = 200_000
#: broadcast a join side up to so many labels (16 bytes), texts' minima (300
#: bytes) or signs of text; larger ones are shuffled
FEW_LABELS = 200_000
FEW_MINIMA = 20_000
FEW_SIGNS = 8_000_000


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes made different by their occurrence numbers."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    first = np.flatnonzero(new)
    occurrence = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = np.empty_like(h)
    out[order] = np.where(occurrence > 0, mix(s + occurrence.astype(np.uint64)), s)
    return out


def shingle_labels(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled hashes of a text's shingles, in order."""
    n = len(words)
    if n == 0:
        return words
    k = min(K, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(31) + words[j:n - k + 1 + j] + np.uint64(j + 1))
    return labelled(h)


_LAST = np.uint64(2 ** 64 - 1)
_ODD = np.random.default_rng(200).integers(1, 2 ** 63, SINGLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ranks(labels: np.ndarray, odd: np.ndarray) -> np.ndarray:
    z = labels[None, :] * odd[:, None]
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def kinds_of(shingles: int) -> list[int]:
    """Which kinds of sketches (places in ``TAKE``) a text has."""
    return [c for c, has in enumerate((shingles * SIMILARITY < SHORT, shingles >= SHORT * SIMILARITY)) if has]


def sketches(labels: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Order MinHash sketches of one text, as signed 64-bit bucket keys, and its
    single minima."""
    n = len(labels)
    kinds = kinds_of(n)
    keys, small = [[] for _ in kinds], []
    step = max(1, (1 << 20) // n)
    for i in range(0, SINGLES, step):
        odd = _ODD[i:i + step]
        z = _ranks(labels, odd)
        # the smallest, one after the other: a few passes cost less than a partial sort
        each = np.arange(len(odd))
        near = np.empty((len(odd), min(TAKE[kinds[-1]], n)), np.int64)
        for j in range(near.shape[1]):
            near[:, j] = z.argmin(axis=1)
            if j == 0:
                small.append(z[each, near[:, 0]])
            z[each, near[:, j]] = _LAST
        for out, c in zip(keys, kinds):
            here = np.sort(near[:, :TAKE[c]], axis=1)  # text order
            key = np.arange(i, i + len(odd), dtype=np.uint64) + np.uint64(1000 * c + 1)
            for j in range(here.shape[1]):
                key = mix(key * np.uint64(31) + labels[here[:, j]])
            out.extend(key.view(np.int64).tolist())
    return [k for out in keys for k in out], np.concatenate(small).astype(np.uint32)


# -- alignment -------------------------------------------------------------------

def edit_distance(x: np.ndarray, y: np.ndarray, limit: int) -> int:
    """Words to change, add or drop; beyond ``limit``: any number above it.
    Row by row within the band of ``limit`` diagonals on either side."""
    n, m = len(x), len(y)
    if abs(n - m) > limit:
        return limit + 1
    if n and m and x[0] == y[0]:  # a common start costs nothing
        same = x[:min(n, m)] == y[:min(n, m)]
        k = len(same) if same.all() else int(same.argmin())
        return edit_distance(x[k:], y[k:], limit)
    if not n or not m:
        return max(n, m)
    place = np.arange(m + 1)
    above, row = place.copy(), np.empty(m + 1, np.int64)
    for i in range(1, n + 1):
        lo, hi = max(1, i - limit), min(m, i + limit)
        best = np.empty(hi - lo + 2, np.int64)
        best[0] = i if lo == 1 else limit + 1
        best[1:] = np.minimum(above[lo - 1:hi] + (y[lo - 1:hi] != x[i - 1]), above[lo:hi + 1] + 1)
        here = place[lo - 1:hi + 1]
        best = np.minimum.accumulate(best - here) + here
        if best.min() > limit:
            return limit + 1
        row[lo - 1:hi + 1] = best
        if hi < m:
            row[hi + 1] = limit + 1
        above, row = row, above
    return int(above[m])


def anchors(la: np.ndarray, lb: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of common labels in both texts: the most that keep their order,
    within the band."""
    order = np.argsort(lb)
    at = np.searchsorted(lb, la, sorter=order)
    at[at == len(lb)] = 0
    j = order[at]
    i = np.flatnonzero((lb[j] == la) & (np.abs(j - np.arange(len(la))) <= band))
    j = j[i]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []   # longest increasing run, with the way back
    ends: list[int] = []
    back = np.full(len(j), -1)
    for k, x in enumerate(j.tolist()):
        p = bisect_left(tails, x)
        back[k] = ends[p - 1] if p else -1
        tails[p:p + 1] = [x]
        ends[p:p + 1] = [k]
    run, k = [], ends[-1]
    while k >= 0:
        run.append(k)
        k = back[k]
    run = np.array(run[::-1])
    return i[run], j[run]


def anchored_distance(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, limit: int) -> int:
    """A bound of the edit distance from above: the words between anchors,
    aligned, and beyond ``limit`` any number above it."""
    i, j = anchors(la, lb, limit)
    if not len(i):
        return max(len(a), len(b))
    span = min(K, len(a), len(b))
    # anchors that go on from the one before need nothing
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    total, ea, eb = 0, 0, 0
    for s, e in zip(first.tolist(), last.tolist()):
        shift = max(ea - i[s], eb - j[s], 0)  # what the run before has covered
        if i[e] + span - (i[s] + shift) <= 0:
            continue
        total += _gap(a[ea:i[s] + shift], b[eb:j[s] + shift], limit - total)
        if total > limit:
            return total
        ea, eb = i[e] + span, j[e] + span
    return total + _gap(a[ea:], b[eb:], limit - total)


def _short_distance(x: list, y: list) -> int:
    """Edit distance of a few words, where whole rows of an array do not pay."""
    row = list(range(len(y) + 1))
    for i, v in enumerate(x, 1):
        across, row[0] = row[0], i
        for j, w in enumerate(y, 1):
            across, row[j] = row[j], min(across + (v != w), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _gap(x: np.ndarray, y: np.ndarray, limit: int) -> int:
    n, m = len(x), len(y)
    if min(n, m) == 0 or max(n, m) == 1 or n * m > GAP or limit < 0:
        return max(n, m)
    if n * m <= SHORT_GAP:
        return _short_distance(x.tolist(), y.tolist())
    return edit_distance(x, y, max(limit, 0))


def linked(a: np.ndarray, b: np.ndarray, labels=None, similarity: float = SIMILARITY, bags=None) -> bool:
    """Whether two texts, as word hashes, are alike; ``labels``: their shingles',
    ``bags``: their words', where already known."""
    n = max(len(a), len(b))
    limit = int((1 - similarity) * n + 1e-9)
    if min(len(a), len(b)) < max(1, n - limit):
        return False
    wa, wb = bags if bags is not None else (labelled(a), labelled(b))
    if len(np.intersect1d(wa, wb, assume_unique=True)) < n - limit:
        return False
    la, lb = labels if labels is not None else (shingle_labels(a), shingle_labels(b))
    return anchored_distance(a, b, la, lb, limit) <= limit or edit_distance(a, b, limit) <= limit


def _words_of(column):
    """(row, words, shingle labels) of every text."""
    for i0, off, data in utf8_blocks(column):
        words, before = word_hashes(data, off)
        for r in range(len(off) - 1):
            w = words[before[r]:before[r + 1]]
            yield i0 + r, w, shingle_labels(w)


def _sketch_table(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, n, keys, minima) of every row; fp identifies the word
    sequence (128 bits, null without words), n counts its words."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "fp", "n", "keys", "minima"]

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                fp, n, keys, small = [], [], [], []
                for i0, off, data in utf8_blocks(part.column("text")):
                    words, before = word_hashes(data, off)
                    for r in range(len(off) - 1):
                        w = words[before[r]:before[r + 1]]
                        n.append(len(w))
                        if len(w):
                            fp.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                            own, least = sketches(shingle_labels(w))
                            keys.append(own)
                            small.append(least.view(np.int32))
                        else:
                            fp.append(None)
                            keys.append([])
                            small.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(fp, pa.binary()), pa.array(n, pa.int32()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int32()))], names)

    return docs.mapInArrow(run, "doc_id long, fp binary, n int, keys array<long>, minima array<int>")


def _side(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """A join side of known size: broadcast up to ``bound`` rows, else shuffled."""
    return F.broadcast(df) if rows <= bound else df


def _likely(pairs: DataFrame, reps: DataFrame, rows: int) -> DataFrame:
    """The (a, b) pairs whose lengths allow a link and whose single minima
    agree often enough."""
    def side(x):
        return _side(reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("minima").alias(f"m{x}")),
                     rows, FEW_MINIMA)

    both = pairs.join(side("a"), "a").join(side("b"), "b") \
        .filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")).select("a", "b", "ma", "mb")

    def run(batches):
        for b in batches:
            flat = [np.asarray(b.column(c).flatten()).reshape(-1, SINGLES) for c in ("ma", "mb")]
            ok = (flat[0] == flat[1]).sum(1) >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The linked ones of distinct (a, b) pairs of representatives; ``size``:
    signs of all texts."""
    def side(x):
        return _side(texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")), size, FEW_SIGNS)

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                known = {}  # a hub stands in many pairs
                for ids, column in (("a", "ta"), ("b", "tb")):
                    ids, at = np.unique(part.column(ids).to_numpy(), return_index=True)
                    new = np.array([i not in known for i in ids.tolist()], bool)
                    for i, words, labels in _words_of(part.column(column).take(pa.array(at[new]))):
                        known[int(ids[new][i])] = words, labels, labelled(words)
                ok = []
                for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                    x, y = known[x], known[y]
                    ok.append(linked(x[0], y[0], (x[1], y[1]), bags=(x[2], y[2])))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each connected component, for the ids
    that have an edge.  Each round takes the smallest label among neighbours,
    then the label of the label; ends when no label changes."""
    ways = F.array(*(F.struct(F.col(x).alias("id"), F.col(y).alias("to")) for x, y in ("ab", "ba")))
    both = staged(edges.select(F.explode(ways).alias("e")).select("e.id", "e.to").distinct(), "edges")
    label = staged(both.groupBy("id").agg(F.min("to").alias("low"))
                   .select("id", F.least("low", "id").alias("comp")), "labels")
    n = label.count()
    while True:  # labels only fall, so it ends
        of = _side(label.select(F.col("id").alias("to"), F.col("comp").alias("near")), n, FEW_LABELS)
        low = both.join(of, "to").groupBy("id").agg(F.min("near").alias("low"))
        one = low.join(_side(label, n, FEW_LABELS), "id").select("id", "comp", F.least("comp", "low").alias("new"))
        jump = _side(label.select(F.col("id").alias("new"), F.col("comp").alias("next")), n, FEW_LABELS)
        nxt = staged(one.join(jump, "new").select(
            "id", F.least("new", "next").alias("comp"), F.col("comp").alias("was")), "labels")
        label = nxt.select("id", "comp")
        if not nxt.filter(F.col("comp") != F.col("was")).count():
            return label


def _joined(comp: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """The components (id, comp) of all texts after more links (a, b): labels
    are repeated between components, not between texts."""
    def of(x):
        return _side(comp.select(F.col("id").alias(x), F.col("comp").alias(f"{x}_comp")), rows, FEW_LABELS)

    edges = links.join(of("a"), "a").join(of("b"), "b") \
        .select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).filter(F.col("a") != F.col("b"))
    low = components(edges).select(F.col("id").alias("comp"), F.col("comp").alias("low"))
    return staged(comp.join(low, "comp", "left").select("id", F.coalesce("low", "comp").alias("comp")), "components")


def _hub_pairs(held: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: each text of the buckets' members (key, id, comp) with the
    hub of another component, not tried before, that most of its buckets have;
    of two components one pair, that of most buckets."""
    # two hubs a bucket: the smallest id, and one drawn by hash; buckets of one
    # draw group that share many texts mostly agree on it
    drawn = F.min(F.struct(F.xxhash64("id", F.pmod("key", F.lit(DRAWS))).alias("d"), "id", "comp"))
    hubs = held.groupBy("key").agg(F.min(F.struct("id", "comp")).alias("hub"), drawn.alias("d")) \
        .select("key", F.array("hub", F.struct("d.id", "d.comp")).alias("hubs"))
    pairs = held.join(hubs, "key").select("id", "comp", F.explode("hubs").alias("to")) \
        .select("id", "comp", F.col("to.id").alias("to"), F.col("to.comp").alias("to_comp")) \
        .filter(F.col("comp") != F.col("to_comp")).groupBy("id", "comp", "to", "to_comp").agg(F.count(F.lit(1)).alias("c"))
    if tried is not None:
        pairs = pairs.withColumn("a", F.least("id", "to")).withColumn("b", F.greatest("id", "to")) \
            .join(tried, ["a", "b"], "left_anti")
    best = pairs.groupBy("id", "comp").agg(F.max(F.struct("c", (-F.col("to")).alias("less"), "to", "to_comp")).alias("x"))
    a, b = F.least("id", "x.to"), F.greatest("id", "x.to")
    of_two = [F.least("comp", "x.to_comp").alias("p"), F.greatest("comp", "x.to_comp").alias("q")]
    return best.select(*of_two, F.struct("x.c", (-a).alias("less"), (-b).alias("less_b"), a.alias("a"), b.alias("b")).alias("y")) \
        .groupBy("p", "q").agg(F.max("y").alias("y")).select("y.a", "y.b")


def _small_pairs(held: DataFrame) -> DataFrame:
    """(a, b), a < b, of all members (key, id, comp) of a bucket that are of
    different components."""
    def named(x):
        return held.select("key", F.col("id").alias(x), F.col("comp").alias(f"{x}_comp"))

    return named("a").join(named("b"), "key").filter((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp"))) \
        .select("a", "b").distinct()


def _aligned(keys, words) -> np.ndarray:
    """Bucket keys of each text, one column a sketch; 0 where it has none."""
    out = np.zeros((len(keys), len(TAKE) * SINGLES), np.int64)
    for i, (k, n) in enumerate(zip(keys, words.tolist())):
        kinds = kinds_of(max(1, n - K + 1))
        out[i, kinds[0] * SINGLES:][:len(k.values)] = np.asarray(k.values)
    return out


def _block_links(group: pa.Table) -> pa.Table:
    """Links that join components, of all pairs of texts between the two blocks
    of a group (within the block, if it is one)."""
    group = group.combine_chunks()
    block = group["block"].to_numpy()
    ids, comp, n = (group[c].to_numpy() for c in ("id", "comp", "n"))
    minima = np.array([m.values.to_numpy() for m in group["minima"]])
    keys = _aligned(group["keys"], n)
    at = int(np.flatnonzero(keys[0] == group["key"][0].as_py())[0])
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    equal = np.zeros((len(left), len(right)), np.uint8)
    for j in range(SINGLES):
        equal += minima[left, j][:, None] == minima[right, j][None, :]
    na, nb = n[left][:, None], n[right][None, :]
    ok = (equal >= LEAST_EQUAL) & (comp[left][:, None] != comp[right][None, :]) \
        & (np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb))
    for j in range(at):  # compared in an earlier bucket
        x, y = keys[left, j][:, None], keys[right, j][None, :]
        ok &= (x != y) | (x == 0)
    parent = {c: c for c in comp.tolist()}

    def top(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    texts, known, out = group["text"], {}, []

    def of(i):
        if i not in known:
            known[i] = next(_words_of(texts.slice(i, 1).combine_chunks()))[1:]
        return known[i]

    for x, y in zip(*(z.tolist() for z in np.nonzero(ok))):
        x, y = int(left[x]), int(right[y])
        p, q = top(int(comp[x])), top(int(comp[y]))
        if p != q and linked(of(x)[0], of(y)[0], (of(x)[1], of(y)[1])):
            parent[p] = q
            out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("a", "b"))})


def _large_links(held: DataFrame, small: DataFrame, texts: DataFrame, rows: int, size: int) -> DataFrame:
    """The links between components of the large buckets' members (key, id,
    comp, main, n, m_main, m_rest, l_main, l_rest: the largest component, and
    texts and labels in it and outside)."""
    def blocks(x):
        return F.greatest(F.ceil(F.col(f"m_{x}") / BLOCK), F.ceil(F.col(f"l_{x}") / BLOCK_LABELS))

    in_main = F.col("comp") == F.col("main")
    salt = F.xxhash64("id", "key")
    m = held.withColumn("n_rest", blocks("rest")).withColumn("n_main", blocks("main")) \
        .withColumn("block", F.when(in_main, F.col("n_rest") + F.pmod(salt, F.col("n_main")))
                    .otherwise(F.pmod(salt, F.col("n_rest")))) \
        .withColumn("width", F.col("n_rest") + F.when(in_main, 0).otherwise(F.col("n_main")))
    # each text once for every block that its own meets
    m = m.select("key", "id", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("other")) \
        .select("key", "id", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    m = m.join(_side(small, rows, FEW_MINIMA), "id").join(_side(texts, size, FEW_SIGNS), "id")
    return m.select("key", "p", "q", "block", "id", "comp", "n", "minima", "keys", "text") \
        .groupBy("key", "p", "q").applyInArrow(_block_links, "a long, b long").distinct()


def classes(documents: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row."""
    if not _several(documents.filter(F.col("doc_id").isNotNull())):
        return _classes(documents)
    by_row = _row_classes(documents)
    low = by_row.groupBy("class_row").agg(F.min("doc_id").alias("class_id"))
    return by_row.join(low, "class_row", "left").select("doc_id", "class_id")


def _numbered(documents: DataFrame) -> DataFrame:
    """The documents with a number of their own, written once."""
    return staged(documents.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _row_classes(documents: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, class_row): classes of rows, whatever ids they have; rows
    with a null id have none."""
    rows = _numbered(documents.select("doc_id", "text")) if numbered is None else numbered
    named = F.when(F.col("doc_id").isNotNull(), F.col("__row"))
    cls = _classes(rows.select(named.alias("doc_id"), "text"))
    ids = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(cls.select(F.col("doc_id").alias("row"), F.col("class_id").alias("class_row")), "row", "left")


def _classes(documents: DataFrame) -> DataFrame:
    """:func:`classes` of documents whose ids are all different (or null)."""
    rows = staged(_sketch_table(documents), "sketches")
    live = rows.filter(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    first = staged(live.groupBy("fp").agg(F.min("doc_id").alias("id")), "texts")
    reps = live.join(first.withColumnRenamed("fp", "fp_"), (F.col("doc_id") == F.col("id")) & (F.col("fp") == F.col("fp_"))) \
        .select("id", "n", "keys", "minima")
    members = reps.select("id", F.explode("keys").alias("key"))
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1).select("key")
    shared = staged(members.join(several, "key").select("key", "id"), "buckets")
    some = staged(shared.select("id").distinct(), "ids")
    n_some = some.count()
    some = _side(some, n_some, FEW_LABELS)
    small = staged(reps.select("id", "n", "minima", "keys").join(some, "id"), "minima")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(some, "id")
    texts = staged(texts, "some")
    size = texts.agg(F.sum(F.length("text")).alias("s")).first()["s"] or 0

    comp = staged(small.select("id", F.col("id").alias("comp")), "components")
    held, tried = shared.withColumn("comp", F.col("id")), None
    for _ in range(STARS):
        star = staged(_hub_pairs(held, tried), "stars")
        links = staged(_verify(_likely(star, small, n_some), texts, size), "links")
        if not links.count():
            break
        comp = _joined(comp, links, n_some)
        held = shared.join(_side(comp, n_some, FEW_LABELS), "id").select("key", "id", "comp")
        tried = star if tried is None else tried.union(star)
    # texts that share a bucket but no component yet
    per = held.join(_side(small.select("id", "n"), n_some, FEW_LABELS), "id").groupBy("key", "comp") \
        .agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("l"))
    mixed = per.groupBy("key").agg(
        F.max(F.struct("c", "l", "comp")).alias("x"), F.count(F.lit(1)).alias("comps"),
        F.sum("c").alias("c"), F.sum("l").alias("l")).filter(F.col("comps") > 1) \
        .select("key", F.col("x.comp").alias("main"), F.col("c").alias("size"), F.col("x.c").alias("m_main"),
                F.col("x.l").alias("l_main"), (F.col("c") - F.col("x.c")).alias("m_rest"), (F.col("l") - F.col("x.l")).alias("l_rest"))
    held = staged(held.join(mixed, "key"), "mixed")
    pairs = _small_pairs(held.filter(F.col("size") <= FULL).select("key", "id", "comp"))
    more = staged(_verify(_likely(pairs, small, n_some), texts, size).union(
        _large_links(held.filter(F.col("size") > FULL), small, texts, n_some, size)), "links")
    if more.count():
        comp = _joined(comp, more, n_some)
    cls = staged(first.join(comp, "id", "left").select("fp", F.coalesce("comp", "id").alias("class_id")), "classes")
    known = rows.select("doc_id", "fp").join(cls, "fp", "left")
    return known.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def _several(documents: DataFrame) -> bool:
    """Whether any id stands on several rows."""
    most = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("m")).first()["m"]
    return (most or 0) > 1


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents (all columns) but for one of each class only, the one of
    smallest id (of one id: the first); rows with a null id stay.  Where ids
    repeat, a row goes for its own text only, never for another row's."""
    if not _several(documents.filter(F.col("doc_id").isNotNull())):
        cls = _classes(documents.select("doc_id", "text"))
        gone = cls.filter(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone"))
        return documents.join(gone, documents["doc_id"] == F.col("__gone"), "left_anti")
    rows = _numbered(documents)
    by_row = _row_classes(documents, rows).filter(F.col("doc_id").isNotNull())
    first = by_row.groupBy("class_row").agg(F.min(F.struct("doc_id", "row")).alias("f")).select(F.col("f.row").alias("__kept"))
    kept = rows.filter(F.col("doc_id").isNotNull()).join(first, rows["__row"] == F.col("__kept"), "left_semi")
    return kept.unionByName(rows.filter(F.col("doc_id").isNull())).drop("__row")
