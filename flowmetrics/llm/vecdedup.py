"""Near-duplicate embeddings through an inverted multi-index.

Vectors of one label are linked where their cosine is at least ``SIMILARITY``.

1. *Copies.*  Vectors are scaled to length one; those of equal label and equal
   unit vector are one representative with a multiplicity, so a vector that
   holds a third of all rows costs one comparison partner.
2. *Grid.*  Two codebooks, fitted to the two halves of a bounded sample
   (``SAMPLE_ROWS`` by a hash of the id), form a product grid of cells; every
   representative is listed in the cell of its two nearest centroids.
3. *Traversal.*  The distance from a vector to another cell is at least ``a`` in
   the first half and ``b`` in the second (its distances to the planes between
   centroids).  Multi-sequence traversal visits cells by ascending ``a^2 + b^2``.
   A link lies within ``reach``; its direction taken as random, the chance that
   it lies in a cell is at most the product of two normal tails, so the traversal
   ends when the chances of all cells not visited sum to ``1 - RECALL``, or when
   they are certainly out of reach.  A pair is compared if either side visits the
   other's cell, so the chance to miss one is lower still.
4. *Verification.*  Cells are cut into chunks and their visitors into blocks (by
   counts), exact cosines are taken pair by pair in a group, and what leaves a
   group is at most one row per member: its links there and its smallest partner
   reached there.  A pair counts in one group only (that of the side with the
   smaller id, or else of the side that visits).
5. Links add up by representative, times the copies; components come from
   repeated smallest labels.

Few rows give a grid of one cell, where every pair of a label is compared.

Defined results: null, zero and non-finite vectors, and those without a label,
have no links and are their own component; rows with a null id get no links and
a null component; rows of one id are one vector (smallest label, then vector)
and one result row; vectors of different lengths never link, those of another
than the commonest length are compared outside the grid; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .neardup import components
from .sampling import hash_share

SIMILARITY = 0.98
RECALL = 0.999
SAMPLE_ROWS = 20_000
#: rows of the largest label that a cell should hold
CELL_ROWS = 512
MAX_CODES = 128
CHUNK = 2048
BLOCK = 4096
#: visitors compared at once within a group
SLICE = 512
#: broadcast cell sizes up to so many rows (50 bytes)
FEW_CELLS = 100_000


# -- vectors -----------------------------------------------------------------------

def _unit(x: np.ndarray) -> np.ndarray | None:
    """``x`` at length one, without over- or underflow; None where it has none."""
    if not len(x) or not np.isfinite(x).all():
        return None
    most = np.abs(x).max()
    if most == 0:
        return None
    x = x / most
    return x / np.sqrt((x * x).sum()) + 0.0


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, fp, u, size) of every vector, written once; ``fp`` (128
    bits) identifies the unit vector ``u``, both null where it takes no part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                             F.col("embedding").cast("array<double>").alias("x"))

    def run(batches):
        for b in batches:
            label, fp, units = b.column("label").is_valid().to_pylist(), [], []
            for i, x in enumerate(b.column("x")):
                x = x.values if x.is_valid and label[i] else None
                u = None if x is None or x.null_count else _unit(np.asarray(x, np.float64))
                units.append(None if u is None else u.tobytes())
                fp.append(None if u is None else hashlib.blake2b(units[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(fp, pa.binary()), pa.array(units, pa.binary())],
                ["vec_id", "label", "fp", "u"])

    out = staged(rows.mapInArrow(run, "vec_id long, label long, fp binary, u binary")
                 .withColumn("size", F.octet_length("u") / 8).withColumn("size", F.col("size").cast("int")), "units")
    known = out.filter(F.col("vec_id").isNotNull())
    if known.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).limit(1).count():
        whole = F.struct(F.col("fp").isNull().alias("absent"), "label", "u", "fp", "size")
        one = known.groupBy("vec_id").agg(F.min(whole).alias("r")).select("vec_id", "r.label", "r.fp", "r.u", "r.size")
        out = staged(one.unionByName(out.filter(F.col("vec_id").isNull())), "units")
    return out


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


# -- the grid ------------------------------------------------------------------------

def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """``k`` centroids (fewer where points coincide)."""
    c = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:k]], axis=0)
    for _ in range(rounds if len(c) > 1 else 0):
        near = _square(x, c).argmin(1)
        for i in np.unique(near):
            c[i] = x[near == i].mean(0)
    return np.unique(c, axis=0)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def multi_sequence(a: np.ndarray, b: np.ndarray):
    """(sum, i, j) of all pairs by ascending ``a[i] + b[j]``, without forming
    them all: a heap holds the border of what has been visited."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    heap = [(sa[0] + sb[0], 0, 0)]
    while heap:
        s, p, q = heapq.heappop(heap)
        yield s, ia[p], ib[q]
        if q + 1 < len(sb):
            heapq.heappush(heap, (sa[p] + sb[q + 1], p, q + 1))
        if q == 0 and p + 1 < len(sa):
            heapq.heappush(heap, (sa[p + 1] + sb[0], p + 1, 0))


class Grid:
    def __init__(self, sample: np.ndarray, codes: int, similarity: float = SIMILARITY, recall: float = RECALL):
        size = sample.shape[1]
        self.half = (size + 1) // 2
        halves = sample[:, :self.half], sample[:, self.half:]
        self.books = [codebook(h, codes) for h in halves]
        self.apart = [np.sqrt(_square(c, c)) for c in self.books]
        self.reach2 = 2 - 2 * similarity
        self.sigma = sqrt(self.reach2 / size)
        self.miss = 1 - recall

    def margins(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half: the squared distance that each centroid's part is away at least."""
        out = []
        for h, c, apart in zip((x[:, :self.half], x[:, self.half:]), self.books, self.apart):
            d = _square(h, c)
            best = d.argmin(1)
            gap = apart[best]
            m = np.divide(d - d.min(1, keepdims=True), 2 * gap, out=np.zeros_like(d), where=gap > 0)
            out.append(m * m)
        return out

    def home(self, margins: list[np.ndarray]) -> np.ndarray:
        return margins[0].argmin(1) * len(self.books[1]) + margins[1].argmin(1)

    def visits(self, margins: list[np.ndarray], row: int) -> tuple[list[int], float]:
        """The cells that a vector visits, and the largest sum among them."""
        a, b = margins[0][row], margins[1][row]
        tail = [np.array([erfc(sqrt(v / 2) / self.sigma) / 2 for v in m.tolist()]) for m in (a, b)]
        left = tail[0].sum() * tail[1].sum()
        cells, reach, width = [], 0.0, len(b)
        for s, i, j in multi_sequence(a, b):
            if cells and s > reach and (left <= self.miss or s > self.reach2 + 1e-9):
                break
            left -= tail[0][i] * tail[1][j]
            reach = max(reach, s)
            cells.append(int(i * width + j))
        return cells, reach

    def covers(self, margins: list[np.ndarray], rows: np.ndarray, cells: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether the vector of each row visits the cell beside it."""
        i, j = np.divmod(cells, len(self.books[1]))
        return margins[0][rows, i] + margins[1][rows, j] <= reach


def fit(reps: DataFrame, rows: int, most: int, size: int) -> Grid:
    """The grid of vectors of one length; ``most``: of the largest label."""
    share = reps.filter((F.col("size") == size) & hash_share(F.col("id"), "vecdedup", rows, SAMPLE_ROWS))
    sample = share.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("u").toArrow()
    if not sample.num_rows:
        sample = reps.filter(F.col("size") == size).orderBy("id").limit(100).select("u").toArrow()
    codes = int(min(MAX_CODES, max(1, round(sqrt(most / CELL_ROWS))), max(1, sample.num_rows // 8)))
    return Grid(_matrix(sample["u"], size), codes)


# -- postings and comparison -----------------------------------------------------------

_POST = "label long, size int, cell int, id long, home int, reach double, copies long, u binary"


def _listed(reps: DataFrame, grid: Grid, size: int) -> DataFrame:
    """One row for every cell that a representative visits, its own first."""
    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                take, cell, home, reach = [], [], [], []
                sizes = part.column("size").to_numpy()
                inside = np.flatnonzero(sizes == size)
                for i in np.flatnonzero(sizes != size).tolist():
                    take, cell, home, reach = take + [i], cell + [0], home + [0], reach + [0.0]
                if len(inside):
                    m = grid.margins(_matrix(part.column("u").take(pa.array(inside)), size))
                    own = grid.home(m).tolist()
                    for k, i in enumerate(inside.tolist()):
                        cells, far = grid.visits(m, k)
                        take += [i] * len(cells)
                        cell += cells
                        home += [own[k]] * len(cells)
                        reach += [far] * len(cells)
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(at), part.column("size").take(at), pa.array(cell, pa.int32()),
                     part.column("id").take(at), pa.array(home, pa.int32()), pa.array(reach, pa.float64()),
                     part.column("copies").take(at), part.column("u").take(at)],
                    ["label", "size", "cell", "id", "home", "reach", "copies", "u"])
    return reps.select("label", "size", "id", "copies", "u").mapInArrow(run, _POST)


def _smallest_reached(link: np.ndarray, rows: np.ndarray, cols: np.ndarray):
    """Smallest id of each row's and column's connected part of ``link``."""
    r, c = rows.copy(), cols.copy()
    top = np.iinfo(np.int64).max
    while True:
        r2 = np.minimum(r, np.where(link, c[None], top).min(1, initial=top))
        c2 = np.minimum(c, np.where(link, r2[:, None], top).min(0, initial=top))
        if (r2 == r).all() and (c2 == c).all():
            return r, c
        r, c = r2, c2


def _comparer(grid: Grid, grid_size: int, similarity: float):
    """Links between a chunk of a cell's own vectors and a block of its visitors."""
    def run(own: pa.Table, visitors: pa.Table) -> pa.Table:
        names = ("id", "links", "low")
        none = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not own.num_rows or not visitors.num_rows:
            return none
        size, cell = own["size"][0].as_py(), own["cell"][0].as_py()
        p, q = _matrix(own["u"], size), _matrix(visitors["u"], size)
        pid, qid, pm, qm, phome_reach, qhome = (
            t[c].combine_chunks().to_numpy() for t, c in
            ((own, "id"), (visitors, "id"), (own, "copies"), (visitors, "copies"), (own, "reach"), (visitors, "home")))
        margins = grid.margins(p) if size == grid_size and (qhome != cell).any() else None
        links_p, links_q = np.zeros(len(pid), np.int64), np.zeros(len(qid), np.int64)
        link = np.zeros((len(qid), len(pid)), bool)
        for s in range(0, len(qid), SLICE):
            e = slice(s, s + SLICE)
            hit = (q[e] @ p.T >= similarity) & (qid[e, None] != pid[None])
            late = qid[e, None] > pid[None]
            hit &= ~(late & (qhome[e] == cell)[:, None])  # found from the other side, here
            if margins is not None:
                r, c = np.nonzero(hit & late)
                seen = grid.covers(margins, c, qhome[e][r], phome_reach[c])
                hit[r[seen], c[seen]] = False  # found from the other side, in another cell
            link[e] = hit
            links_q[e] = hit @ pm
            links_p += qm[e] @ hit
        low_q, low_p = _smallest_reached(link, qid, pid)
        ids, links, low = (np.concatenate(x) for x in ((pid, qid), (links_p, links_q), (low_p, low_q)))
        keep = links > 0
        return pa.table({n: pa.array(x[keep]) for n, x in zip(names, (ids, links, low))}) if keep.any() else none
    return run


def _parts(count, size: int):
    return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("int")


def _links(reps: DataFrame, grid: Grid, size: int, similarity: float) -> DataFrame:
    """(id, links, low) from every pair of a chunk and a block of a cell."""
    posts = staged(_listed(reps, grid, size), "postings")
    own = posts.filter(F.col("cell") == F.col("home"))
    key = ["label", "size", "cell"]
    plan = staged(posts.groupBy(*key).agg(
        _parts(F.count_if(F.col("cell") == F.col("home")), CHUNK).alias("chunks"),
        _parts(F.count(F.lit(1)), BLOCK).alias("blocks"),
        F.count_if(F.col("cell") == F.col("home")).alias("own")).filter(F.col("own") > 0).drop("own"), "cells")
    small = F.broadcast(plan) if plan.count() <= FEW_CELLS else plan
    salt = F.xxhash64("id")
    left = own.join(small, key).withColumn("chunk", F.pmod(salt, F.col("chunks")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = posts.join(small, key) \
        .withColumn("block", F.pmod(salt, F.col("blocks")).cast("int")) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # apart from the columns of left
    by = [*key, "chunk", "block"]
    return staged(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _comparer(grid, size, similarity), "id long, links long, low long"), "links")


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = unit_vectors(embeddings)
    live = rows.filter(F.col("fp").isNotNull() & F.col("vec_id").isNotNull())
    first = staged(live.groupBy("label", "fp").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "copies")
    reps = staged(live.join(first.select(F.col("id").alias("vec_id"), "copies"), "vec_id")
                  .select(F.col("vec_id").alias("id"), "label", "size", "copies", "u"), "vectors")
    per = reps.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("size").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n"), "size").limit(1).collect()
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                       F.lit(True).alias("kept"))
    if not per:
        return none.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    grid = fit(reps, per[0]["n"], per[0]["most"], per[0]["size"])
    grid.miss = 1 - recall
    found = _links(reps, grid, per[0]["size"], similarity)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.filter(F.col("id") != F.col("low")).select(F.col("low").alias("a"), F.col("id").alias("b")))
    known = staged(first.join(links, "id", "left").join(comp, "id", "left").select(
        "label", "fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("comp", "id").alias("component_id")), "known")
    out = rows.select("vec_id", "label", "fp").join(known, ["label", "fp"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
                      .cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.low AS component_id, e.vec_id = c.low AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
