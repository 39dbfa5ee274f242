"""Approximate nearest neighbours (largest inner product) over balanced
posting lists.

*Geometry.*  Norms are taken in logarithms, so that no finite vector over- or
underflows.  Vectors up to twice the 99th percentile of norms, scaled by that
bound into the unit ball, get one more part, ``sqrt(1 - |x|^2)``, and queries are
scaled to length one: the nearest by distance is then the one of largest inner
product.  The few longer ones (at most about a hundredth) go to lists that every
query searches.

*Index.*  Balanced cuts (two-means directions, cut at equal shares) of a
bounded sample (``SAMPLE_ROWS`` vectors, by a hash of the id) give the centroids;
a nearest-neighbour graph over them is searched best first in memory.  Every
vector goes to the list of its nearest centroid and, near a boundary, to up to
``COPIES`` lists whose centroid is at most ``1 + COPY_RATIO`` times as far.

*Search.*  A query takes the lists whose centroids are at most ``1 +
PROBE_RATIO`` times as far as its nearest, at least ``MIN_PROBES`` and at most
``PROBES_ROOT`` times the root of the number of lists, so the share of lists
searched falls as they become many, and never exceeds a constant.  Lists that
are neighbours in the tree of cuts form a shard of ``SHARD`` lists; a query is
sent once to each shard that holds a list of it and brings back one row with its
best ``k`` there.  Shards are cut into chunks of about ``CHUNK`` vectors and
queries into blocks of about ``QUERY_BLOCK``, by counts taken first, so that
neither a list of equal vectors nor a popular shard is one task's work.  Scores
are exact inner products in double precision.  Queries that were brought fewer
than ``k`` although there are more candidates search all lists.

Defined results: vectors that are null, zero, hold null or non-finite parts,
or have a null id take no part; only vectors of the commonest length do (the
shorter one on a tie); rows of one id count once, by their best score, and are
never their own neighbours; an inner product that leaves the range of doubles is
infinite; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .sampling import hash_share

K = 20
EVERY = 20
SAMPLE_ROWS = 20_000
LIST_ROWS = 16
MAX_LISTS = 4096
DEGREE = 16
COPIES = 4
COPY_RATIO = 0.08
PROBE_RATIO = 0.15
MIN_PROBES = 16
PROBES_ROOT = 6
SHARD = 64
CHUNK = 16_384
QUERY_BLOCK = 2048
#: queries scored at once within a group, and merged in one group
SLICE = 256
MERGED = 512
#: the shard of vectors longer than the bound
LONG = -1


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x array<double>, log_norm, size) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")) \
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.withColumn("most", F.array_max(F.transform("x", F.abs))).filter(F.col("most") > 0)
    rest = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / F.col("most")) * (v / F.col("most")))
    return rows.withColumn("log_norm", F.log("most") + F.log(rest) / 2).drop("most").withColumn("size", F.size("x"))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Means of ``lists`` parts of (nearly) equal size."""
    g, out, todo = np.random.default_rng(seed), [], [(np.arange(len(x)), lists)]
    while todo:
        idx, k = todo.pop()
        if k == 1 or len(idx) < 2:
            out.append(x[idx].mean(0))
            continue
        part = x[idx]
        c = part[g.choice(len(idx), 2, replace=False)]
        for _ in range(6):
            near = ((part - c[0]) ** 2).sum(1) > ((part - c[1]) ** 2).sum(1)
            if near.all() or not near.any():
                break
            c = np.stack([part[~near].mean(0), part[near].mean(0)])
        order = np.argsort(part @ (c[1] - c[0]), kind="stable")
        cut = max(1, len(idx) * (k // 2) // k)
        todo += [(idx[order[:cut]], k // 2), (idx[order[cut:]], k - k // 2)]
    return np.stack(out)


class Graph:
    """Nearest-neighbour graph over centroids with batched best-first search."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c = centroids
        n = len(centroids)
        self.sq = (centroids ** 2).sum(1)
        deg = min(degree, n - 1)
        near = np.empty((n, deg), np.int64)
        for i in range(0, n, 512):
            d = self.sq[None] - 2 * centroids[i:i + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i:i + 512] = np.argsort(d, axis=1, kind="stable")[:, :deg]
        # one random far link each keeps the graph connected and its paths short
        far = np.random.default_rng(2).permutation(n)[:, None]
        self.links = np.concatenate([near, far, np.argsort(far[:, 0])[:, None]], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, q: np.ndarray, want: int):
        """(ids, distances), nearest first, of the ``want`` best found."""
        n, b = len(self.c), len(q)
        beam = min(n, want + 16)
        rows = np.arange(b)[:, None]
        qq = (q ** 2).sum(1)[:, None]

        def dist(ids):
            return np.maximum(qq + self.sq[ids] - 2 * np.einsum("bd,bkd->bk", q, self.c[ids]), 0)

        seen = np.zeros((b, n), bool)
        ids = np.tile(self.entries, (b, 1))
        seen[rows, ids] = True
        d, open_ = dist(ids), np.ones(ids.shape, bool)
        wide = max(1, min(want // 32, len(self.entries)))  # nodes opened at once
        while True:
            ahead = np.where(open_, d, np.inf)
            best = ahead.argmin(1)[:, None] if wide == 1 else np.argpartition(ahead, wide - 1, axis=1)[:, :wide]
            live = open_[rows, best]
            if not live.any():
                break
            open_[rows, best] = False
            nxt = self.links[ids[rows, best]].reshape(b, -1)
            live = np.repeat(live, self.links.shape[1], axis=1)
            fresh = ~seen[rows, nxt] & live
            order = np.argsort(np.where(fresh, nxt, n + np.arange(nxt.shape[1])), axis=1, kind="stable")
            srt = np.take_along_axis(np.where(fresh, nxt, -1), order, 1)
            dup = np.zeros_like(fresh)  # a node may be met more than once
            np.put_along_axis(dup, order, np.concatenate(
                [np.zeros((b, 1), bool), srt[:, 1:] == srt[:, :-1]], 1), 1)
            fresh &= ~dup
            r, c = np.nonzero(fresh)
            seen[r, nxt[r, c]] = True
            ids = np.concatenate([ids, nxt], 1)
            d = np.concatenate([d, np.where(fresh, dist(nxt), np.inf)], 1)
            open_ = np.concatenate([open_, fresh], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                ids, d, open_ = ids[rows, keep], d[rows, keep], open_[rows, keep]
                open_ &= np.isfinite(d)
        order = np.argsort(d, axis=1, kind="stable")[:, :want]
        return ids[rows, order], np.sqrt(d[rows, order])


class Index:
    """``log_bound``: the logarithm of the norm that counts as one."""

    def __init__(self, sample: np.ndarray, log_bound: float, rows: int):
        self.log_bound = log_bound
        lists = max(1, min(MAX_LISTS, rows // LIST_ROWS, len(sample) // 8))
        self.graph = Graph(balanced_centroids(self.lift(sample), lists))
        self.lists = len(self.graph.c)
        self.shards = -(-self.lists // SHARD)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = _scaled(x, self.log_bound)
        rest = np.sqrt(np.maximum(1 - (x ** 2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def _choose(self, points, want, least, ratio):
        ids, d = self.graph.search(points, min(want, self.lists))
        near = (d <= d[:, :1] * (1 + ratio) + 1e-12) & np.isfinite(d)
        near[:, :least] = np.isfinite(d[:, :least])
        return ids, near

    def lists_of_vectors(self, x):
        return self._choose(self.lift(x), COPIES, 1, COPY_RATIO)

    def lists_of_queries(self, x):
        unit = x / np.abs(x).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        most = max(MIN_PROBES, int(np.ceil(PROBES_ROOT * np.sqrt(self.lists))))
        return self._choose(np.concatenate([unit, np.zeros((len(x), 1))], 1), most, MIN_PROBES, PROBE_RATIO)


def _scaled(x: np.ndarray, log_by: float) -> np.ndarray:
    """``x / exp(log_by)`` where that is outside the range of doubles, too."""
    half = np.exp(log_by / 2)
    return x / half / half


def fit(v: DataFrame, rows: int, dim: int, log_bound: float) -> Index:
    v = v.filter(F.col("log_norm") <= log_bound)
    share = v.filter(hash_share(F.col("vec_id"), "ann", rows, SAMPLE_ROWS))
    first = [F.xxhash64("vec_id"), F.col("vec_id"), F.col("x")]
    sample = share.orderBy(*first).limit(SAMPLE_ROWS).select("x").collect() or \
        v.orderBy(*first).limit(1000).select("x").collect()
    return Index(np.array([tuple(r["x"]) for r in sample]).reshape(-1, dim), log_bound, rows)


def _batches(batches, dim: int):
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            x = np.asarray(part.column("x").flatten(), dtype="<f8").reshape(-1, dim)
            yield part, x, pa.array([r.tobytes() for r in x], pa.binary())


def _postings(rows: DataFrame, index: Index, dim: int) -> DataFrame:
    """(shard, list, vec_id, x) for every list that a vector is in."""
    def run(batches):
        for part, x, raw in _batches(batches, dim):
            long = part.column("log_norm").to_numpy() > index.log_bound
            lists, use = np.full((len(x), COPIES), LONG), np.zeros((len(x), COPIES), bool)
            use[:, 0] = True
            if not long.all():
                ids, near = index.lists_of_vectors(x[~long])
                lists[~long, :ids.shape[1]] = ids
                use[np.flatnonzero(~long)[:, None], np.arange(ids.shape[1])[None]] = near
            row, col = np.nonzero(use)
            at = lists[row, col].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(at == LONG, LONG, at // SHARD).astype(np.int32)), pa.array(at),
                 part.column("vec_id").take(pa.array(row)), raw.take(pa.array(row))], ["shard", "list", "vec_id", "x"])
    return rows.select("vec_id", "x", "log_norm").mapInArrow(run, "shard int, list int, vec_id long, x binary")


def _asked(rows: DataFrame, index: Index, dim: int, everywhere: bool) -> DataFrame:
    """(shard, lists, query_id, x) for every shard that holds lists of a query;
    ``everywhere``: all lists."""
    every = [[LONG], *[list(range(s * SHARD, min((s + 1) * SHARD, index.lists))) for s in range(index.shards)]]

    def run(batches):
        for part, x, raw in _batches(batches, dim):
            row, shard, lists = [], [], []
            if everywhere:
                for i in range(len(x)):
                    row += [i] * len(every)
                    shard += range(LONG, index.shards)
                    lists += every
            else:
                ids, use = index.lists_of_queries(x)
                for i in range(len(x)):
                    own = np.sort(ids[i][use[i]])
                    cut = np.flatnonzero(np.diff(own // SHARD)) + 1
                    held = [[LONG], *[p.tolist() for p in np.split(own, cut)]]
                    row += [i] * len(held)
                    shard += [LONG, *[p[0] // SHARD for p in held[1:]]]
                    lists += held
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(lists, pa.list_(pa.int32())), part.column("vec_id").take(at),
                 raw.take(at)], ["shard", "lists", "query_id", "x"])
    return rows.select("vec_id", "x").mapInArrow(run, "shard int, lists array<int>, query_id long, x binary")


def _dealt(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("int")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        z = q @ x.T
        i, j = np.nonzero(~np.isfinite(z))
        if len(i):  # a part left the range of doubles: sum in a wider one
            z[i, j] = (q[i].astype(np.longdouble) * x[j].astype(np.longdouble)).sum(1).astype(np.float64)
    return z


def best(z: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int):
    """(row, id, score) of the ``k`` best different ids per row where ``ok``
    holds; ties to the smaller id."""
    top = np.finfo(np.float64).max
    cost = np.where(ok, np.clip(-z, -top, top), np.inf)
    n, take = z.shape[1], min(z.shape[1], COPIES * k)
    while True:
        # all that are no worse than the last one taken, so that ties are whole
        last = np.partition(cost, take - 1, axis=1)[:, take - 1, None]
        row, col = np.nonzero(ok & (cost <= last))
        order = np.lexsort((ids[col], cost[row, col], row))
        row, col = row[order], col[order]
        by_id = np.lexsort((np.arange(len(row)), ids[col], row))
        again = np.zeros(len(row), bool)
        again[by_id[1:]] = (row[by_id][1:] == row[by_id][:-1]) & (ids[col][by_id][1:] == ids[col][by_id][:-1])
        row, col = row[~again], col[~again]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        if take == n or (np.bincount(row, minlength=len(z))[ok.sum(1) > take] >= k).all():
            keep = place < k
            return row[keep], ids[col[keep]], z[row[keep], col[keep]]
        take = min(n, take * 4)


def _scorer(dim: int, k: int):
    """The best ``k`` of a chunk of a shard for every query of a block, one row a
    query."""
    names = ["query_id", "ids", "scores"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def matrix(column):
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if own.num_rows and asked.num_rows:
            own = own.combine_chunks().sort_by([("list", "ascending"), ("vec_id", "ascending")])
            x, ids, at = matrix(own["x"]), own["vec_id"].to_numpy(), own["list"].to_numpy()
            qid, q, lists = asked["query_id"].to_numpy(), matrix(asked["x"]), asked["lists"].to_pylist()
            for s in range(0, len(qid), SLICE):
                part, held = slice(s, s + SLICE), lists[s:s + SLICE]
                z, ok = np.zeros((len(held), len(ids))), np.zeros((len(held), len(ids)), bool)
                asks: dict[int, list[int]] = {}
                for i, named in enumerate(held):
                    for one in named:
                        asks.setdefault(one, []).append(i)
                for one, rows in asks.items():
                    lo, hi = np.searchsorted(at, one), np.searchsorted(at, one, side="right")
                    if lo < hi:
                        rows = np.array(rows)
                        z[rows, lo:hi] = _products(q[part][rows], x[lo:hi])
                        ok[rows, lo:hi] = True
                ok &= qid[part, None] != ids[None]
                row, vid, score = best(z, ok, ids, k)
                ends = np.searchsorted(row, np.arange(len(held) + 1))
                for i in range(len(held)):
                    if ends[i] < ends[i + 1]:
                        out[0].append(qid[s + i])
                        out[1].append(vid[ends[i]:ends[i + 1]])
                        out[2].append(score[ends[i]:ends[i + 1]])
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names)
    return run


def _merger(k: int):
    """The best ``k`` of all rows of each query, ranked."""
    def run(group: pa.Table) -> pa.Table:
        size = np.array([len(i) for i in group["ids"].combine_chunks()], np.int64)
        qid = np.repeat(group["query_id"].to_numpy(), size)
        ids, score = (group[c].combine_chunks().flatten().to_numpy() for c in ("ids", "scores"))
        order = np.lexsort((-score, ids, qid))  # an id's best score first
        qid, ids, score = qid[order], ids[order], score[order]
        new = np.ones(len(ids), bool)
        new[1:] = (qid[1:] != qid[:-1]) | (ids[1:] != ids[:-1])
        qid, ids, score = qid[new], ids[new], score[new]
        order = np.lexsort((ids, -score, qid))
        qid, ids, score = qid[order], ids[order], score[order]
        rank = np.arange(len(qid)) - np.searchsorted(qid, qid) + 1
        keep = rank <= k
        return pa.table({"query_id": qid[keep], "rank": pa.array(rank[keep], pa.int32()), "vec_id": ids[keep],
                         "score": score[keep]})
    return run


def _found(posts: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """One row per query, shard and chunk with the best ``k`` there."""
    # bounded: one row per shard
    chunks = posts.groupBy("shard").agg(_dealt(F.count(F.lit(1)), CHUNK).alias("chunks"))
    blocks = asked.groupBy("shard").agg(_dealt(F.count(F.lit(1)), QUERY_BLOCK).alias("blocks"))
    plan = F.broadcast(chunks.join(blocks, "shard"))
    left = posts.join(plan, "shard").select(
        "shard", F.pmod(F.xxhash64("vec_id", "x"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "vec_id", "x")
    right = asked.join(plan, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("query_id", "x"), F.col("blocks")).cast("int").alias("block"), "lists", "query_id", "x")
    key = ["shard", "chunk", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _scorer(dim, k), "query_id long, ids array<long>, scores array<double>")


def search(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of every row
    whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    v = vectors(embeddings)
    # one row per vector length
    sizes = v.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("log_norm", 0.99).alias("m")) \
        .orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, n, log_bound = sizes[0]["size"], sizes[0]["n"], sizes[0]["m"] + float(np.log(2))
    v = v.filter(F.col("size") == dim)
    queries = v.filter(F.pmod("vec_id", F.lit(every)) == 0)
    index = fit(v, n, dim, log_bound)
    posts = staged(_postings(v, index, dim), "postings")
    asked = staged(_asked(queries, index, dim, False), "queries")
    found = staged(_found(posts, asked, dim, k), "found")
    groups = max(1, -(-n // (every * MERGED)))

    def merged(rows):
        return staged(rows.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
                      .groupBy("part").applyInArrow(_merger(k), out), "nearest")

    nearest = merged(found)
    full = nearest.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    rest = queries.join(full, "vec_id", "left_anti")
    if rest.limit(1).count():  # too few so far: all lists
        nearest = merged(found.unionByName(_found(posts, staged(_asked(rest, index, dim, True), "queries"), dim, k)))
    return nearest
