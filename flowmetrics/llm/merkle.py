"""Merkle manifest of a document table, kept as a postorder append log.

*Tree.*  Every row is a leaf (SHA-256 of its five fields).  Per ``lang`` the
leaves ascend by id; while several nodes remain, every ``ARITY`` consecutive
ones become the hash of their hex digests.  The subroots, ordered by ``lang``
(null first, bytewise), give the root in the same way.

*Builders.*  A tree is cut at multiples of ``SPAN`` = 8^4 leaves.  One builder
takes one such aligned block, appends its leaves in order and every inner node
as soon as its last child stands, so the block's log is in completion order,
which is postorder, and its last entry is the block's root.  The block roots are
the leaves of the next round, so n leaves take log_4096(n) rounds, and no
builder holds more than ``SPAN`` rows, whatever share of them one language has.

*Addresses.*  A node's place in the log follows from subtree sizes alone
(:func:`position`), so siblings are read from the log by arithmetic: no node
table is joined.  Proofs are taken top down: each round hands its nodes the
siblings above them, and the last one writes a row per leaf.

*Order.*  Ranks come from a range sort: ids that ascend within each sorted part,
shifted by the rows of the language in earlier parts (one counted row per part
and language).  Equal keys are told apart by digest and place in the input, so a
repeated id never lands in one part only.

Defined results: a null field is ``-``; null ids come first in their language
and are never tampered with; rows of one id are leaves of their own, ordered by
digest; a language of one row has its leaf as subroot, a table of one language
its subroot as root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

ARITY = 8
HEIGHT = 4
#: leaves of a builder's block
SPAN = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: broadcast sorted parts (30 bytes and the language) or sibling paths (at most
#: 10 KB) up to so many rows; beyond it they are shuffled
FEW_PARTS = 20_000
FEW_PATHS = 2_000
#: forge a third of the rows, by crc32 of the id
FORGED_EVERY = 3

_LOG = "tree string, block long, total long, n int, log binary"
_OUT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean")


# -- one block -----------------------------------------------------------------

def height_of(total: int) -> int:
    """Levels that a block of a tree of ``total`` leaves has above its leaves."""
    h = 0
    while h < HEIGHT and ARITY ** h < total:
        h += 1
    return h


def append_log(leaves: list[bytes], height: int) -> bytes:
    """Digests of the block's nodes in completion order."""
    log = bytearray()
    waiting: list[list[str]] = [[] for _ in range(height + 1)]

    def add(level: int, digest: bytes) -> None:
        log.extend(digest)
        waiting[level].append(digest.hex())
        if level < height and len(waiting[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run = "".join(waiting[level])
        waiting[level].clear()
        add(level + 1, hashlib.sha256(run.encode()).digest())

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):  # the last runs, short ones
        if waiting[level]:
            close(level)
    return bytes(log)


def width(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // ARITY ** level)


def position(n: int, height: int, level: int, index: int) -> int:
    """Place in the log of node ``index`` of a level: what stands below it, it
    included, and the higher nodes that were complete before it."""
    below = sum(min((index + 1) * ARITY ** (level - m), width(n, m)) for m in range(level + 1))
    return below - 1 + sum(index // ARITY ** (m - level) for m in range(level + 1, height + 1))


def sides(log: bytes, n: int, height: int) -> list[list[tuple[str, str]]]:
    """Per level, per node: hex of the siblings left and right of it, joined."""
    text = log.hex()
    out = []
    for level in range(height):
        nodes, count = [], width(n, level)
        for first in range(0, count, ARITY):
            at = (position(n, height, level, i) * 64 for i in range(first, min(first + ARITY, count)))
            run = [text[p:p + 64] for p in at]
            nodes += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        out.append(nodes)
    return out


def path(levels: list[list[tuple[str, str]]], leaf: int) -> list[tuple[str, str]]:
    """Siblings of a leaf of the block, level by level."""
    return [nodes[leaf // ARITY ** level] for level, nodes in enumerate(levels)]


def fold(leaf: str, siblings: list[tuple[str, str]]) -> str:
    for left, right in siblings:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def proof_digest(siblings: list[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for left, right in siblings:
        h.update(left.encode())
        h.update(right.encode())
    return h.hexdigest()


# -- leaves and ranks ------------------------------------------------------------

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]).cast("binary"), 256))


def tampered(doc_id: Column) -> Column:
    """Whether a row's text is forged."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(FORGED_EVERY) == 0, F.lit(False))


def leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, forged): ``tree`` orders as ``lang`` does, null
    first; ``forged`` is the leaf of the tampered row, else the leaf itself."""
    cols = [F.col(c) for c in FIELDS]
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    rows = documents.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), _digest(cols).alias("digest"),
        F.when(tampered(F.col("doc_id")), _digest([*cols[:-1], low])).alias("other"))
    return rows.select("tree", "doc_id", "digest", F.coalesce("other", "digest").alias("forged"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within their ``tree`` by ``order`` and the
    tree's ``total``.  ``rows`` must be a written table."""
    key = ["tree", *order]
    seq = F.monotonically_increasing_id()
    parts = staged(rows.withColumn("tie", seq).repartitionByRange(*key, "tie")
                   .sortWithinPartitions(*key, "tie").drop("tie").withColumn("seq", seq), "sorted")
    part = F.shiftright("seq", 33)
    per = parts.groupBy("tree", part.alias("part")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")
    before = F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = staged(per.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(tree).alias("total")), "parts")
    small = F.broadcast(per) if per.count() <= FEW_PARTS else per
    return parts.withColumn("part", part).join(small, ["tree", "part"]) \
        .withColumn("rank", F.col("seq") + F.col("shift")).drop("seq", "part", "shift")


# -- rounds ----------------------------------------------------------------------

def _built(nodes: DataFrame, carry: dict[str, str]) -> DataFrame:
    """One log row per aligned block of (tree, rank, total, digest); ``carry``:
    columns kept as arrays in leaf order, with their types."""
    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rank")
        total, digests = group["total"][0].as_py(), group["digest"].to_pylist()
        log = append_log(digests, height_of(total))
        out = {"tree": group["tree"][:1], "block": group["block"][:1], "total": group["total"][:1],
               "n": pa.array([len(digests)], pa.int32()), "log": pa.array([log], pa.binary())}
        for c in carry:
            out[c] = pa.array([group[c].to_pylist()], pa.list_(group.schema.field(c).type))
        return pa.table(out)

    block = nodes.withColumn("block", F.floor(F.col("rank") / SPAN).cast("long")) \
        .select("tree", "block", "rank", "total", "digest", *carry)
    kinds = "".join(f", {c} array<{t}>" for c, t in carry.items())
    return staged(block.groupBy("tree", "block").applyInArrow(build, _LOG + kinds), "log")


def _last(log: str) -> Column:
    return F.expr(f"substring({log}, octet_length({log}) - 31, 32)")


def forest(nodes: DataFrame, carry: dict[str, str]) -> list[DataFrame]:
    """The logs of all rounds, lowest first."""
    logs = [_built(nodes, carry)]
    most = logs[0].agg(F.max("total").alias("m")).first()["m"] or 0
    while most > SPAN:
        most = -(-most // SPAN)
        up = logs[-1].filter(F.col("total") > SPAN).select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("total") / SPAN).cast("long").alias("total"),
            _last("log").alias("digest"))
        logs.append(_built(up, {}))
    return logs


def roots(logs: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's root."""
    out = None
    for log in logs:
        top = log.filter(F.col("total") <= SPAN).select("tree", _last("log").alias("digest"))
        out = top if out is None else out.unionByName(top)
    return out


def _rows(batch):
    """Its rows, one at a time: a log row holds a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _with_paths(log: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """The log rows with ``up`` (left and right siblings of the block's root,
    level by level, alternating), ``subroot`` and ``root``.  ``tops``: those of
    the trees' roots; ``above``: those of the nodes of the next round."""
    one = log.filter(F.col("total") <= SPAN).select("tree", "block").join(tops, "tree")
    paths = staged(one if above is None else one.unionByName(above), "paths")
    return log.join(F.broadcast(paths) if paths.count() <= FEW_PATHS else paths, ["tree", "block"])


def _inner_paths(log: DataFrame) -> DataFrame:
    """(tree, block, up, subroot, root) of every node of an upper round: the
    blocks of the round below."""
    def run(batches):
        for b in batches:
            for r in _rows(b):
                levels = sides(r["log"], r["n"], height_of(r["total"]))
                ups = [[s for pair in path(levels, i) for s in pair] + r["up"] for i in range(r["n"])]
                first = r["block"] * SPAN
                yield pa.RecordBatch.from_pydict({
                    "tree": [r["tree"]] * r["n"], "block": range(first, first + r["n"]), "up": ups,
                    "subroot": [r["subroot"]] * r["n"], "root": [r["root"]] * r["n"]},
                    schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("up", pa.list_(pa.string())),
                                      ("subroot", pa.string()), ("root", pa.string())]))
    return log.mapInArrow(run, "tree string, block long, up array<string>, subroot string, root string")


def _paths(logs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest round's logs with the siblings above each block."""
    above = None
    for log in reversed(logs[1:]):
        above = _inner_paths(_with_paths(log, above, tops))
    return _with_paths(logs[0], above, tops)


def _tops(subroots: DataFrame) -> DataFrame:
    """(tree, up, subroot, root) of every language."""
    table = staged(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("named"), "digest"), "subroots")
    logs = forest(ranked(table, ["named"]), {"named": "string"})
    root = roots(logs).select("tree", F.array().cast("array<string>").alias("up"), F.lit("").alias("subroot"),
                              F.lower(F.hex("digest")).alias("root"))

    def run(batches):
        for b in batches:
            for r in _rows(b):
                height = height_of(r["total"])
                levels, text = sides(r["log"], r["n"], height), r["log"].hex()
                at = [position(r["n"], height, 0, i) * 64 for i in range(r["n"])]
                yield pa.RecordBatch.from_pydict({
                    "tree": r["named"], "up": [[s for pair in path(levels, i) for s in pair] + r["up"]
                                               for i in range(r["n"])],
                    "subroot": [text[p:p + 64] for p in at], "root": [r["root"]] * r["n"]},
                    schema=pa.schema([("tree", pa.string()), ("up", pa.list_(pa.string())),
                                      ("subroot", pa.string()), ("root", pa.string())]))

    return staged(_paths(logs, root).mapInArrow(
        run, "tree string, up array<string>, subroot string, root string"), "tops")


def _proofs(log: DataFrame) -> DataFrame:
    """One row per leaf: its digest, both roots, its proof and the root that its
    forged digest folds to."""
    def run(batches):
        for b in batches:
            for r in _rows(b):
                n, height = r["n"], height_of(r["total"])
                levels, text = sides(r["log"], n, height), r["log"].hex()
                above = list(zip(r["up"][::2], r["up"][1::2]))
                out = {k: [] for k in ("leaf", "proof_sha256", "folded_root")}
                for i in range(n):
                    siblings = path(levels, i) + above
                    p = position(n, height, 0, i) * 64
                    out["leaf"].append(text[p:p + 64])
                    out["proof_sha256"].append(proof_digest(siblings))
                    out["folded_root"].append(fold(r["forged"][i].hex(), siblings))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(out["leaf"]), pa.array([r["subroot"]] * n),
                     pa.array([r["root"]] * n), pa.array(out["proof_sha256"]), pa.array(out["folded_root"]),
                     pa.array([f == r["root"] for f in out["folded_root"]])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return log.mapInArrow(run, _OUT)


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of
    every row."""
    table = staged(leaves(documents), "leaves")
    logs = forest(ranked(table, ["doc_id", "digest"]), {"doc_id": "long", "forged": "binary"})
    return _proofs(_paths(logs, _tops(staged(roots(logs), "roots"))))


ORACLE = """
WITH RECURSIVE src AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree,
         concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                   coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || CASE WHEN crc % 3 = 0 THEN coalesce(strlen(low) || ':' || low, '-')
                             ELSE coalesce(strlen(text) || ':' || text, '-') END) AS forged
  FROM src
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves
), low_nodes(tree, level, idx, h) AS (
  SELECT tree, 0, rank, leaf FROM ranked
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low_nodes) WHERE n > 1 GROUP BY tree, level, idx // 8
), subroots AS (
  SELECT tree, max(level) AS height, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM low_nodes GROUP BY tree
), high_nodes(level, idx, h) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM high_nodes) WHERE n > 1 GROUP BY level, idx // 8
), root AS (SELECT arg_max(h, level) AS root FROM high_nodes),
runs AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM low_nodes a JOIN low_nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8
  JOIN subroots s ON s.tree = a.tree AND a.level < s.height
  GROUP BY a.tree, a.level, a.idx
  UNION ALL
  SELECT s.tree, s.height + a.level, 0, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM subroots s JOIN high_nodes a ON s.pos // (8 ** a.level)::BIGINT = a.idx
  JOIN high_nodes b ON a.level = b.level AND a.idx // 8 = b.idx // 8
  WHERE a.level < (SELECT max(level) FROM high_nodes)
  GROUP BY s.tree, s.height, a.level, a.idx
), steps AS (
  SELECT d.tree, d.rank, p.level, p.l, p.r
  FROM ranked d JOIN subroots s ON s.tree = d.tree
  JOIN runs p ON p.tree = d.tree
    AND p.idx = CASE WHEN p.level < s.height THEN d.rank // (8 ** p.level)::BIGINT ELSE 0 END
), folds(tree, rank, level, h) AS (
  SELECT tree, rank, 0, forged FROM ranked
  UNION ALL
  SELECT f.tree, f.rank, f.level + 1, sha256(p.l || f.h || p.r)
  FROM folds f JOIN steps p ON p.tree = f.tree AND p.rank = f.rank AND p.level = f.level
), proofs AS (
  SELECT tree, rank, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM steps GROUP BY tree, rank
), folded AS (
  SELECT tree, rank, arg_max(h, level) AS folded_root FROM folds GROUP BY tree, rank
)
SELECT d.doc_id, d.leaf, s.subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root,
       f.folded_root = root.root AS verified
FROM ranked d JOIN subroots s USING (tree) JOIN folded f USING (tree, rank) LEFT JOIN proofs p USING (tree, rank), root
"""
