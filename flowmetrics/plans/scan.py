"""Skew-safe building blocks for per-run ordered work.

A run (or session, issue, project) can be hot: assume one key holds a third
of all rows.  A plain ``Window.partitionBy(run_id).orderBy(...)`` sends that
whole key to one task.  ``prefix_scan`` counts the rows of each key first (one
partial aggregation):

* while no key has more than ``target_rows`` rows, the scan is the plain window
  (one shuffle of the rows on the key);
* otherwise each such key is cut into buckets of about ``target_rows`` rows at
  *edges* drawn from its own order values (a sample by hash, so the edges are
  the same however often they are computed); the frame aggregate runs inside
  each ``(key, bucket)``, one summary row per bucket of the hot keys is carried
  along the order, and both are merged.

Edges are whole order tuples, so a burst of equal timestamps is split by the
columns that follow, null order values sort first as in any window, and the
result does not depend on where the edges fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRAMES = {
    "upto": (Window.unboundedPreceding, Window.currentRow),
    "before": (Window.unboundedPreceding, -1),
    "from": (Window.currentRow, Window.unboundedFollowing),
    "after": (1, Window.unboundedFollowing),
}
_KINDS = ("sum", "count", "max", "min", "last", "first")

#: rows of one key that one task may order by itself
TARGET_ROWS = 4_000_000
#: order values drawn per bucket of a hot key
_DRAWS = 32
_MOD = 1_000_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _agg(kind: str, c: Column) -> Column:
    if kind in ("sum", "count"):
        return F.sum(c)
    return F.max(c) if kind in ("max", "last") else F.min(c)


def _merge(kind: str, local: Column, carry: Column, dtype: T.DataType) -> Column:
    if kind in ("sum", "count"):
        if isinstance(dtype, T.DecimalType):
            # the sum of two decimal(p, s) is decimal(p + 1, s): one digit is
            # left free so that no scale is lost at the widest type
            part = T.DecimalType(min(dtype.precision, 37), dtype.scale)
            local, carry = local.cast(part), carry.cast(part)
        return F.coalesce(local + carry, local, carry)
    return F.greatest(local, carry) if kind in ("max", "last") else F.least(local, carry)


def _edges(df: DataFrame, keys: list[str], order: Column, hot: DataFrame, target_rows: int) -> DataFrame:
    """(_fm_key, _fm_edges): the sorted bucket edges of each hot key; about
    rows / target_rows edges in all."""
    key = F.struct(*keys)
    parts = F.ceil(F.col("_fm_n") / F.lit(target_rows))
    share = F.least(F.lit(1.0), F.lit(float(_DRAWS)) * parts / F.col("_fm_n"))
    drawn = df.select(key.alias("_fm_key"), order.alias("_fm_o")).join(F.broadcast(hot), "_fm_key") \
        .filter(F.pmod(F.xxhash64("_fm_key", "_fm_o"), F.lit(_MOD)) < share * F.lit(_MOD))
    per = drawn.groupBy("_fm_key").agg(F.max(parts).cast("int").alias("_fm_parts"),
                                       F.sort_array(F.collect_list("_fm_o")).alias("_fm_s"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_fm_parts") - 1, F.lit(1))),
                     lambda i: F.get("_fm_s", F.floor(i * F.size("_fm_s") / F.col("_fm_parts")).cast("int")))
    return per.select("_fm_key", F.array_distinct(at).alias("_fm_edges"))


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence, aggs: Sequence[tuple],
                frame: str = "upto", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add one column per ``(name, kind, expr[, frame])`` holding the
    aggregate of ``expr`` over the ordered frame of the row's key.

    ``frame`` (default for every agg, or per agg as 4th element): ``upto``
    (rows up to and including this one), ``before`` (strictly earlier rows),
    ``from`` / ``after`` (this and later / strictly later rows).  ``kind``:
    ``sum``, ``count`` (of non-null), ``max``, ``min``, ``last`` / ``first``
    (value of the latest / earliest row in the frame where ``expr`` is not
    null).  ``order`` must be a total order within a key; null keys are one
    key, null order values come first.

    The counts are read when the plan is built; the hot keys and their edges
    are broadcast, both at most rows / ``target_rows`` rows.
    """
    keys = list(keys)
    order_cols = [_c(o) for o in order]
    staged, specs = df, []
    for i, a in enumerate(aggs):
        name, kind, expr = a[0], a[1], a[2]
        fr = a[3] if len(a) > 3 else frame
        if kind not in _KINDS:
            raise ValueError(f"unknown kind {kind}")
        if fr not in _FRAMES:
            raise ValueError(f"frame must be one of {sorted(_FRAMES)}")
        if kind in ("last", "first"):
            fields = [o.alias(f"o{j}") for j, o in enumerate(order_cols)] + [expr.alias("v")]
            expr = F.when(expr.isNotNull(), F.struct(*fields))
        elif kind == "count":
            expr = F.when(expr.isNotNull(), F.lit(1).cast("bigint"))
        staged = staged.withColumn(f"_fm_in{i}", expr)
        specs.append((name, kind, F.col(f"_fm_in{i}"), fr))
    inputs = [f"_fm_in{i}" for i in range(len(specs))]

    def frames(part: list[str], source: DataFrame, out: str) -> DataFrame:
        for name, kind, c, fr in specs:
            w = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(*_FRAMES[fr])
            source = source.withColumn(out + name, _agg(kind, c).over(w))
        return source

    def finish(out: DataFrame, merged: dict[str, Column], drop: list[str]) -> DataFrame:
        for name, kind, _, _ in specs:
            value = merged[name]
            out = out.withColumn(name, value.getField("v") if kind in ("last", "first") else value)
        return out.drop(*inputs, *drop)

    local = [f"_fm_l_{name}" for name, *_ in specs]
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_fm_n")).filter(F.col("_fm_n") > target_rows) \
        .select(F.struct(*keys).alias("_fm_key"), "_fm_n")
    if not hot.take(1):
        plain = frames(keys, staged, "_fm_l_")
        return finish(plain, {name: F.col(f"_fm_l_{name}") for name, *_ in specs}, local)

    tuple_ = F.struct(*[o.alias(f"o{j}") for j, o in enumerate(order_cols)])
    edges = F.broadcast(_edges(df, keys, tuple_, hot, target_rows))
    staged = staged.withColumn("_fm_key", F.struct(*keys)).withColumn("_fm_o", tuple_).join(edges, "_fm_key", "left")
    below = F.size(F.filter(F.col("_fm_edges"), lambda e: e < F.col("_fm_o")))
    bucket = F.when(F.col("_fm_edges").isNull(), F.lit(0)).otherwise(below + 1)
    # key and bucket in one struct: equal also where parts of the key are null
    staged = staged.withColumn("_fm_part", F.struct(F.col("_fm_key").alias("k"), bucket.alias("b"))) \
        .drop("_fm_key", "_fm_edges", "_fm_o")
    rows = frames(["_fm_part"], staged, "_fm_l_")
    totals = staged.filter(F.col("_fm_part.b") > 0).groupBy("_fm_part").agg(
        *[_agg(kind, c).alias(f"_fm_t_{name}") for name, kind, c, _ in specs])
    carry = totals.select(F.col("_fm_part").alias("_fm_p2"), *[
        _agg(kind, F.col(f"_fm_t_{name}")).over(
            Window.partitionBy("_fm_part.k").orderBy("_fm_part.b").rowsBetween(
                *((Window.unboundedPreceding, -1) if fr in ("upto", "before") else (1, Window.unboundedFollowing))))
        .alias(f"_fm_c_{name}") for name, kind, _, fr in specs])
    out = rows.join(carry, F.col("_fm_part") == F.col("_fm_p2"), "left")
    merged = {name: _merge(kind, F.col(f"_fm_l_{name}"), F.col(f"_fm_c_{name}"), rows.schema[f"_fm_l_{name}"].dataType)
              for name, kind, _, _ in specs}
    return finish(out, merged, [*local, *[f"_fm_c_{name}" for name, *_ in specs], "_fm_part", "_fm_p2"])


def row_number_scan(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "seq",
                    dtype: str = "bigint", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Skew-safe ``row_number() over (partition by keys order by order)``."""
    return prefix_scan(df, keys, order, [(name, "count", F.lit(1))], "upto", target_rows) \
        .withColumn(name, F.col(name).cast(dtype))


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                  rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows per key by ``order`` (a total order).  Spark applies the
    limit to each task's rows before the one shuffle, so a hot key sends at
    most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*[_c(o) for o in order])
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= n)
