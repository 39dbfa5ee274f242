"""The ordered scan equals a plain window for any bucketing."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmetrics.plans.scan import prefix_scan, row_number_scan, top_n_per_key

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, id long, v long, c decimal(38,9)"


def _frame(spark, n=900):
    """A hot key, ordinary keys, a null key, null and equal timestamps, ids
    that do not follow the timestamps."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 else rng.choice(["a", "b", None])
        ts = None if i % 17 == 0 else T0 + timedelta(seconds=0 if i % 2 else rng.randrange(9000))
        rows.append((k, ts, n - i, None if i % 11 == 0 else rng.randrange(100), Decimal("0.000000001")))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("target", [10, 100, 1_000_000])
def test_equals_plain_window(spark, target):
    df = _frame(spark)
    aggs = [("s", "sum", F.col("v")), ("cs", "sum", F.col("c")), ("n", "count", F.col("v")),
            ("mx", "max", F.col("v"), "before"), ("mn", "min", F.col("v"), "after"),
            ("last", "last", F.col("v")), ("next", "first", F.col("v"), "after"), ("rest", "sum", F.col("v"), "from")]
    got = prefix_scan(df, ["k"], ["ts", "id"], aggs, target_rows=target)
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "*", F.sum("v").over(upto).alias("s"), F.sum("c").over(upto).alias("cs"), F.count("v").over(upto).alias("n"),
        F.max("v").over(before).alias("mx"), F.min("v").over(after).alias("mn"),
        F.last("v", True).over(upto).alias("last"), F.first("v", True).over(after).alias("next"),
        F.sum("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    assert got.columns == want.columns
    norm = lambda d: sorted(repr([x if x is not None or i != 7 else 0 for i, x in enumerate(r)])
                            for r in d.collect())
    assert norm(got) == norm(want)


def test_small_amounts_keep_their_scale(spark):
    df = spark.createDataFrame([(1, i, Decimal("0.000000001")) for i in range(5)], "k long, o long, c decimal(38,9)")
    got = prefix_scan(df, ["k"], ["o"], [("s", "sum", F.col("c"))], target_rows=2).orderBy("o")
    assert [r.s for r in got.collect()] == [Decimal(i).scaleb(-9) for i in range(1, 6)]


def test_burst_is_split(spark):
    """All rows of one instant: the edges fall on the ids."""
    df = spark.createDataFrame([("x", T0, i) for i in range(500)], "k string, ts timestamp_ntz, id long")
    got = row_number_scan(df, ["k"], ["ts", "id"], "seq", target_rows=50)
    assert all(r.seq == r.id + 1 for r in got.collect())
    assert "_fm_part" in got._jdf.queryExecution().toString()


def test_ordinary_data_takes_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = prefix_scan(df, ["k"], ["id"], [("s", "sum", F.col("id"))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_n(spark):
    df = spark.range(100).select(F.lit("x").alias("k"), "id")
    got = top_n_per_key(df, ["k"], ["id"], 3)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
