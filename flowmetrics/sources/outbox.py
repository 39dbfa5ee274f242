"""Notification outbox (A6): rendered rows per channel written to a table;
delivery is left to others.

Idempotent on (row key, channel, part): duplicates are removed before the
write, rows that another batch has written already are left out, and rows land
in ``bucket=<n>/batch_id=<b>/channel=<c>`` partitions written with dynamic
partition overwrite, so re-running the same batch replaces exactly its own
partitions and never touches other batches.

The bucket is a hash of the row key, so what was written before is looked up in
the batch's own buckets only, and of those only the key columns are read.  The
number of buckets belongs to the table: use one value for all its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.streams import exists, make_folder

BUCKETS = 16
_PARTS = [T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.StringType()),
          T.StructField("channel", T.StringType())]
#: what :func:`flowmetrics.operators.notify.render_notifications` returns
ROW = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("channel", T.StringType()),
                    T.StructField("part", T.IntegerType()), T.StructField("payload", T.StringType())])


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    names = {f.name for f in _PARTS}
    return spark.read.schema(T.StructType([f for f in schema.fields if f.name not in names] + _PARTS)).parquet(path)


def written_keys(spark: SparkSession, path: str, schema: T.StructType, ids: list[str], own: list[int]) -> DataFrame:
    """The (batch_id, ``ids``) that the outbox holds in the buckets ``own``: a read
    of those partitions and the key columns."""
    return _table(spark, path, schema).filter(F.col("bucket").isin(own)).select("batch_id", *ids)


def write_outbox(df: DataFrame, path: str, batch_id: int | str = 0, key: str = "request_id",
                 buckets: int = BUCKETS) -> None:
    spark = df.sparkSession
    ids = [key, "channel"] + (["part"] if "part" in df.columns else [])
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = df.dropDuplicates(ids)
    if exists(spark, path):
        own = sorted(r["b"] for r in df.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
        others = written_keys(spark, path, df.schema, ids, own).filter(F.col("batch_id") != str(batch_id))
        rows = rows.join(others.select(*ids), ids, "left_anti")
    (rows.withColumn("bucket", bucket).withColumn("batch_id", F.lit(str(batch_id)))
     .repartition("bucket", "channel").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "batch_id", "channel").parquet(path))


def read_outbox(spark: SparkSession, path: str, schema: T.StructType = ROW) -> DataFrame:
    """All rows of the outbox; none where nothing has been written."""
    make_folder(spark, path)
    return _table(spark, path, schema)
