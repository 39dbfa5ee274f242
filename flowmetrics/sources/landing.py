"""Tables that many queries share: metrics landed once by day, and run rows
laid out by run.

*Landing* (A1, A2).  Metrics files grow; a stream over the folder, run to the end
of its input, takes the new files only (its checkpoint is the manifest of those
read) and writes them as Parquet by day, so that queries over some days read
those days alone.  Lines that do not parse land beside them, in a partition of
their own.

*Layout by run.*  A bucketed table holds a run's rows in one bucket, so windows
and aggregations by run need no exchange.  A run that holds a large share of the
rows is written by ``SALTS`` tasks, and a plan that shuffles such a run (see
:mod:`flowmetrics.plans.scan`) reads the files split as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.streams import make_folder
from .metrics import metrics_schema, parsed_lines

CORRUPT_DAY = "corrupt"
UNDATED = "undated"
SALTS = 8


def land_metrics(spark: SparkSession, source: str, dest: str, checkpoint: str,
                 extra: T.StructType | None = None, max_files_per_trigger: int = 1000) -> list[int]:
    """Append the metrics files that are new since the last call; returns the
    lines read per batch.  A replayed batch rewrites its own partitions."""
    schema = metrics_schema(extra)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = parsed_lines(batch, schema)
        day = F.when(F.col("line").isNotNull(), F.lit(CORRUPT_DAY)) \
            .otherwise(F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit(UNDATED)))
        rows.withColumn("day", day).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(dest)

    make_folder(spark, dest)
    q = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(source)
         .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


def _landed(spark: SparkSession, dest: str, extra: T.StructType | None) -> DataFrame:
    fields = [f for f in metrics_schema(extra).fields if not f.name.startswith("_")]
    parts = [T.StructField("line", T.StringType()), T.StructField("day", T.StringType()),
             T.StructField("batch_id", T.LongType())]
    make_folder(spark, dest)
    return spark.read.schema(T.StructType([*fields, *parts])).parquet(dest)


def read_landed(spark: SparkSession, dest: str, since: str | None = None, until: str | None = None,
                extra: T.StructType | None = None) -> DataFrame:
    """Landed records of the days ``since`` to ``until`` (``yyyy-mm-dd``, both
    included; all dated and undated ones by default), with their ``day``."""
    rows = _landed(spark, dest, extra).filter(F.col("day") != CORRUPT_DAY)
    if since is not None:
        rows = rows.filter((F.col("day") >= since) & (F.col("day") != UNDATED))
    if until is not None:
        rows = rows.filter(F.col("day") <= until)
    return rows.drop("line", "batch_id")


def read_corrupt(spark: SparkSession, dest: str) -> DataFrame:
    """The landed lines that did not parse."""
    return _landed(spark, dest, None).filter(F.col("day") == CORRUPT_DAY).select("line")


def write_by_run(df: DataFrame, name: str, path: str, buckets: int = 64, key: str = "run_id",
                 order: str = "seq", salts: int = SALTS) -> DataFrame:
    """Write ``df`` as table ``name`` under ``path``, bucketed by ``key`` and sorted
    by ``order`` in each file, and read it back.  ``salts``: tasks that share a
    bucket; 1 where no run holds many rows."""
    spark = df.sparkSession
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # as Spark's own buckets
    salt = F.pmod(F.xxhash64(order), F.lit(salts))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets * salts, bucket, salt).write.mode("overwrite").option("path", path) \
        .bucketBy(buckets, key).sortBy(order).saveAsTable(name)
    return spark.table(name)
