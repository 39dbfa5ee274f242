"""Metrics files (A1-A3): JSON lines of the ten-key metrics record.

Read with a declared schema (never inferred); malformed lines are kept apart
in a corrupt-record column, never dropped.  The example dialect's four record
shapes (camelCase keys) are normalised onto one schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import METRICS_RECORD

CORRUPT = "_corrupt_record"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def metrics_schema(extra: T.StructType | None = None) -> T.StructType:
    fields = list(METRICS_RECORD.fields) + (list(extra.fields) if extra else [])
    return T.StructType(fields + [T.StructField(CORRUPT, T.StringType())])


def read_metrics(spark: SparkSession, path: str, run_id_from_path: bool = False,
                 extra: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """A1: ``(good, corrupt)`` rows of a metrics JSONL folder.

    ``run_id_from_path``: take ``run_id`` from a ``run_id=<id>`` folder in the
    file path (one folder per run; the record itself carries no run id); the
    id stays a string, whatever its form.  Nothing runs here: the lines are
    read as text and parsed with ``from_json``, each result is a filter over
    that; land them as Parquet where both are wanted often.
    """
    good, corrupt = _parsed(spark, path, metrics_schema(extra))
    if run_id_from_path:
        good = good.withColumn("run_id", F.nullif(F.regexp_extract("_source_file", r"run_id=([^/]+)", 1), F.lit("")))
    return good, corrupt


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed JSON lines and, apart, the lines that do not parse."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"))
    rows = parsed_lines(lines, schema)
    good = rows.filter(F.col("line").isNull()).drop("line")
    return good, rows.filter(F.col("line").isNotNull()).select("line", "_source_file")


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines of text (``value``, and columns that are kept) as records, with
    ``line`` holding the text of those that do not parse, else null; blank lines
    are left out."""
    names = [f.name for f in schema.fields if f.name != CORRUPT]
    kept = [c for c in lines.columns if c != "value"]
    rows = lines.filter(F.trim("value") != "").select(
        "value", *kept,
        F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT, "timestampNTZFormat": TS_FORMAT,
                                      "mode": "PERMISSIVE"}).alias("_j"))
    bad = F.col("_j").isNull() | F.col(f"_j.{CORRUPT}").isNotNull()
    return rows.select(*[F.when(~bad, F.col("_j")[n]).alias(n) for n in names], *kept,
                       F.when(bad, F.col("value")).alias("line"))


def write_metrics(df: DataFrame, path: str, extra_cols: tuple[str, ...] = ()) -> None:
    """A2: append one JSON object per row with the ten keys (nulls written as
    null).  ``timestamp`` may be given as ``ts``."""
    if "timestamp" not in df.columns and "ts" in df.columns:
        df = df.withColumnRenamed("ts", "timestamp")
    cols = [f.name for f in METRICS_RECORD.fields] + list(extra_cols)
    (df.select(*cols).write.mode("append").option("ignoreNullFields", "false")
     .option("timestampNTZFormat", TS_FORMAT).json(path))


# camelCase example keys -> canonical names (fixed values)
SHAPE_KEYS = T.StructType([
    T.StructField("stage", T.StringType()), T.StructField("tokensUsed", T.LongType()),
    T.StructField("tokens_used", T.LongType()), T.StructField("cost", T.DecimalType(18, 9)),
    T.StructField("duration", T.LongType()), T.StructField("duration_ms", T.LongType()),
    T.StructField("filesModified", T.IntegerType()), T.StructField("files_modified", T.IntegerType()),
    T.StructField("linesAdded", T.LongType()), T.StructField("lines_added", T.LongType()),
    T.StructField("linesRemoved", T.LongType()), T.StructField("lines_removed", T.LongType()),
    T.StructField("testsPass", T.BooleanType()), T.StructField("testsPassing", T.BooleanType()),
    T.StructField("tests_pass", T.BooleanType()), T.StructField("error", T.StringType()),
    T.StructField("tokensUsedBeforeFailure", T.LongType()),
    T.StructField("costBeforeFailure", T.DecimalType(18, 9)),
    T.StructField("stackTrace", T.StringType()), T.StructField("iteration", T.IntegerType()),
    T.StructField("issue", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("branch", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])


def read_metric_shapes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(good, corrupt)`` rows of mixed-shape metrics lines, with the superset
    schema; broken lines stay apart."""
    return _parsed(spark, path, T.StructType(list(SHAPE_KEYS.fields) + [T.StructField(CORRUPT, T.StringType())]))


def shape_time(c):
    """Either dialect's timestamp as UTC wall-clock time: with a zone (``Z`` or
    an offset) the instant's, without one as written."""
    text = c.cast("string")
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    instant = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(zoned, instant).otherwise(text.try_cast("timestamp_ntz"))


def normalise_metrics(df: DataFrame) -> DataFrame:
    """A3: union the four record shapes onto the metrics schema plus ``kind``
    (failure / iteration / feature / stage by which key is present); stage
    labels ``iteration-<n>`` and ``feature-<f>`` as the Python writer makes."""
    def col(name):
        return F.col(name) if name in df.columns else F.lit(None)

    kind = (F.when(col("error").isNotNull(), "failure")
            .when(col("iteration").isNotNull(), "iteration")
            .when(col("feature").isNotNull(), "feature").otherwise("stage"))
    stage = (F.when(col("stage").isNotNull(), col("stage"))
             .when(col("iteration").isNotNull(), F.concat(F.lit("iteration-"), col("iteration").cast("string")))
             .when(col("feature").isNotNull(), F.concat(F.lit("feature-"), col("feature"))))
    return df.select(
        kind.alias("kind"), stage.alias("stage"),
        F.coalesce(col("tokens_used"), col("tokensUsed"), F.lit(0)).cast("bigint").alias("tokens_used"),
        F.coalesce(col("cost"), F.lit(0)).cast("decimal(18,9)").alias("cost"),
        F.coalesce(col("duration_ms"), col("duration"), F.lit(0)).cast("bigint").alias("duration_ms"),
        F.coalesce(col("files_modified"), col("filesModified"), F.lit(0)).cast("int").alias("files_modified"),
        F.coalesce(col("lines_added"), col("linesAdded"), F.lit(0)).cast("bigint").alias("lines_added"),
        F.coalesce(col("lines_removed"), col("linesRemoved"), F.lit(0)).cast("bigint").alias("lines_removed"),
        F.coalesce(col("tests_pass"), col("testsPass"), col("testsPassing"), F.lit(True)).alias("tests_pass"),
        col("error").cast("string").alias("error"),
        shape_time(col("timestamp")).alias("timestamp"),
        *([col("run_id").cast("string").alias("run_id")] if "run_id" in df.columns else []))


def drop_duplicate_records(df: DataFrame, cols=None) -> DataFrame:
    """S7 in batch: exact duplicate records (an append retried after a lost
    acknowledgement writes the same line twice) kept once.  A hash
    aggregation on all columns: partial per task before the shuffle, so
    many copies of one line cost one row per task."""
    return df.dropDuplicates(list(cols) if cols else None)
