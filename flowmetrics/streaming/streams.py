"""Structured Streaming forms of the batch operators.

Event time must be TIMESTAMP for watermarks; bindings carry TIMESTAMP_NTZ,
so streams cast ``ts`` to TIMESTAMP on the way in (``to_event_time``).
The operators that keep state per key with timers (S3, S4, S8 by own deadline)
are in :mod:`flowmetrics.streaming.keyed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import notify as N
from ..schemas import APPROVAL_TIMEOUT_S
from ..session import session_conf
from . import keyed


def to_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


# -- S1 ---------------------------------------------------------------------
def metrics_stream(spark: SparkSession, path: str, schema, fmt: str = "json",
                   max_files_per_trigger: int = 1000) -> DataFrame:
    """Tail a metrics folder with a declared schema and bounded intake."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        r = r.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    return r.format(fmt).load(path)


# -- S2 ---------------------------------------------------------------------
def live_run_state(stream: DataFrame) -> DataFrame:
    """Run state per run kept up to date.  In update mode a micro-batch
    hands on the runs it changed and no others; :func:`run_to_table` writes them
    as that batch's version and :func:`latest` reads the last version of each."""
    return stream.groupBy("run_id").agg(
        F.max_by("stage", "seq").alias("current_stage"),
        F.sum("tokens_used").cast("bigint").alias("total_tokens_used"),
        F.sum("cost").cast("decimal(38,9)").alias("total_cost"),
        F.count(F.when(F.col("tests_pass"), 1)).cast("bigint").alias("tests_passed_count"),
        F.count(F.lit(1)).cast("bigint").alias("stages_completed"))


def latest(versions: DataFrame, key: str) -> DataFrame:
    """The row of the latest batch of each key (one partial aggregation)."""
    cols = [c for c in versions.columns if c not in (key, "batch_id")]
    return versions.groupBy(key).agg(F.max_by(F.struct(*cols), "batch_id").alias("v")).select(key, "v.*")


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, upto: int, to: str) -> None:
    """Fold the versions up to a batch into one version each, written to ``to``
    under that batch's id, so that reads need not go through all versions."""
    old = table(spark, path, schema).filter(F.col("batch_id") <= upto)
    write_batch(latest(old, key).withColumn("batch_id", F.lit(upto)), to)


# -- tables written by batch -----------------------------------------------------
def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows under ``path`` with their ``batch_id``; no rows where nothing has
    been written."""
    fields = [f for f in schema.fields if f.name != "batch_id"]
    make_folder(spark, path)
    return spark.read.schema(T.StructType([*fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def write_batch(rows: DataFrame, path: str) -> None:
    """Write rows with a ``batch_id`` so that a replay replaces them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> str:
    """Run a streaming query to the end of its input (``availableNow``), each
    micro-batch written idempotently under ``path``: append and update mode
    write ``batch_id=<id>`` partitions (a replay overwrites its own), complete
    mode overwrites the whole table.  State is kept in the RocksDB store, which
    the keyed operators need."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            write_batch(batch.withColumn("batch_id", F.lit(batch_id)), path)

    make_folder(df.sparkSession, path)
    with session_conf(df.sparkSession, **{k.replace(".", "__"): v for k, v in keyed.STATE_STORE.items()}):
        q = (df.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return path


# -- S5 ---------------------------------------------------------------------
def windowed_dashboard(stream: DataFrame, window: str = "1 hour",
                       watermark: str = "2 hours") -> DataFrame:
    """Stage dashboard panels per tumbling event-time window.  In update
    or append mode rows older than the watermark are dropped and old windows'
    state is released; complete mode keeps every window (no late-data rule)."""
    n = F.count(F.lit(1))
    return (stream.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "stage")
            .agg(n.cast("bigint").alias("records"),
                 F.count(F.when(F.col("tests_pass"), 1)).cast("bigint").alias("tests_passed"),
                 F.sum("duration_ms").cast("bigint").alias("duration_ms"),
                 F.sum("tokens_used").cast("bigint").alias("tokens"),
                 F.sum("cost").cast("decimal(38,9)").alias("cost"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "stage", "records", "tests_passed", "duration_ms", "tokens", "cost"))


def window_corrections(landed: DataFrame, closed: DataFrame, window: str = "1 hour") -> DataFrame:
    """What closed windows lack: the landed records of each (window, stage) that
    came too late for it, and their tokens and cost.  ``closed``: windows that an
    append-mode :func:`windowed_dashboard` has emitted, or null totals where a
    window had nothing else."""
    all_ = landed.groupBy(F.window("ts", window).alias("w"), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_used").alias("t"), F.sum("cost").cast("decimal(38,9)").alias("c"))
    all_ = all_.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "n", "t", "c")
    done = closed.select("window_start", "stage", "records", "tests_passed", "duration_ms", "tokens", "cost")
    both = all_.join(done, ["window_start", "stage"], "left")

    def lack(whole, counted):
        return F.col(whole) - F.coalesce(counted, F.lit(0))

    return both.select(
        "window_start", "window_end", "stage", "records", "tests_passed", "duration_ms", "tokens", "cost",
        lack("n", F.col("records")).alias("late_records"), lack("t", F.col("tokens")).cast("bigint").alias("late_tokens"),
        lack("c", F.col("cost")).cast("decimal(38,9)").alias("late_cost"))


# -- S6 ---------------------------------------------------------------------
def outbox_writer(path: str, previews: DataFrame | None = None, channels=None,
                  files: DataFrame | None = None):
    """A ``foreachBatch`` function that renders gate openings (B11) and
    writes them to ``path/batch_id=<id>/channel=<c>`` (overwrite: a replayed
    batch rewrites the same partitions, a key of an earlier batch is left out, so
    each key is written once).  ``files``: all names in parts, for webhooks."""
    from ..sources.outbox import write_outbox

    def run(batch: DataFrame, batch_id: int) -> None:
        g = batch.select(F.col("gate_id").alias("request_id"), "run_id", "stage")
        if previews is not None:
            g = g.join(previews, "run_id", "left")
        else:
            g = g.withColumn("files_preview", F.array().cast("array<string>")) \
                 .withColumn("files_count", F.lit(0).cast("bigint"))
        req = g.select("request_id", "run_id", "stage", N.approval_message(F.col("stage")).alias("message"),
                       "files_preview", "files_count", F.lit(None).cast("string").alias("diff_url"))
        write_outbox(N.render_notifications(req, channels, files=files), path, batch_id)

    return run


# -- S7 ---------------------------------------------------------------------
def dedupe_stream(stream: DataFrame, watermark: str = "1 hour", cols=None) -> DataFrame:
    """Drop exact duplicate lines (a retried append) within the watermark.
    The state holds one entry a row until the watermark has passed it.  Rows
    behind the watermark leave the stream; :func:`late_rows` gives them."""
    cols = cols or stream.columns
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(cols))


def late_rows(landed: DataFrame, emitted: DataFrame) -> DataFrame:
    """The distinct landed rows that a deduplicating stream has not emitted, once
    it has read all of ``landed``: those that came behind its watermark."""
    cols = landed.columns
    there = emitted.select(F.struct(*cols).alias("__there"))
    return landed.distinct().join(there, F.struct(*cols) == F.col("__there"), "left_anti")


# -- S8 ---------------------------------------------------------------------
def stuck_activities(scheduled: DataFrame, completed: DataFrame, max_limit_s: int,
                     watermark: str = "1 hour") -> DataFrame:
    """Scheduled activities with no completion inside their limit:
    stream-stream left outer join on activity id with an event-time bound,
    watermarks on both sides; unmatched rows are emitted once the watermark
    passes their deadline.  ``max_limit_s``: the largest limit that occurs, as
    the activity dimension has it.  ``scheduled``: activity_id, run_id, activity,
    scheduled_at, limit_s; ``completed``: activity_id, completed_at."""
    s = scheduled.withWatermark("scheduled_at", watermark).alias("s")
    c = completed.withWatermark("completed_at", watermark) \
        .select(F.col("activity_id").alias("c_id"), "completed_at").alias("c")
    cond = ((F.col("s.activity_id") == F.col("c.c_id"))
            & (F.col("c.completed_at") >= F.col("s.scheduled_at"))
            & (F.col("c.completed_at") <= F.col("s.scheduled_at")
               + F.expr(f"INTERVAL {int(max_limit_s)} SECONDS")))
    j = s.join(c, cond, "leftOuter")
    late = F.col("completed_at").isNull() | (
        F.col("completed_at") > F.timestamp_add("SECOND", F.col("limit_s"), F.col("scheduled_at")))
    return j.filter(late).select("activity_id", "run_id", "activity", "scheduled_at", "limit_s",
                                 "completed_at")


# -- S3 ---------------------------------------------------------------------
def approval_gate_stream(gates: DataFrame, signals: DataFrame, watermark: str = "2 hours",
                         timeout_s: int = APPROVAL_TIMEOUT_S) -> DataFrame:
    """S3: the decided gates of :func:`flowmetrics.streaming.keyed.gate_stream`,
    which also hands on the late rows."""
    return keyed.gate_stream(gates, signals, watermark, timeout_s).filter(F.col("outcome") != "late") \
        .select("gate_id", "run_id", "stage", "opened_at", "outcome", "decided_at")
