"""Registered queries for sources, sinks and streams.

Each writes data Spark derives from the given tables (bindings) to a fresh
folder inside the shared checkpoint folder, reads it back through the source
or stream under test and returns the result; the oracle computes the same
rows directly from the bindings.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import micros_between
from ..session import scratch_path, session_conf
from ..operators import aggregates as AG
from ..operators import windows as W
from ..sources import events as EV
from ..sources import landing as LD
from ..sources import metrics as MS
from ..sources import outbox as OB
from ..streaming import keyed as K
from ..streaming import streams as SS
from . import q_costs, q_logs, q_runs  # noqa: F401  (their oracles are used below)
from ..schemas import activity_timeouts_sql
from .registry import ORACLES, query
from .tables import with_bindings

SM = ["b_stage_metrics"]
RUN_KEYS = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("seq", T.LongType())])

JSON_TS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CORRUPT_SQL_LINE = "'{\"stage\": \"' || stage || '\", \"tokens_used\": '"


def _stage_metrics_jsonl(b):
    """Write b_stage_metrics as metrics JSONL plus one truncated line for
    every 97th event; returns the folder."""
    path = scratch_path(b.spark, "metrics")
    m = b.b_stage_metrics
    MS.write_metrics(m, path, extra_cols=("run_id", "seq"))
    bad = m.filter(F.col("event_id") % 97 == 0).select(
        F.concat(F.lit('{"stage": "'), F.col("stage"), F.lit('", "tokens_used": ')).alias("value"))
    bad.write.mode("append").text(path)
    return path


@query("metrics_scan", bindings=SM, oracle="""
SELECT run_id, seq, stage, tokens_used, cost, duration_ms, files_modified, lines_added, lines_removed,
       tests_pass, error, ts AS "timestamp"
FROM b_stage_metrics
""")
def _metrics_scan(b):
    """A1 + A2: metrics append and scan round trip (good rows)."""
    good, _ = MS.read_metrics(b.spark, _stage_metrics_jsonl(b), extra=RUN_KEYS)
    return good.select("run_id", "seq", "stage", "tokens_used", "cost", "duration_ms",
                       "files_modified", "lines_added", "lines_removed", "tests_pass", "error",
                       "timestamp")


@query("metrics_corrupt_lines", bindings=SM, oracle=f"""
SELECT {CORRUPT_SQL_LINE} AS line FROM b_stage_metrics WHERE event_id % 97 = 0
""")
def _metrics_corrupt(b):
    """A1: malformed lines are kept apart, never dropped."""
    _, bad = MS.read_metrics(b.spark, _stage_metrics_jsonl(b), extra=RUN_KEYS)
    return bad.select("line")


@query("metrics_dedupe", bindings=SM, oracle="""
SELECT run_id, seq, stage, tokens_used, cost, duration_ms, files_modified, lines_added, lines_removed,
       tests_pass, error, ts AS "timestamp"
FROM b_stage_metrics
""")
def _metrics_dedupe(b):
    """S7 (batch form): every record appended twice, read back, exact copies
    dropped."""
    path = scratch_path(b.spark, "metrics-retried")
    MS.write_metrics(b.b_stage_metrics, path, extra_cols=("run_id", "seq"))
    MS.write_metrics(b.b_stage_metrics, path, extra_cols=("run_id", "seq"))
    good, _ = MS.read_metrics(b.spark, path, extra=RUN_KEYS)
    cols = ["run_id", "seq", "stage", "tokens_used", "cost", "duration_ms", "files_modified",
            "lines_added", "lines_removed", "tests_pass", "error", "timestamp"]
    return MS.drop_duplicate_records(good.select(*cols))


SHAPES_SQL = """
SELECT CASE event_id % 4 WHEN 2 THEN 'failure' WHEN 3 THEN CASE WHEN event_id % 8 = 7 THEN 'feature' ELSE 'iteration' END
            ELSE 'stage' END AS kind,
       CASE event_id % 4 WHEN 3 THEN CASE WHEN event_id % 8 = 7 THEN 'feature-f' || CAST(seq AS VARCHAR)
            ELSE 'iteration-' || CAST(seq AS VARCHAR) END ELSE stage END AS stage,
       CASE event_id % 4 WHEN 2 THEN 0 ELSE tokens_used END AS tokens_used,
       CAST(CASE event_id % 4 WHEN 0 THEN cost WHEN 1 THEN cost ELSE 0 END AS DECIMAL(18,9)) AS cost,
       CASE event_id % 4 WHEN 0 THEN duration_ms WHEN 1 THEN duration_ms ELSE 0 END AS duration_ms,
       CAST(CASE event_id % 4 WHEN 2 THEN 0 ELSE files_modified END AS INTEGER) AS files_modified,
       CASE event_id % 4 WHEN 0 THEN lines_added WHEN 1 THEN lines_added ELSE 0 END AS lines_added,
       CASE event_id % 4 WHEN 0 THEN lines_removed WHEN 1 THEN lines_removed ELSE 0 END AS lines_removed,
       CASE event_id % 4 WHEN 2 THEN TRUE ELSE tests_pass END AS tests_pass,
       CASE event_id % 4 WHEN 2 THEN 'Stage failed at ' || CAST(seq AS VARCHAR) END AS error,
       ts AS "timestamp", CASE WHEN event_id % 8 = 7 THEN 'feature-' || CAST(run_id AS VARCHAR) END AS run_id
FROM b_stage_metrics WHERE event_id % 101 <> 0
"""


@query("metric_shapes", bindings=SM, oracle=SHAPES_SQL)
def _metric_shapes(b):
    """A3: five record shapes (snake, camelCase stage, failure, iteration,
    feature; the camelCase ones with zoned timestamps, some lines broken)
    written as JSON text and normalised back onto one schema."""
    m = b.b_stage_metrics
    k = F.col("event_id") % 4
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    snake = F.to_json(F.struct("stage", "tokens_used", "cost", "duration_ms", "files_modified",
                               "lines_added", "lines_removed", "tests_pass", "error",
                               F.col("ts").alias("timestamp")), JSON_TS)
    camel = F.to_json(F.struct("stage", F.col("tokens_used").alias("tokensUsed"), "cost",
                               F.col("duration_ms").alias("duration"),
                               F.col("files_modified").alias("filesModified"),
                               F.col("lines_added").alias("linesAdded"),
                               F.col("lines_removed").alias("linesRemoved"),
                               F.col("tests_pass").alias("testsPass"), zoned.alias("timestamp")))
    fail = F.to_json(F.struct("stage", F.concat(F.lit("Stage failed at "), F.col("seq").cast("string"))
                              .alias("error"), F.col("tokens_used").alias("tokensUsedBeforeFailure"),
                              F.lit("trace").alias("stackTrace"), F.col("ts").alias("timestamp")), JSON_TS)
    it = F.to_json(F.struct(F.col("seq").cast("int").alias("iteration"), F.lit("issue").alias("issue"),
                            F.col("tokens_used").alias("tokensUsed"),
                            F.col("tests_pass").alias("testsPassing"),
                            F.col("files_modified").alias("filesModified"),
                            zoned.alias("timestamp")))
    feat = F.to_json(F.struct(F.concat(F.lit("f"), F.col("seq").cast("string")).alias("feature"),
                              F.lit("branch").alias("branch"), F.col("tokens_used").alias("tokensUsed"),
                              F.concat(F.lit("feature-"), F.col("run_id").cast("string")).alias("run_id"),
                              F.col("tests_pass").alias("testsPassing"),
                              F.col("files_modified").alias("filesModified"), zoned.alias("timestamp")))
    line = (F.when(F.col("event_id") % 101 == 0, F.lit("{broken"))
            .when(k == 0, snake).when(k == 1, camel).when(k == 2, fail)
            .when(F.col("event_id") % 8 == 7, feat).otherwise(it))
    path = scratch_path(b.spark, "shapes")
    m.select(line.alias("value")).write.text(path)
    good, _ = MS.read_metric_shapes(b.spark, path)
    return MS.normalise_metrics(good)


EVENT_SQL = """
SELECT strftime(ts, '%H:%M:%S') AS time_of_day, 'ActivityCompleted' AS kind, tokens_used AS tokens,
       cost, 'run ' || CAST(run_id AS VARCHAR) || ' seq ' || CAST(seq AS VARCHAR) AS label
FROM b_stage_metrics
"""


@query("run_events_ingest", bindings=SM, oracle=EVENT_SQL)
def _run_events(b):
    """A4: event-history text lines parsed back into rows."""
    m = b.b_stage_metrics
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] ActivityCompleted: "),
                    F.format_number("tokens_used", 0), F.lit(" tokens, $"), F.col("cost").cast("string"),
                    F.lit(" (run "), F.col("run_id").cast("string"), F.lit(" seq "),
                    F.col("seq").cast("string"), F.lit(")"))
    path = scratch_path(b.spark, "events")
    m.select(line.alias("value")).write.text(path)
    e = EV.read_run_events(b.spark, path)
    return e.select("time_of_day", "kind", "tokens", "cost", "label")


INVOCATION_SQL = """
SELECT command, session_id, exit_code = 0 AND NOT contains(output, 'ERROR') AS success, output,
       duration_ms, tokens_used // 2 AS input_tokens, tokens_used - tokens_used // 2 AS output_tokens
FROM (SELECT command, CAST(session_id AS VARCHAR) AS session_id, exit_code, output, duration_ms, tokens_used
      FROM b_commands) c
"""


@query("invocations_ingest", bindings=["b_commands"], oracle=INVOCATION_SQL)
def _invocations(b):
    """A5: command invocation logs with nested token usage."""
    c = b.b_commands
    rec = F.to_json(F.struct(
        "command", F.array().cast("array<string>").alias("args"), F.lit("/repo").alias("cwd"),
        F.col("session_id").cast("string").alias("sessionId"),
        ((F.col("exit_code") == 0) & ~F.col("output").contains("ERROR")).alias("success"),
        "output", F.col("duration_ms").alias("durationMs"),
        F.struct(F.floor(F.col("tokens_used") / 2).cast("bigint").alias("input"),
                 (F.col("tokens_used") - F.floor(F.col("tokens_used") / 2)).cast("bigint")
                 .alias("output")).alias("tokenUsage"),
        F.col("ts").alias("ts")))
    path = scratch_path(b.spark, "invocations")
    c.select(rec.alias("value")).write.text(path)
    i = EV.read_invocations(b.spark, path)
    return i.select("command", "session_id", "success", "output", "duration_ms", "input_tokens",
                    "output_tokens")


@query("notification_outbox")
def _outbox(b):
    """Rendered notifications written to the outbox twice as one batch and
    again as another (idempotent: each row once)."""
    # render once (reliable checkpoint in the shared folder), write twice
    rendered = q_logs._render_notifications(b).checkpoint(eager=True)
    path = scratch_path(b.spark, "outbox")
    OB.write_outbox(rendered, path, batch_id=0)
    OB.write_outbox(rendered, path, batch_id=0)
    OB.write_outbox(rendered, path, batch_id=1)
    return OB.read_outbox(b.spark, path).select("request_id", "channel", "part", "payload")


@query("landed_usage_trend", bindings=SM, oracle="""
WITH m AS (SELECT * FROM b_stage_metrics WHERE CAST(ts AS DATE) >= (SELECT CAST(min(ts) AS DATE) + 7 FROM b_stage_metrics))
SELECT period, tokens, cost, tokens - lag(tokens) OVER (ORDER BY period) AS tokens_change,
       CAST(cost - lag(cost) OVER (ORDER BY period) AS DECIMAL(38,9)) AS cost_change
FROM (SELECT CAST(ts AS DATE) AS period, CAST(sum(tokens_used) AS BIGINT) AS tokens,
             CAST(sum(cost) AS DECIMAL(38,9)) AS cost FROM m GROUP BY 1) d
""")
def _landed_usage_trend(b):
    """A1 + A2 landed by day in two waves, the second reading its new files only;
    W10 over the days from the eighth on, which are all that is read."""
    m = b.b_stage_metrics
    src, dest, ckpt = (scratch_path(b.spark, n) for n in ("growing", "landed", "landed-ckpt"))
    for wave in (0, 1):
        MS.write_metrics(m.filter(F.col("event_id") % 2 == wave), src, extra_cols=("run_id", "seq"))
        LD.land_metrics(b.spark, src, dest, ckpt, RUN_KEYS)
    first = _ends(m)["lo"]
    since = None if first is None else (first + timedelta(days=7)).strftime("%Y-%m-%d")
    return W.usage_trend(LD.read_landed(b.spark, dest, since, extra=RUN_KEYS).withColumnRenamed("timestamp", "ts"))


def _by_run(b, df, order):
    """A table of ``df`` bucketed by run in the shared folder."""
    path = scratch_path(b.spark, "by-run")
    return LD.write_by_run(df, "fm_" + path.rsplit("-", 1)[1], path, buckets=16, order=order)


@query("layout_progress")
def _layout_progress(b):
    """W1 on the layout by run: no exchange."""
    return W.run_progress(_by_run(b, b.b_stage_metrics, "seq"))


@query("layout_timeline")
def _layout_timeline(b):
    """W6 on the layout by run: no exchange."""
    return W.stage_timeline(_by_run(b, b.b_stage_metrics, "seq"))


@query("layout_summary")
def _layout_summary(b):
    """G2 on the layout by run, metrics and snapshots alike: no exchange."""
    return AG.run_summary(_by_run(b, b.b_stage_metrics, "seq"), _by_run(b, b.b_snapshots, "event_id"))


ORACLES["layout_progress"] = ORACLES["run_progress"]
ORACLES["layout_timeline"] = ORACLES["stage_timeline"]
ORACLES["layout_summary"] = ORACLES["run_summary"]


# -- streams ------------------------------------------------------------------
def _stage_metrics_files(b, copies: int = 1):
    path = scratch_path(b.spark, "stream-src")
    m = b.b_stage_metrics
    for _ in range(copies):
        m.repartition(4).write.mode("append").parquet(path)
    return path, m.schema


def _stream(b, copies: int = 1):
    path, schema = _stage_metrics_files(b, copies)
    s = b.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
    return SS.to_event_time(s)


FAR = datetime(2200, 1, 1)
# streams run in UTC, with their state in RocksDB; counting its rows would cost a lookup a row
STREAM_CONF = {"spark__sql__session__timeZone": "UTC",
               "spark__sql__streaming__stateStore__rocksdb__trackTotalNumberOfRows": "false",
               **{k.replace(".", "__"): v for k, v in K.STATE_STORE.items()}}


def _end_marker(spark, schema, values: dict):
    """One end-of-input row (a sentinel key far in the future): it only
    advances event time so that every buffered key is decided; the queries
    filter the sentinel key out of their output."""
    return spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema)


def _ntz(df):
    """Event-time columns back to wall-clock TIMESTAMP_NTZ inside the stream."""
    for name, typ in df.dtypes:
        if typ == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def _run(b, build, mode):
    """Build and run a stream under a UTC session (restored afterwards);
    wall-clock columns are converted back inside the stream, so the table
    read back does not depend on the session time zone."""
    out = scratch_path(b.spark, "stream-out")
    with session_conf(b.spark, **STREAM_CONF):
        df = _ntz(build())
        SS.run_to_table(df, out, scratch_path(b.spark, "stream-ckpt"), mode)
    return SS.table(b.spark, out, df.schema).drop("batch_id")


def _metrics_json_stream(b):
    """Metrics appended as JSONL (A2, several files) and tailed with a
    declared schema and bounded intake (two files per micro-batch)."""
    path = scratch_path(b.spark, "stream-jsonl")
    MS.write_metrics(b.b_stage_metrics.repartition(4), path, extra_cols=("run_id", "seq"))
    schema = T.StructType(list(MS.METRICS_RECORD.fields) + list(RUN_KEYS.fields))
    return SS.metrics_stream(b.spark, path, schema, "json", max_files_per_trigger=2) \
        .withColumnRenamed("timestamp", "ts")


@query("stream_run_state", bindings=SM, oracle="""
SELECT run_id, arg_max(stage, seq) AS current_stage, CAST(sum(tokens_used) AS BIGINT) AS total_tokens_used,
       CAST(sum(cost) AS DECIMAL(38,9)) AS total_cost,
       CAST(sum(CASE WHEN tests_pass THEN 1 ELSE 0 END) AS BIGINT) AS tests_passed_count,
       CAST(count(*) AS BIGINT) AS stages_completed
FROM b_stage_metrics GROUP BY run_id
""")
def _stream_run_state(b):
    """S1 + S2: live run state over a tailed metrics JSONL folder, in update
    mode: each batch writes the runs it changed, the last version counts."""
    out = scratch_path(b.spark, "run-state")
    with session_conf(b.spark, **STREAM_CONF):
        df = SS.live_run_state(_metrics_json_stream(b))
        SS.run_to_table(df, out, scratch_path(b.spark, "run-state-ckpt"), "update")
    return SS.latest(SS.table(b.spark, out, df.schema), "run_id")


@query("stream_dashboard", bindings=SM, oracle="""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, stage,
       CAST(count(*) AS BIGINT) AS records, CAST(sum(CASE WHEN tests_pass THEN 1 ELSE 0 END) AS BIGINT) AS tests_passed,
       CAST(sum(duration_ms) AS BIGINT) AS duration_ms, CAST(sum(tokens_used) AS BIGINT) AS tokens,
       CAST(sum(cost) AS DECIMAL(38,9)) AS cost
FROM b_stage_metrics GROUP BY 1, 2, 3
""")
def _stream_dashboard(b):
    """Windowed dashboard (hourly tumbling windows, watermark)."""
    return _run(b, lambda: SS.windowed_dashboard(_stream(b), "1 hour", "2 hours"), "complete")


# the rows in five slices of time, each landed and read in turn: the slice of a row by its time
SLICES = 5
SLICE_SQL = f"""CAST(least({SLICES} - 1, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM b_stage_metrics)) * {SLICES}
    // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM b_stage_metrics) + 1)) AS INTEGER)"""


def _slice_of(ts, ends):
    """The slice of a time, and the seconds of a slice; ``ends``: first and last time."""
    us = F.timestamp_diff("MICROSECOND", F.lit(ends["lo"]).cast("timestamp_ntz"), ts)
    return F.least(F.lit(SLICES - 1), F.floor(us * SLICES / F.lit((ends["us"] or 0) + 1)).cast("int"))


def _ends(df, ts="ts"):
    return df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), micros_between(F.min(ts), F.max(ts)).alias("us")).first()


def _sliced(b):
    """b_stage_metrics with the slice of each row, and the seconds of a slice."""
    m = b.b_stage_metrics
    ends = _ends(m)
    return m.withColumn("slice", _slice_of(F.col("ts"), ends)), (ends["us"] or 0) / SLICES / 1e6


def _arrivals(b, rows):
    """Rows written once by the slice they arrive in (``slice``), as many files
    a slice as there are tasks."""
    path = scratch_path(b.spark, "arrivals")
    rows.write.partitionBy("slice").parquet(path)
    SS.make_folder(b.spark, path)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "slice"])
    whole = T.StructType([*schema.fields, T.StructField("slice", T.IntegerType())])
    return b.spark.read.schema(whole).parquet(path), schema


def _by_slices(b, landed, build, mode="append"):
    """Run a stream slice by slice: each slice is appended to the folders that
    the stream reads and taken in by a run of its own on the same checkpoint.
    ``landed``: per name, (rows, schema) of :func:`_arrivals`; ``build`` takes
    the streams by name.  Returns the written table, with ``batch_id``."""
    out, ckpt = scratch_path(b.spark, "stream-out"), scratch_path(b.spark, "stream-ckpt")
    folders = {n: scratch_path(b.spark, f"src-{n}") for n in landed}
    with session_conf(b.spark, **STREAM_CONF):
        for i in range(SLICES):
            for n, (rows, _) in landed.items():
                rows.filter(F.col("slice") == i).drop("slice").write.mode("append").parquet(folders[n])
            df = _ntz(build({n: b.spark.readStream.schema(schema).parquet(folders[n]) for n, (_, schema) in landed.items()}))
            SS.run_to_table(df, out, ckpt, mode)
    return SS.table(b.spark, out, df.schema)


@query("stream_dedupe", bindings=SM, oracle=f"""
SELECT run_id, seq, event_id, stage, tokens_used, cost, ts,
       event_id % 50 = 7 AND {SLICE_SQL} = 0 AS late FROM b_stage_metrics
""")
def _stream_dedupe(b):
    """S7 over five slices in time order: copies in the same batch and in the
    next one are removed by the stream's state; rows that come behind the
    watermark are told apart once the input has been read."""
    m, width = _sliced(b)
    cols = ["run_id", "seq", "event_id", "stage", "tokens_used", "cost", "ts"]
    m = m.select(*cols, "slice")
    late = (F.col("event_id") % 50 == 7) & (F.col("slice") == 0)
    # the slices each row arrives in: one pass over the numbered rows
    copies = F.array(F.col("slice"), F.when(F.col("event_id") % 3 == 0, F.col("slice")),
                     F.when((F.col("event_id") % 3 == 1) & (F.col("slice") < SLICES - 1), F.col("slice") + 1))
    arrives = F.when(late, F.array(F.lit(SLICES - 1))).otherwise(F.array_compact(copies))
    rows, schema = _arrivals(b, m.filter(late.isNotNull()).select(*cols, F.explode(arrives).alias("slice")))
    emitted = _by_slices(b, {"metrics": (rows, schema)}, lambda s: SS.dedupe_stream(
        SS.to_event_time(s["metrics"]), f"{int(2 * width) + 1} seconds")).drop("batch_id")
    return emitted.withColumn("late", F.lit(False)).union(
        SS.late_rows(rows.drop("slice"), emitted).withColumn("late", F.lit(True)))


@query("stream_budget_alerts", bindings=SM, oracle=f"""
WITH s AS (SELECT run_id, {SLICE_SQL} AS slice, tokens_used, cost, ts FROM b_stage_metrics),
g AS (SELECT run_id, slice, sum(tokens_used) AS t, sum(cost) AS c, max(ts) AS mt FROM s GROUP BY 1, 2),
c AS (SELECT run_id, slice, sum(t) OVER w AS tokens, CAST(sum(c) OVER w AS DECIMAL(38,9)) AS cost, max(mt) OVER w AS mt
      FROM g WINDOW w AS (PARTITION BY run_id ORDER BY slice)),
x AS (SELECT run_id, slice, 'cooldown' AS alert, CAST(CAST(tokens AS BIGINT) AS VARCHAR) AS total, mt FROM c WHERE tokens > 50000
      UNION ALL SELECT run_id, slice, 'budget', CAST(cost AS VARCHAR), mt FROM c WHERE cost > CAST(1.00 AS DECIMAL(18,9)))
SELECT run_id, alert, arg_min(total, slice) AS total, min(mt) AS "at" FROM x GROUP BY run_id, alert
""")
def _stream_budget_alerts(b):
    """S4 over five slices in time order: one cooldown and one budget alert per
    run, from state, with the total and time of the batch that crossed."""
    m, width = _sliced(b)
    rows = _arrivals(b, m.select("run_id", "tokens_used", "cost", "ts", "slice"))
    keep = int(SLICES * width) + 1  # no run of these tables ends before the input does
    return _by_slices(b, {"metrics": rows}, lambda s: K.alert_stream(
        SS.to_event_time(s["metrics"]), 50000, "1.00", "1 hour", keep)).select("run_id", "alert", "total", "at")


@query("stream_dashboard_closed", bindings=SM, oracle=f"""
WITH s AS (SELECT *, {SLICE_SQL} AS slice, date_trunc('hour', ts) AS ws FROM b_stage_metrics),
e AS (SELECT to_timestamp(epoch_ms(max(ts)) / 1000) AT TIME ZONE 'UTC' - INTERVAL 2 HOUR AS closed,
             to_timestamp(epoch_ms(max(ts) FILTER (slice < {SLICES - 1})) / 1000) AT TIME ZONE 'UTC' - INTERVAL 2 HOUR AS before
      FROM s),
l AS (SELECT s.*, event_id % 50 = 7 AND slice = 0 AND ws + INTERVAL 1 HOUR <= before AS late
      FROM s, e WHERE ws + INTERVAL 1 HOUR <= closed)
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, stage,
       nullif(CAST(count(*) FILTER (NOT late) AS BIGINT), 0) AS records,
       CASE WHEN count(*) FILTER (NOT late) > 0 THEN CAST(count(*) FILTER (NOT late AND tests_pass) AS BIGINT) END AS tests_passed,
       CAST(sum(duration_ms) FILTER (NOT late) AS BIGINT) AS duration_ms,
       CAST(sum(tokens_used) FILTER (NOT late) AS BIGINT) AS tokens,
       CAST(sum(cost) FILTER (NOT late) AS DECIMAL(38,9)) AS cost,
       CAST(count(*) FILTER (late) AS BIGINT) AS late_records,
       CAST(coalesce(sum(tokens_used) FILTER (late), 0) AS BIGINT) AS late_tokens,
       CAST(coalesce(sum(cost) FILTER (late), 0) AS DECIMAL(38,9)) AS late_cost
FROM l GROUP BY ws, stage
""")
def _stream_dashboard_closed(b):
    """S5 in append mode over five slices: windows leave when the watermark has
    passed them, and their state with them; every fiftieth row of the first slice
    comes with the last one, behind the watermark, and is shown beside its window
    as what that lacks.  Windows still open at the end are not shown."""
    m, _ = _sliced(b)
    m = m.select("run_id", "event_id", "stage", "tests_pass", "duration_ms", "tokens_used", "cost", "ts", "slice")
    late = (F.col("event_id") % 50 == 7) & (F.col("slice") == 0)
    rows, schema = _arrivals(b, m.withColumn("slice", F.when(late, SLICES - 1).otherwise(F.col("slice"))))
    closed = _by_slices(b, {"metrics": (rows, schema)}, lambda s: SS.windowed_dashboard(
        SS.to_event_time(s["metrics"]), "1 hour", "2 hours"))
    end = F.timestamp_add("HOUR", F.lit(-2), F.date_trunc("millisecond", F.lit(_ends(rows)["hi"]).cast("timestamp_ntz")))
    return SS.window_corrections(rows, closed).filter(F.col("window_end") <= end)


@query("stream_approval_gates")
def _stream_gates(b):
    """S3: sticky approval gates on streams (event-time state machine)."""
    gpath = scratch_path(b.spark, "gates-src")
    spath = scratch_path(b.spark, "signals-src")
    b.b_gates.write.parquet(gpath)
    b.b_signals.write.parquet(spath)
    # end-of-input marker: one signal of a sentinel run far in the future
    # advances event time so every buffered gate is decided; it is not output
    _end_marker(b.spark, b.b_signals.schema, {"signal_id": -1, "run_id": -1, "ts": FAR,
                                               "signal": "approve"}).write.mode("append").parquet(spath)
    def build():
        gs = SS.to_event_time(b.spark.readStream.schema(b.b_gates.schema).parquet(gpath),
                              "opened_at")
        ss = SS.to_event_time(b.spark.readStream.schema(b.b_signals.schema).parquet(spath), "ts")
        return SS.approval_gate_stream(gs, ss, "2 hours")
    r = _run(b, build, "append")
    return r.filter(F.col("run_id") >= 0).select("gate_id", "run_id", "stage", "opened_at",
                                                 "outcome", "decided_at")


# the outbox holds exactly the rendered rows
ORACLES["notification_outbox"] = ORACLES["render_notifications"]
# the streaming gates must equal the batch sticky gates (wait_ms aside)
ORACLES["stream_approval_gates"] = ORACLES["approval_gates_sticky"].replace(
    "CASE WHEN failed_before IS NULL THEN (epoch_us(dts) - epoch_us(opened_at)) // 1000 END AS wait_ms\n", "")


SPLIT = """t0 AS (SELECT opened_at AS t, gate_id % 50 = 7 AS moved FROM b_gates
       UNION ALL SELECT ts, signal_id % 50 = 9 FROM b_signals),
t1 AS (SELECT min(t) AS lo, max(t) AS hi FROM t0),
t2 AS (SELECT t, moved, (epoch_us(t) - epoch_us(lo)) * 5 // (epoch_us(hi) - epoch_us(lo) + 1) AS slice FROM t0, t1),
wm AS (SELECT max(t) FILTER (slice < 4 AND NOT (moved AND slice = 0)) - INTERVAL 2 HOUR AS wm,
              max(t) FILTER (slice = 0) AS first FROM t2),
k_gates AS (SELECT g.* FROM b_gates g, wm WHERE NOT (gate_id % 50 = 7 AND opened_at <= first AND opened_at <= wm)),
k_signals AS (SELECT s.* FROM b_signals s, wm WHERE NOT (signal_id % 50 = 9 AND ts <= first AND ts <= wm)),
u AS ("""
ORACLES["stream_gates_late"] = ORACLES["stream_approval_gates"].replace("\nu AS (", "\n" + SPLIT) \
    .replace("NULL AS signal FROM b_gates", "NULL AS signal FROM k_gates").replace("signal FROM b_signals)", "signal FROM k_signals)") \
    .replace("END AS decided_at", "END AS decided_at, CAST(NULL AS BIGINT) AS signal_id, CAST(NULL AS VARCHAR) AS signal") \
    .replace("decided_at, CAST(NULL AS BIGINT) AS signal_id, CAST(NULL AS VARCHAR) AS signal,", "decided_at, CAST(NULL AS BIGINT) AS signal_id, CAST(NULL AS VARCHAR) AS signal") + """
UNION ALL SELECT gate_id, run_id, stage, opened_at, 'late', NULL, NULL, NULL FROM b_gates ANTI JOIN k_gates USING (gate_id)
UNION ALL SELECT NULL, run_id, NULL, ts, 'late', NULL, signal_id, signal FROM b_signals ANTI JOIN k_signals USING (signal_id)
"""


@query("stream_gates_late")
def _stream_gates_late(b):
    """S3 over five slices in time order: some gates and signals of the first
    slice come with the last one, behind the watermark; they decide nothing and
    leave as ``late`` rows, the others as if those had never been."""
    gates, signals = b.b_gates, b.b_signals
    ends = _ends(gates.select(F.col("opened_at").alias("ts")).union(signals.select("ts")))

    def arrival(ts, moved):
        own = _slice_of(ts, ends)
        return F.coalesce(F.when(moved & (own == 0), SLICES - 1).otherwise(own), F.lit(0)).cast("int")

    end = _end_marker(b.spark, signals.schema, {"signal_id": -1, "run_id": -1, "ts": FAR, "signal": "approve"})
    landed = {
        "gates": _arrivals(b, gates.withColumn("slice", arrival(F.col("opened_at"), F.col("gate_id") % 50 == 7))),
        "signals": _arrivals(b, signals.withColumn("slice", arrival(F.col("ts"), F.col("signal_id") % 50 == 9))
                             .union(end.withColumn("slice", F.lit(SLICES - 1))))}
    out = _by_slices(b, landed, lambda s: K.gate_stream(
        SS.to_event_time(s["gates"], "opened_at"), SS.to_event_time(s["signals"]), "2 hours"))
    return out.filter(F.col("run_id") >= 0).drop("batch_id")


def _static_by_run(b, df):
    path = scratch_path(b.spark, "static")
    return LD.write_by_run(df, "fm_" + path.rsplit("-", 1)[1], path, order="run_id", salts=1)


@query("stream_outbox")
def _stream_outbox(b):
    """Gate openings streamed into the outbox by ``foreachBatch``
    (rendered per channel, written per batch id; replays overwrite)."""
    from ..operators import notify as N
    gpath = scratch_path(b.spark, "outbox-gates")
    b.b_gates.repartition(3).write.parquet(gpath)
    gs = b.spark.readStream.schema(b.b_gates.schema).option("maxFilesPerTrigger", 1).parquet(gpath)
    out = scratch_path(b.spark, "outbox-stream")
    # the static side is joined in every micro-batch: compute it once, from one
    # numbering of the names, laid out by run so that no batch shuffles it again
    names = scratch_path(b.spark, "outbox-names")
    N.numbered_names(b.b_file_status).write.parquet(names)
    numbered = b.spark.read.parquet(names)
    previews = _static_by_run(b, N.previews_of(numbered))
    files = _static_by_run(b, N.lists_of(numbered)[1])
    with session_conf(b.spark, spark__sql__session__timeZone="UTC"):
        q = (gs.writeStream.foreachBatch(SS.outbox_writer(out, previews, files=files))
             .option("checkpointLocation", scratch_path(b.spark, "outbox-ckpt"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return OB.read_outbox(b.spark, out).select("request_id", "channel", "part", "payload")


ORACLES["stream_outbox"] = ORACLES["render_notifications"]

ACT = ["b_activity_events"]


def _activities(b):
    """Scheduled activities with their limits, and completions."""
    from ..schemas import activity_timeouts_df
    ev = b.b_activity_events
    lim = activity_timeouts_df(b.spark)
    limit = F.when(F.col("activity") == "execute", F.least(F.col("limit_s"), F.lit(1800))) \
        .otherwise(F.col("limit_s")).cast("int")
    sched = ev.join(lim, "activity", "left").select(
        "activity_id", "run_id", "activity", "scheduled_at", limit.alias("limit_s"))
    done = ev.filter(F.col("completed_after_s").isNotNull()).select(
        "activity_id", F.timestamp_add("SECOND", F.col("completed_after_s"), F.col("scheduled_at"))
        .alias("completed_at"))
    return sched, done


ORACLES["stream_activity_deadlines"] = with_bindings(ACT, f"""
WITH x AS (SELECT e.*, CAST(CASE WHEN e.activity = 'execute' THEN least(l.limit_s, 1800) ELSE l.limit_s END AS INTEGER)
             AS limit_s
      FROM b_activity_events e LEFT JOIN {activity_timeouts_sql()} l ON e.activity = l.activity)
SELECT activity_id, run_id, activity, scheduled_at, limit_s, scheduled_at + to_seconds(limit_s) AS alert_at
FROM x WHERE completed_after_s IS NULL OR completed_after_s > limit_s
""")


@query("stream_activity_deadlines")
def _stream_deadlines(b):
    """S8 with a timer per activity, over five slices in time order: an alert at
    the activity's own deadline, whatever the limits of others."""
    sched, done = _activities(b)
    ends = _ends(sched, "scheduled_at")
    end = _end_marker(b.spark, done.schema, {"activity_id": -1, "completed_at": FAR})
    landed = {
        "scheduled": _arrivals(b, sched.withColumn("slice", F.coalesce(_slice_of(F.col("scheduled_at"), ends), F.lit(0)))),
        "completed": _arrivals(b, done.withColumn("slice", F.coalesce(_slice_of(F.col("completed_at"), ends), F.lit(0)))
                               .union(end.withColumn("slice", F.lit(SLICES - 1))))}
    return _by_slices(b, landed, lambda s: K.deadline_stream(
        SS.to_event_time(s["scheduled"], "scheduled_at"), SS.to_event_time(s["completed"], "completed_at"))).select(
        "activity_id", "run_id", "activity", "scheduled_at", "limit_s", "alert_at")


@query("stream_stuck_activities")
def _stream_stuck(b):
    """Scheduled activities with no completion inside their limit, by a
    stream-stream left outer join with watermarks on both sides."""
    sched, done = _activities(b)
    spath, cpath = scratch_path(b.spark, "sched-src"), scratch_path(b.spark, "done-src")
    sched.write.parquet(spath)
    done.write.parquet(cpath)
    # end-of-input markers on both sides (a sentinel activity far in the future)
    _end_marker(b.spark, sched.schema, {"activity_id": -1, "run_id": -1, "activity": "marker",
                                        "scheduled_at": FAR, "limit_s": 0}) \
        .write.mode("append").parquet(spath)
    _end_marker(b.spark, done.schema, {"activity_id": -1, "completed_at": FAR}) \
        .write.mode("append").parquet(cpath)
    longest = sched.agg(F.max("limit_s").alias("m")).first()["m"] or 0  # one number of the dimension

    def build():
        ss = SS.to_event_time(b.spark.readStream.schema(sched.schema).parquet(spath), "scheduled_at")
        cs = SS.to_event_time(b.spark.readStream.schema(done.schema).parquet(cpath), "completed_at")
        return SS.stuck_activities(ss, cs, max_limit_s=longest, watermark="1 hour")
    r = _run(b, build, "append")
    return r.filter(F.col("activity_id") >= 0).select(
        "activity_id", "run_id", "activity", "scheduled_at", "limit_s", "completed_at")


ORACLES["stream_stuck_activities"] = with_bindings(ACT, f"""
WITH x AS (SELECT e.*, CAST(CASE WHEN e.activity = 'execute' THEN least(l.limit_s, 1800) ELSE l.limit_s END AS INTEGER)
             AS limit_s
      FROM b_activity_events e LEFT JOIN {activity_timeouts_sql()} l ON e.activity = l.activity)
SELECT activity_id, run_id, activity, scheduled_at, limit_s,
       CASE WHEN completed_after_s <= (SELECT max(limit_s) FROM x)
            THEN scheduled_at + to_seconds(completed_after_s) END AS completed_at
FROM x
WHERE completed_after_s IS NULL OR completed_after_s > limit_s
""")
