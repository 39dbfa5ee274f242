"""Join operators.

Look-ups against fixed dimensions are broadcast left joins (the dimensions
are tens of rows).  Fact-to-fact joins are pre-aggregated to one row per key
on at least one side, so a hot key cannot multiply pairs; the as-of join is a
union plus a skew-safe carry-forward scan rather than a range self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import ms_between
from ..plans.scan import prefix_scan
from ..schemas import DEFAULT_WORKFLOW_TYPE, STAGE_TEMPLATES, default_rate

TOTAL = "DECIMAL(38,9)"




def asof_last_snapshot(left: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Backward as-of join: for every ``left`` row (run_id, ts, event_id, ...)
    the latest snapshot of the same run taken at or before ``ts``.  Snapshots
    sort before left rows on equal ``ts``.  Adds ``snapshot_id`` and
    ``snapshot_ts`` (null when there is none)."""
    snap = snapshots.select("run_id", "ts", "event_id", F.lit(0).alias("_side"),
                            F.col("snapshot_id").alias("_sid"), F.col("ts").alias("_sts"))
    lhs = left.withColumn("_side", F.lit(1))
    u = lhs.unionByName(snap, allowMissingColumns=True)
    carried = prefix_scan(
        u, ["run_id"], ["ts", "_side", "event_id"],
        [("_snap", "last", F.when(F.col("_side") == 0, F.struct(F.col("_sid").alias("id"),
                                                               F.col("_sts").alias("ts"))))])
    return (carried.filter(F.col("_side") == 1)
            .withColumn("snapshot_id", F.col("_snap").getField("id"))
            .withColumn("snapshot_ts", F.col("_snap").getField("ts"))
            .drop("_side", "_sid", "_sts", "_snap"))


def rollback_targets(metrics: DataFrame, snapshots: DataFrame,
                     critical_stages: list[str] | None = None, critical_only: bool = True) -> DataFrame:
    """For each failed critical stage, the latest snapshot at or before it
    and the work lost since then (ms).  ``critical_stages`` defaults to those of
    the default workflow's template; ``critical_only=False`` takes every failed
    stage."""
    f = metrics.filter(~F.col("tests_pass"))
    if critical_only:
        critical = critical_stages if critical_stages is not None else [
            name for wt, _, name, _, _, path, _ in STAGE_TEMPLATES if wt == DEFAULT_WORKFLOW_TYPE and path]
        f = f.filter(F.col("stage").isin(critical))
    f = f.select("run_id", "seq", "stage", "ts", "event_id")
    j = asof_last_snapshot(f, snapshots)
    return j.select("run_id", "seq", "stage", F.col("ts").alias("failed_at"), "snapshot_id",
                    "snapshot_ts", ms_between("snapshot_ts", "ts").alias("work_lost_ms"))


def resolve_snapshots(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """Snapshot id -> newest commit of the run whose message names it;
    a missing one is a row with error text.  Commits are reduced to one row
    per (run, snapshot id) before the join."""
    c = (commits.withColumn("sid", F.nullif(F.regexp_extract("message", r"Snapshot: (\S+)", 1),
                                            F.lit("")))
         .filter(F.col("sid").isNotNull())
         .groupBy("run_id", "sid")
         .agg(F.max_by("hash", F.struct("ts", "event_id")).alias("commit_hash")))
    r = requests.select("run_id", "snapshot_id")
    j = r.join(c, (r["run_id"] == c["run_id"]) & (r["snapshot_id"] == c["sid"]), "left")
    return j.select(r["run_id"], "snapshot_id", "commit_hash",
                    F.when(F.col("commit_hash").isNull(),
                           F.concat(F.lit("Snapshot not found: "), F.col("snapshot_id")))
                    .alias("error"))


def estimate_variance(executions: DataFrame, estimates: DataFrame) -> DataFrame:
    """Actual cost of each execution against its estimate."""
    rate = F.lit(default_rate()).cast("decimal(12,9)")
    chars = F.length(F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("output", F.lit(""))))
    actual = executions.select("run_id", "seq",
                               F.floor(chars / 4).cast("bigint").alias("actual_tokens"))
    j = estimates.join(actual, ["run_id", "seq"])
    act_cost = (F.col("actual_tokens") * rate).cast(TOTAL)
    return j.select(
        "run_id", "seq", "complexity", "tokens_estimate", "estimated_cost", "actual_tokens",
        act_cost.alias("actual_cost"),
        (act_cost - F.col("estimated_cost")).cast(TOTAL).alias("variance"),
        F.try_divide(act_cost.cast("double"), F.col("estimated_cost").cast("double"))
        .alias("actual_to_estimate"),
        (act_cost > F.col("estimated_cost")).alias("over_budget"))


def estimate_summary(variance: DataFrame) -> DataFrame:
    """J5 roll-up: per complexity, executions, share over budget and total
    estimated against actual cost."""
    n = F.count(F.lit(1))
    return variance.groupBy("complexity").agg(
        n.cast("bigint").alias("executions"),
        (F.count(F.when(F.col("over_budget"), 1)).cast("double") / n.cast("double"))
        .alias("share_over_budget"),
        F.sum("estimated_cost").cast(TOTAL).alias("estimated_cost"),
        F.sum("actual_cost").cast(TOTAL).alias("actual_cost"))


def reconcile_spend(run_totals_source: DataFrame, metrics: DataFrame) -> DataFrame:
    """Run totals (every stage executed) against the sum of metrics rows
    (stages that wrote one); both reduced per run, then a full outer join."""
    t = run_totals_source.groupBy("run_id").agg(
        F.sum("tokens_used").cast("bigint").alias("total_tokens"),
        F.sum("cost").cast(TOTAL).alias("total_cost"))
    m = metrics.groupBy("run_id").agg(
        F.sum("tokens_used").cast("bigint").alias("metric_tokens"),
        F.sum("cost").cast(TOTAL).alias("metric_cost"))
    j = t.join(m, "run_id", "full_outer")
    status = (F.when(F.col("metric_tokens").isNull(), "no_metrics")
              .when(F.col("total_tokens").isNull(), "no_totals")
              .when((F.col("total_tokens") == F.col("metric_tokens"))
                    & (F.col("total_cost") == F.col("metric_cost")), "match")
              .otherwise("mismatch"))
    return j.select("run_id", "total_tokens", "metric_tokens", "total_cost", "metric_cost",
                    (F.coalesce("total_tokens", F.lit(0)) - F.coalesce("metric_tokens", F.lit(0)))
                    .cast("bigint").alias("diff_tokens"),
                    (F.coalesce("total_cost", F.lit(0)) - F.coalesce("metric_cost", F.lit(0)))
                    .cast(TOTAL).alias("diff_cost"),
                    status.alias("status"))


def activity_timeouts(events: DataFrame, limits: DataFrame,
                      configured_timeout_s: int = 1800) -> DataFrame:
    """Scheduled activities with no completion inside their limit; the
    execute activity is also capped by the configured execution timeout."""
    j = events.join(limits, "activity", "left")
    lim = F.when(F.col("activity") == "execute",
                 F.least(F.col("limit_s"), F.lit(configured_timeout_s))).otherwise(F.col("limit_s"))
    j = j.withColumn("limit_s", lim.cast("int"))
    status = (F.when(F.col("completed_after_s").isNull(), "never_completed")
              .when(F.col("completed_after_s") > F.col("limit_s"), "timed_out").otherwise("ok"))
    return (j.withColumn("status", status).filter(F.col("status") != "ok")
            .select("activity_id", "run_id", "activity", "scheduled_at", "limit_s",
                    "completed_after_s", "status",
                    F.timestamp_add("SECOND", F.col("limit_s"), F.col("scheduled_at"))
                    .alias("deadline")))


def activity_event_rows(events: DataFrame) -> DataFrame:
    """One row per event kind (ActivityScheduled / ActivityCompleted) from
    scheduled activities with an optional completion delay."""
    sched = events.select("activity_id", "run_id", "activity",
                          F.lit("ActivityScheduled").alias("kind"), F.col("scheduled_at").alias("at"))
    done = events.filter(F.col("completed_after_s").isNotNull()).select(
        "activity_id", "run_id", "activity", F.lit("ActivityCompleted").alias("kind"),
        F.timestamp_add("SECOND", F.col("completed_after_s"), F.col("scheduled_at")).alias("at"))
    return sched.unionByName(done)


def activity_durations(events: DataFrame, order_col: str | None = None) -> DataFrame:
    """Pair each ActivityScheduled event with its ActivityCompleted.

    ``events``: run_id, activity_id (may be null), activity, kind, at.  With
    an id the pair is found by aggregation on the id (a pivot of the two
    kinds).  Without one, a Scheduled event takes the next Completed event
    of its run in time order (a completion at the same instant counts as
    earlier); ``order_col`` breaks remaining ties.  That is a forward scan,
    so no pairs are formed and a hot run is split like any other scan."""
    with_id = events.filter(F.col("activity_id").isNotNull())
    p = with_id.groupBy("activity_id", "run_id").agg(
        F.max("activity").alias("activity"),
        F.min(F.when(F.col("kind") == "ActivityScheduled", F.col("at"))).alias("scheduled_at"),
        F.min(F.when(F.col("kind") == "ActivityCompleted", F.col("at"))).alias("completed_at"))
    out = p.select("activity_id", "run_id", "activity", "scheduled_at", "completed_at")

    no_id = events.filter(F.col("activity_id").isNull())
    kind_order = F.when(F.col("kind") == "ActivityCompleted", 0).otherwise(1)
    staged = no_id.withColumn("_k", kind_order)
    order = ["at", "_k"] + ([order_col] if order_col else [])
    nxt = prefix_scan(staged, ["run_id"], order,
                      [("completed_at", "first", F.when(F.col("_k") == 0, F.col("at")))], "after")
    paired = nxt.filter(F.col("_k") == 1).select(
        F.col("activity_id").cast(out.schema["activity_id"].dataType), "run_id", "activity",
        F.col("at").alias("scheduled_at"), "completed_at")
    return out.unionByName(paired).withColumn("duration_ms", ms_between("scheduled_at", "completed_at"))


def command_catalogue(commands: DataFrame, catalog: DataFrame) -> DataFrame:
    """Split ``/category:name``, match the catalogue, count per command."""
    c = commands.select(
        "command",
        F.nullif(F.regexp_extract("command", r"^/([^:]+):", 1), F.lit("")).alias("category"),
        F.nullif(F.regexp_extract("command", r"^/[^:]+:(\S+)", 1), F.lit("")).alias("name"))
    g = c.groupBy("command", "category", "name").agg(F.count(F.lit(1)).cast("bigint").alias("uses"))
    cat = catalog.select(F.col("category").alias("_cc"), F.col("name").alias("_cn"),
                         F.lit(True).alias("_k"))
    j = g.join(cat, (g["category"] == cat["_cc"]) & (g["name"] == cat["_cn"]), "left")
    return j.select("command", "category", "name", "uses",
                    F.coalesce("_k", F.lit(False)).alias("known"))


def new_files(file_status: DataFrame) -> DataFrame:
    """Files in the ``after`` listing that are not in the ``before``
    listing (name = last blank-separated token), counted per run and file."""
    name = F.element_at(F.split(F.col("path"), " "), -1)
    before = file_status.filter(F.col("phase") == "before") \
        .select("run_id", name.alias("name")).distinct()
    # count per (run, file) first: partial aggregation collapses a hot run's
    # repeated names before the anti join shuffles them
    after = (file_status.filter(F.col("phase") == "after").select("run_id", name.alias("name"))
             .groupBy("run_id", "name").agg(F.count(F.lit(1)).cast("bigint").alias("occurrences")))
    d = after.join(before, ["run_id", "name"], "left_anti").filter(F.col("name") != "")
    return d.select("run_id", F.col("name").alias("path"), "occurrences")
