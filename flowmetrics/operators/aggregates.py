"""Aggregations over stage metrics and related facts.

All are ``groupBy``/``rollup``/``grouping sets`` with partial (map-side)
aggregation, so a hot key is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FAILURE_CLASSES, branch_name, failure_class, mask_error  # noqa: F401

TOTAL = "DECIMAL(38,9)"


def total_cost(metrics: DataFrame) -> DataFrame:
    """G1: sum of cost over all records."""
    return metrics.agg(F.sum("cost").cast(TOTAL).alias("total_cost"),
                       F.sum("tokens_used").cast("bigint").alias("total_tokens"),
                       F.count(F.lit(1)).cast("bigint").alias("records"))


def stage_cost_report(metrics: DataFrame, total_label: str = "TOTAL") -> DataFrame:
    """Tokens and cost per stage plus a TOTAL row (``rollup``)."""
    r = metrics.rollup("stage").agg(
        F.sum("tokens_used").cast("bigint").alias("tokens"),
        F.sum("cost").cast(TOTAL).alias("cost"),
        F.count(F.lit(1)).cast("bigint").alias("records"),
        F.grouping("stage").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col("stage"))
                    .alias("stage"), "tokens", "cost", "records")


def _ratio(num, den):
    return (num.cast("double") / den.cast("double"))


def run_summary(metrics: DataFrame, snapshots: DataFrame,
                skip_test_stages=("documentation",), reference_denominator: bool = False) -> DataFrame:
    """Per run tokens, cost, tests passed, testable stages, snapshots.

    Testable stages exclude the skip-tests stages; the reference divides by
    stages - 1 instead (quirk Q4), which ``reference_denominator=True``
    reproduces in ``testable_stages``."""
    testable = ~F.col("stage").isin(list(skip_test_stages))
    m = metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("stages"),
        F.sum("tokens_used").cast("bigint").alias("tokens"),
        F.sum("cost").cast(TOTAL).alias("cost"),
        F.count(F.when(testable & F.col("tests_pass"), 1)).cast("bigint").alias("tests_passed"),
        F.count(F.when(testable, 1)).cast("bigint").alias("testable_stages"))
    if reference_denominator:
        m = m.withColumn("testable_stages", F.col("stages") - 1)
    s = snapshots.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("snapshots"))
    return (m.join(s, "run_id", "left")
             .withColumn("snapshots", F.coalesce("snapshots", F.lit(0).cast("bigint"))))


def stage_dashboard(metrics: DataFrame) -> DataFrame:
    """Per stage success rate, mean duration, mean files, cost, runs."""
    n = F.count(F.lit(1))
    return metrics.groupBy("stage").agg(
        n.cast("bigint").alias("records"),
        F.countDistinct("run_id").cast("bigint").alias("runs"),
        _ratio(F.count(F.when(F.col("tests_pass"), 1)), n).alias("test_success_rate"),
        _ratio(F.sum("duration_ms"), n).alias("avg_duration_ms"),
        _ratio(F.sum("files_modified"), n).alias("avg_files_modified"),
        F.sum("tokens_used").cast("bigint").alias("tokens"),
        F.sum("cost").cast(TOTAL).alias("cost"))


def failure_patterns(metrics: DataFrame, stage_names, k: int = 20) -> DataFrame:
    """Masked error text with class, counted; top ``k`` by count."""
    e = metrics.filter(F.col("error").isNotNull()).select(
        mask_error(F.col("error"), stage_names).alias("pattern"),
        failure_class(F.col("error")).alias("failure_class"), "run_id")
    g = e.groupBy("failure_class", "pattern").agg(
        F.count(F.lit(1)).cast("bigint").alias("occurrences"),
        F.countDistinct("run_id").cast("bigint").alias("runs"))
    return g.orderBy(F.col("occurrences").desc(), "pattern", "failure_class").limit(k)


def code_churn(metrics: DataFrame) -> DataFrame:
    """Files and lines per run, per stage and overall (grouping sets)."""
    g = metrics.groupingSets([["run_id"], ["stage"], []], "run_id", "stage").agg(
        F.sum("files_modified").cast("bigint").alias("files_modified"),
        F.sum("lines_added").cast("bigint").alias("lines_added"),
        F.sum("lines_removed").cast("bigint").alias("lines_removed"),
        F.grouping_id().alias("_gid"))
    grain = (F.when(F.col("_gid") == 1, "run").when(F.col("_gid") == 2, "stage")
             .otherwise("all"))
    return g.select(grain.alias("grain"), "run_id", "stage", "files_modified", "lines_added",
                    "lines_removed",
                    (F.col("lines_added") - F.col("lines_removed")).alias("net_lines"))


def slow_stages(metrics: DataFrame, k: int = 20) -> DataFrame:
    """L1: the ``k`` longest stages, ties by run and seq (TakeOrderedAndProject)."""
    return (metrics.select("run_id", "seq", "stage", "duration_ms")
            .orderBy(F.col("duration_ms").desc(), "run_id", "seq").limit(k))


def failed_stages(metrics: DataFrame, include_errors: bool = False) -> DataFrame:
    """Rows with tests_pass = false; ``include_errors`` adds rows with an
    error (failure rows keep the default tests_pass = true, quirk Q1)."""
    cond = ~F.col("tests_pass")
    if include_errors:
        cond = cond | F.col("error").isNotNull()
    return metrics.filter(cond).select("run_id", "seq", "stage", "tests_pass", "error", "ts")


def command_metrics(commands: DataFrame) -> DataFrame:
    """Success rate (strict rule) and mean tokens per command category."""
    from ..functions.text import strict_success
    cat = F.regexp_extract("command", r"^/([^:]+):", 1)
    ok = strict_success(F.col("exit_code"), F.col("output"))
    n = F.count(F.lit(1))
    return commands.groupBy(cat.alias("category")).agg(
        n.cast("bigint").alias("invocations"),
        _ratio(F.count(F.when(ok, 1)), n).alias("success_rate"),
        _ratio(F.sum("tokens_used"), n).alias("avg_tokens"))


def feature_results(feature_runs: DataFrame, dialect: str = "python") -> DataFrame:
    """One row per feature that returned (raised ones are dropped from the
    list, as the gather does), with branch and OK / FAILED."""
    f = feature_runs.filter(~F.col("raised"))
    return f.select("run_id", "idx", "feature",
                    branch_name(F.col("idx"), F.col("feature"), dialect).alias("branch"),
                    "success", F.when(F.col("success"), "OK").otherwise("FAILED").alias("status"),
                    "tokens_used")


def feature_summary(feature_runs: DataFrame) -> DataFrame:
    """G7 roll-up: per run features returned, OK, failed and raised apart."""
    return feature_runs.groupBy("run_id").agg(
        F.count(F.when(~F.col("raised"), 1)).cast("bigint").alias("returned"),
        F.count(F.when(~F.col("raised") & F.col("success"), 1)).cast("bigint").alias("ok"),
        F.count(F.when(~F.col("raised") & ~F.col("success"), 1)).cast("bigint").alias("failed"),
        F.count(F.when(F.col("raised"), 1)).cast("bigint").alias("raised"),
        F.sum(F.when(~F.col("raised"), F.col("tokens_used"))).cast("bigint").alias("tokens_used"))


def parallel_speedup(feature_runs: DataFrame) -> DataFrame:
    """serial = sum of durations, elapsed = max, speed-up = serial/elapsed."""
    g = feature_runs.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("features"),
        F.sum("duration_ms").cast("bigint").alias("serial_ms"),
        F.max("duration_ms").cast("bigint").alias("elapsed_ms"))
    return g.withColumn("speedup", F.try_divide(F.col("serial_ms").cast("double"),
                                                F.col("elapsed_ms").cast("double")))


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """Snapshots per run: count, first and last in creation order."""
    o = F.struct("ts", "event_id")
    return snapshots.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("snapshots"),
        F.min_by("snapshot_id", o).alias("first_snapshot"),
        F.max_by("snapshot_id", o).alias("last_snapshot"),
        F.max("ts").alias("last_snapshot_ts"))


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """G11 as rows: every snapshot of a run with its creation ordinal and
    whether it is the last one (a list per run, without collecting one)."""
    from ..plans.scan import row_number_scan
    n = row_number_scan(snapshots.select("run_id", "event_id", "snapshot_id", "ts"), ["run_id"],
                        ["ts", "event_id"], "ordinal")
    last = snapshots.groupBy("run_id").agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    return n.join(last, "run_id").select("run_id", "ordinal", "snapshot_id", "ts",
                                          (F.col("ordinal") == F.col("_n")).alias("is_last"))


def delivery_results(attempts: DataFrame) -> DataFrame:
    """A composite notification succeeded if any channel did; channels
    tried and the (at most a handful of) channels that failed."""
    return attempts.groupBy("request_id").agg(
        F.bool_or("ok").alias("delivered"),
        F.countDistinct("channel").cast("bigint").alias("channels_tried"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("channel")))).alias("failed_channels"),
        F.count(F.lit(1)).cast("bigint").alias("attempts"))


def coverage_trend(test_results: DataFrame, grain: str = "month") -> DataFrame:
    """Mean coverage (nulls ignored) per period and framework."""
    from .windows import period_of
    period = period_of("ts", grain)
    return test_results.groupBy(period.alias("period"), "framework").agg(
        F.count(F.lit(1)).cast("bigint").alias("test_runs"),
        F.count("coverage").cast("bigint").alias("with_coverage"),
        _ratio(F.sum("coverage"), F.count("coverage")).alias("avg_coverage"))
