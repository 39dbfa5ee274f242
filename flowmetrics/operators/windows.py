"""Per-run ordered operators.

Running totals go through :func:`flowmetrics.plans.scan.prefix_scan`, which
splits a hot run by its own order values, so it is spread over many tasks.  Window functions with ``partitionBy`` are used directly only where
the partition is bounded by construction (stages of one run after
aggregation, days after aggregation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import prefix_scan
from ..schemas import (AGENT_MAX_STEPS, COOLDOWN_SECONDS, COOLDOWN_TOKEN_LIMIT,
                       ITERATION_BACKOFF_BASE_S, ITERATION_BACKOFF_MAX_S, MAX_ITERATIONS,
                       RETRY_COEFFICIENT, RETRY_INITIAL_S, RETRY_MAX_ATTEMPTS,
                       RETRY_MAX_INTERVAL_S)

TOTAL = "DECIMAL(38,9)"
RUN_ORDER = ["seq"]


def run_progress(metrics: DataFrame) -> DataFrame:
    """Running tokens, cost and tests passed after each stage."""
    s = prefix_scan(metrics, ["run_id"], RUN_ORDER, [
        ("cum_tokens", "sum", F.col("tokens_used")),
        ("cum_cost", "sum", F.col("cost")),
        ("cum_tests_passed", "count", F.when(F.col("tests_pass"), 1)),
    ])
    return s.select("run_id", "seq", "stage",
                    F.col("cum_tokens").cast("bigint").alias("cum_tokens"),
                    F.col("cum_cost").cast(TOTAL).alias("cum_cost"),
                    F.coalesce(F.col("cum_tests_passed"), F.lit(0)).cast("bigint")
                    .alias("cum_tests_passed"))


def cooldowns(metrics: DataFrame, limit: int = COOLDOWN_TOKEN_LIMIT,
              wait_s: int = COOLDOWN_SECONDS) -> DataFrame:
    """A stage waits ``wait_s`` when the never-reset running token total
    exceeds ``limit`` (quirk Q8: every later stage waits too)."""
    s = prefix_scan(metrics, ["run_id"], RUN_ORDER, [("cum_tokens", "sum", F.col("tokens_used"))])
    return s.select("run_id", "seq", "stage", F.col("cum_tokens").cast("bigint").alias("cum_tokens"),
                    F.when(F.col("cum_tokens") > limit, F.lit(wait_s)).otherwise(F.lit(0))
                    .cast("int").alias("cooldown_s"))


def cooldown_totals(metrics: DataFrame, limit: int = COOLDOWN_TOKEN_LIMIT,
                    wait_s: int = COOLDOWN_SECONDS) -> DataFrame:
    """W2 roll-up: total cooldown wait per run."""
    return cooldowns(metrics, limit, wait_s).groupBy("run_id").agg(
        F.sum("cooldown_s").cast("bigint").alias("total_cooldown_s"),
        F.count(F.when(F.col("cooldown_s") > 0, 1)).cast("bigint").alias("stages_waited"))


def budget_alerts(metrics: DataFrame, limit: str = "1.00") -> DataFrame:
    """The stage at which a run's running cost first exceeds ``limit``."""
    lim = F.lit(limit).cast("decimal(18,9)")
    s = prefix_scan(metrics, ["run_id"], RUN_ORDER, [("cum_cost", "sum", F.col("cost"))])
    prev = F.col("cum_cost") - F.col("cost")
    return s.filter((prev <= lim) & (F.col("cum_cost") > lim)).select(
        "run_id", "seq", "stage", F.col("cum_cost").cast(TOTAL).alias("cum_cost"), "ts")


def stage_timeline(metrics: DataFrame) -> DataFrame:
    """Start and end offsets (and times) of each stage from cumulative
    durations, starting at the run's first timestamp."""
    s = prefix_scan(metrics, ["run_id"], RUN_ORDER, [
        ("end_offset_ms", "sum", F.col("duration_ms")),
        ("run_start", "min", F.col("ts")),
    ])
    start_off = F.col("end_offset_ms") - F.col("duration_ms")
    return s.select(
        "run_id", "seq", "stage",
        start_off.cast("bigint").alias("start_offset_ms"),
        F.col("end_offset_ms").cast("bigint").alias("end_offset_ms"),
        F.timestamp_add("MILLISECOND", start_off, F.col("run_start")).alias("start_at"),
        F.timestamp_add("MILLISECOND", F.col("end_offset_ms"), F.col("run_start")).alias("end_at"))


def run_state(metrics: DataFrame, snapshots: DataFrame, plan: DataFrame | None = None,
              default_stages: int = 6) -> DataFrame:
    """Current stage (latest by seq), totals, snapshots and last snapshot
    per run, and progress ``k/n``: distinct planned stages done of the stages
    that the run's own plan (J1: run_id, stage) holds.  A run without a plan is
    measured against the default workflow's ``default_stages``.  Aggregates only
    (``max_by``), no sort."""
    if plan is not None:
        done = metrics.select("run_id", "stage").distinct().withColumn("_done", F.lit(1))
        planned = plan.select("run_id", "stage").distinct().join(done, ["run_id", "stage"], "left") \
            .groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.count("_done").cast("bigint").alias("_k"))
    m = metrics.groupBy("run_id").agg(
        F.max_by("stage", "seq").alias("current_stage"),
        F.sum("tokens_used").cast("bigint").alias("total_tokens_used"),
        F.sum("cost").cast(TOTAL).alias("total_cost"),
        F.count(F.when(F.col("tests_pass"), 1)).cast("bigint").alias("tests_passed_count"),
        F.count(F.lit(1)).cast("bigint").alias("stages_completed"),
        F.countDistinct("stage").cast("bigint").alias("distinct_stages"))
    s = snapshots.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("snapshots"),
        F.max_by("snapshot_id", F.struct("ts", "event_id")).alias("last_snapshot"))
    out = m.join(s, "run_id", "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0).cast("bigint")))
    n, k = F.lit(default_stages).cast("int"), F.least(F.col("distinct_stages"), F.lit(default_stages).cast("bigint"))
    if plan is not None:
        out = out.join(planned, "run_id", "left")
        n, k = F.coalesce("_n", n), F.coalesce("_k", k)
    return out.withColumn("stages_planned", n) \
        .withColumn("progress", F.concat(k.cast("string"), F.lit("/"), n.cast("string"))).drop("_n", "_k")


def stage_ranking(metrics: DataFrame) -> DataFrame:
    """Stages by cost within a run (pre-aggregated, so each window
    partition holds one run's distinct stages), share of run cost (null for a
    run that cost nothing)."""
    per = metrics.groupBy("run_id", "stage").agg(
        F.sum("cost").cast(TOTAL).alias("cost"),
        F.sum("tokens_used").cast("bigint").alias("tokens"))
    w = Window.partitionBy("run_id")
    return per.select(
        "run_id", "stage", "cost", "tokens",
        F.rank().over(w.orderBy(F.col("cost").desc())).cast("bigint").alias("cost_rank"),
        F.try_divide(F.col("cost").cast("double"), F.sum("cost").over(w).cast("double")).alias("cost_share"))


def period_of(ts: str, grain: str):
    """Start of the period: a date, or a timestamp below the day."""
    start = F.date_trunc(grain, ts)
    below_day = grain.lower() in ("hour", "minute", "second", "millisecond", "microsecond")
    return start if below_day else F.to_date(start)


def usage_trend(metrics: DataFrame, grain: str = "day") -> DataFrame:
    """Tokens and cost per day (aggregated first), change from the
    previous period by ``lag`` over the few period rows."""
    period = F.to_date("ts") if grain == "day" else period_of("ts", grain)
    d = metrics.groupBy(period.alias("period")).agg(
        F.sum("tokens_used").cast("bigint").alias("tokens"),
        F.sum("cost").cast(TOTAL).alias("cost"))
    w = Window.orderBy("period")
    return d.select("period", "tokens", "cost",
                    (F.col("tokens") - F.lag("tokens").over(w)).alias("tokens_change"),
                    (F.col("cost") - F.lag("cost").over(w)).cast(TOTAL).alias("cost_change"))


def stage_order_audit(metrics: DataFrame, ordinals: dict[str, int]) -> DataFrame:
    """Stages that ran after a later template stage already ran."""
    ordmap = F.create_map(*[x for k, v in ordinals.items() for x in (F.lit(k), F.lit(v))])
    m = metrics.withColumn("ordinal", F.element_at(ordmap, F.col("stage")))
    s = prefix_scan(m, ["run_id"], RUN_ORDER, [("prev_max_ordinal", "max", F.col("ordinal"))], frame="before")
    return s.filter(F.col("ordinal") < F.col("prev_max_ordinal")).select(
        "run_id", "seq", "stage", F.col("ordinal").cast("int").alias("ordinal"),
        F.col("prev_max_ordinal").cast("int").alias("prev_max_ordinal"))


def failure_context(metrics: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per error row, tokens / cost / files spent before it and the last
    snapshot at or before it."""
    from .joins import asof_last_snapshot
    s = prefix_scan(metrics, ["run_id"], RUN_ORDER, [
        ("tokens_before", "sum", F.col("tokens_used")),
        ("cost_before", "sum", F.col("cost")),
        ("files_before", "sum", F.col("files_modified").cast("bigint")),
    ], frame="before")
    err = s.filter(F.col("error").isNotNull()).select(
        "run_id", "seq", "event_id", "stage", "error", "ts",
        F.coalesce("tokens_before", F.lit(0)).cast("bigint").alias("tokens_before"),
        F.coalesce("cost_before", F.lit(0)).cast(TOTAL).alias("cost_before"),
        F.coalesce("files_before", F.lit(0)).cast("bigint").alias("files_before"))
    snap = asof_last_snapshot(err, snapshots)
    return snap.select("run_id", "seq", "stage", "error", "tokens_before", "cost_before",
                       "files_before", "snapshot_id")


def iteration_outcomes(iterations: DataFrame, max_iterations: int = MAX_ITERATIONS,
                       backoff_after_last: bool = True) -> DataFrame:
    """Iterations until the first passing one, capped at ``max_iterations``.

    Iteration numbers are positions 1..max, so one partial aggregation per
    issue holds everything: per position k whether it passed and its tokens
    (``max_iterations`` small conditional aggregates, no lists, no join
    back).  Back-off ``min(5 i, 30)`` s follows every failing iteration, the
    last one included (quirk Q7; ``backoff_after_last=False`` drops the wait
    after the final iteration of an exhausted issue)."""
    capped = iterations.filter(F.col("iteration") <= max_iterations)
    ks = range(1, max_iterations + 1)
    it = F.col("iteration")
    g = capped.groupBy("issue_id").agg(
        F.max(it).alias("last_seen"),
        *[F.max(F.when(it == k, F.col("tests_pass"))).alias(f"p{k}") for k in ks],
        *[F.sum(F.when(it == k, F.col("tokens_used"))).alias(f"t{k}") for k in ks])
    first_pass = None
    for k in reversed(ks):
        first_pass = F.when(F.col(f"p{k}"), F.lit(k)) if first_pass is None \
            else F.when(F.col(f"p{k}"), F.lit(k)).otherwise(first_pass)
    g = g.withColumn("first_pass", first_pass)
    n = F.coalesce(F.col("first_pass"), F.col("last_seen"))
    fails = F.when(F.col("first_pass").isNotNull(), F.col("first_pass") - 1) \
        .otherwise(F.col("last_seen"))
    if not backoff_after_last:
        fails = F.when(F.col("first_pass").isNull() & (F.col("last_seen") >= max_iterations),
                       fails - 1).otherwise(fails)
    # sum_{i=1..m} min(base*i, cap), closed form
    base, cap = ITERATION_BACKOFF_BASE_S, ITERATION_BACKOFF_MAX_S
    k_cap = cap // base
    m = fails
    backoff = F.when(m <= k_cap, F.lit(base) * m * (m + 1) / 2) \
        .otherwise(F.lit(base * k_cap * (k_cap + 1) // 2) + F.lit(cap) * (m - k_cap))
    status = (F.when(F.col("first_pass").isNotNull(), "resolved")
              .when(F.col("last_seen") >= max_iterations, "exhausted").otherwise("open"))
    message = (F.when(F.col("first_pass").isNotNull(),
                      F.concat(F.lit("Issue resolved in "), n.cast("string"), F.lit(" iteration(s)")))
               .when(F.col("last_seen") >= max_iterations,
                     F.lit(f"Failed to fix issue after {max_iterations} iterations")))
    upto = F.coalesce(F.col("first_pass"), F.lit(max_iterations))
    tokens = None
    for k in ks:
        term = F.when(F.lit(k) <= upto, F.coalesce(F.col(f"t{k}"), F.lit(0)))
        tokens = term if tokens is None else F.coalesce(tokens, F.lit(0)) + F.coalesce(term, F.lit(0))
    return g.select("issue_id", n.cast("int").alias("iterations"), status.alias("status"),
                    backoff.cast("bigint").alias("backoff_s"), message.alias("message"),
                    tokens.cast("bigint").alias("tokens_used"))


def retry_accounting(attempts: DataFrame, max_attempts: int = RETRY_MAX_ATTEMPTS) -> DataFrame:
    """Attempts of an activity under the retry policy: wait before
    attempt n+1 is ``min(2 * 2^(n-1), 60)`` s; exhausted after 3 attempts."""
    capped = attempts.filter(F.col("iteration") <= max_attempts)
    g = capped.groupBy("issue_id").agg(
        F.min(F.when(F.col("tests_pass"), F.col("iteration"))).alias("first_ok"),
        F.max("iteration").alias("last_seen"))
    used = F.coalesce(F.col("first_ok"), F.col("last_seen"))
    waits = None
    for n in range(1, max_attempts):
        w = min(RETRY_INITIAL_S * RETRY_COEFFICIENT ** (n - 1), RETRY_MAX_INTERVAL_S)
        term = F.when(used > n, F.lit(w)).otherwise(F.lit(0))
        waits = term if waits is None else waits + term
    waits = waits if waits is not None else F.lit(0)
    return g.select("issue_id", used.cast("int").alias("attempts"),
                    F.col("first_ok").isNotNull().alias("succeeded"),
                    (F.col("first_ok").isNull() & (F.col("last_seen") >= max_attempts))
                    .alias("exhausted"),
                    waits.cast("bigint").alias("total_wait_s"))


def agent_traces(steps: DataFrame, max_steps: int = AGENT_MAX_STEPS,
                 arrow: str = "→") -> DataFrame:
    """Agent loop history per run, up to the first failed, DONE or
    COMPLETE decision or ``max_steps`` steps.

    Steps are positions 1..max_steps, so one partial aggregation per run
    holds, per position, whether the loop stops there, the command and its
    outcome; the history string is assembled from those few columns (no
    lists collected, no join back)."""
    head = steps.filter(F.col("step") <= max_steps)
    ks = range(1, max_steps + 1)
    st = F.col("step")
    stop_cond = (~F.col("decision_ok") | (F.instr("decision", "DONE") > 0)
                 | (F.instr("decision", "COMPLETE") > 0))
    g = head.groupBy("run_id").agg(
        F.max(st).alias("last_step"),
        *[F.max(F.when(st == k, stop_cond)).alias(f"s{k}") for k in ks],
        *[F.max(F.when(st == k, F.trim(F.col("decision")))).alias(f"d{k}") for k in ks],
        *[F.max(F.when(st == k, F.col("success"))).alias(f"ok{k}") for k in ks])
    stop = None
    for k in reversed(ks):
        stop = F.when(F.col(f"s{k}"), F.lit(k)) if stop is None \
            else F.when(F.col(f"s{k}"), F.lit(k)).otherwise(stop)
    g = g.withColumn("stop_step", stop)
    ran = [F.col(f"d{k}").isNotNull() & (F.col("stop_step").isNull() | (F.lit(k) < F.col("stop_step")))
           for k in ks]
    lines = [F.when(r, F.concat(F.lit(f"Step {k}: "), F.col(f"d{k}"), F.lit(f" {arrow} "),
                                F.when(F.col(f"ok{k}"), "OK").otherwise("FAILED")))
             for k, r in zip(ks, ran)]
    n_steps = sum((F.when(r, 1).otherwise(0) for r in ran), F.lit(0))
    n_fail = sum((F.when(r & ~F.col(f"ok{k}"), 1).otherwise(0) for k, r in zip(ks, ran)), F.lit(0))
    reason = (F.when(F.col("stop_step").isNotNull(), "stopped")
              .when(F.col("last_step") >= max_steps, "max_steps").otherwise("exhausted"))
    return g.select(
        "run_id", n_steps.cast("int").alias("steps"), n_fail.cast("int").alias("failure_handoffs"),
        F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n").alias("history"),
        reason.alias("stop_reason"),
        F.concat(F.lit("Completed in "), n_steps.cast("string"), F.lit(" steps")).alias("summary"))


__all__ = ["run_progress", "cooldowns", "cooldown_totals", "budget_alerts", "stage_timeline",
           "run_state", "stage_ranking", "usage_trend", "stage_order_audit", "failure_context",
           "iteration_outcomes", "retry_accounting", "agent_traces"]
