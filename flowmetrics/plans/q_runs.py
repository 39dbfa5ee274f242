"""Registered queries over run telemetry: aggregations, windows, top-k."""

from __future__ import annotations

from .. import schemas as S
from ..operators import aggregates as agg
from ..operators import stages as ST
from .registry import query

SM = ["b_stage_metrics"]


@query("stage_cost_report", bindings=SM, oracle="""
SELECT CASE WHEN grouping(stage) = 1 THEN 'TOTAL' ELSE stage END AS stage,
       CAST(sum(tokens_used) AS BIGINT) AS tokens,
       CAST(sum(cost) AS DECIMAL(38,9)) AS cost,
       CAST(count(*) AS BIGINT) AS records
FROM b_stage_metrics GROUP BY ROLLUP (stage)
""")
def _stage_cost_report(b):
    """Tokens and cost per stage, plus TOTAL."""
    return agg.stage_cost_report(b.b_stage_metrics)


@query("total_cost", bindings=SM, oracle="""
SELECT CAST(sum(cost) AS DECIMAL(38,9)) AS total_cost,
       CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
       CAST(count(*) AS BIGINT) AS records
FROM b_stage_metrics
""")
def _total_cost(b):
    """G1: total cost over all records."""
    return agg.total_cost(b.b_stage_metrics)


from pyspark.sql import functions as F  # noqa: E402

from ..operators import joins as J  # noqa: E402
from ..operators import windows as W  # noqa: E402
from ..schemas import known_stage_names, stage_ordinals  # noqa: E402

RUNWIN = "PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
RUNPREV = "PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("run_summary", bindings=SM + ["b_snapshots"], oracle="""
SELECT m.run_id, m.stages, m.tokens, m.cost, m.tests_passed, m.testable_stages,
       COALESCE(s.snapshots, 0) AS snapshots
FROM (SELECT run_id, CAST(count(*) AS BIGINT) AS stages, CAST(sum(tokens_used) AS BIGINT) AS tokens,
             CAST(sum(cost) AS DECIMAL(38,9)) AS cost,
             CAST(sum(CASE WHEN stage <> 'documentation' AND tests_pass THEN 1 ELSE 0 END) AS BIGINT) AS tests_passed,
             CAST(sum(CASE WHEN stage <> 'documentation' THEN 1 ELSE 0 END) AS BIGINT) AS testable_stages
      FROM b_stage_metrics GROUP BY run_id) m
LEFT JOIN (SELECT run_id, CAST(count(*) AS BIGINT) AS snapshots FROM b_snapshots GROUP BY run_id) s
  ON m.run_id = s.run_id
""")
def _run_summary(b):
    """Per-run totals."""
    return agg.run_summary(b.b_stage_metrics, b.b_snapshots)


@query("stage_dashboard", bindings=SM, oracle="""
SELECT stage, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT run_id) AS BIGINT) AS runs,
       CAST(sum(CASE WHEN tests_pass THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS test_success_rate,
       CAST(sum(duration_ms) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_duration_ms,
       CAST(sum(files_modified) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_files_modified,
       CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(cost) AS DECIMAL(38,9)) AS cost
FROM b_stage_metrics GROUP BY stage
""")
def _stage_dashboard(b):
    """Per-stage dashboard panels."""
    return agg.stage_dashboard(b.b_stage_metrics)


def _failure_sql():
    names = sorted(known_stage_names(), key=len, reverse=True)
    stages = "|".join(s.replace("-", "\\-") for s in names)
    cls = " ".join(f"WHEN instr(error, '{needle}') > 0 THEN '{c}'"
                   for c, needle in agg.FAILURE_CLASSES)
    return f"""
SELECT failure_class, pattern, CAST(count(*) AS BIGINT) AS occurrences,
       CAST(count(DISTINCT run_id) AS BIGINT) AS runs
FROM (SELECT run_id,
             regexp_replace(regexp_replace(regexp_replace(error, '''[^'']*''', '<q>', 'g'),
                 '\\b({stages}|iteration-[0-9]+|feature-[^ ]+)\\b', '<stage>', 'g'),
                 '[0-9]+', '<n>', 'g') AS pattern,
             CASE {cls} ELSE 'other' END AS failure_class
      FROM b_stage_metrics WHERE error IS NOT NULL) e
GROUP BY failure_class, pattern
ORDER BY occurrences DESC, pattern, failure_class LIMIT 20
"""


@query("failure_patterns", bindings=SM, oracle=_failure_sql())
def _failure_patterns(b):
    """Masked failure texts by class, top 20."""
    return agg.failure_patterns(b.b_stage_metrics, known_stage_names(), 20)


@query("code_churn", bindings=SM, oracle="""
SELECT CASE GROUPING(run_id, stage) WHEN 1 THEN 'run' WHEN 2 THEN 'stage' ELSE 'all' END AS grain,
       run_id, stage,
       CAST(sum(files_modified) AS BIGINT) AS files_modified,
       CAST(sum(lines_added) AS BIGINT) AS lines_added,
       CAST(sum(lines_removed) AS BIGINT) AS lines_removed,
       CAST(sum(lines_added) AS BIGINT) - CAST(sum(lines_removed) AS BIGINT) AS net_lines
FROM b_stage_metrics GROUP BY GROUPING SETS ((run_id), (stage), ())
""")
def _code_churn(b):
    """Churn per run, per stage and overall."""
    return agg.code_churn(b.b_stage_metrics)


@query("slow_stages", bindings=SM, oracle="""
SELECT run_id, seq, stage, duration_ms FROM b_stage_metrics
ORDER BY duration_ms DESC, run_id, seq LIMIT 20
""")
def _slow_stages(b):
    """L1: top-20 longest stages."""
    return agg.slow_stages(b.b_stage_metrics, 20)


@query("failed_stages", bindings=SM, oracle="""
SELECT run_id, seq, stage, tests_pass, error, ts FROM b_stage_metrics WHERE NOT tests_pass
""")
def _failed_stages(b):
    """Documented failed-stage filter."""
    return agg.failed_stages(b.b_stage_metrics)


@query("failed_stages_with_errors", bindings=SM, oracle="""
SELECT run_id, seq, stage, tests_pass, error, ts FROM b_stage_metrics
WHERE NOT tests_pass OR error IS NOT NULL
""")
def _failed_stages_err(b):
    """B6 with include_errors (Q1)."""
    return agg.failed_stages(b.b_stage_metrics, include_errors=True)


@query("run_progress", bindings=SM, oracle=f"""
SELECT run_id, seq, stage,
       CAST(sum(tokens_used) OVER ({RUNWIN}) AS BIGINT) AS cum_tokens,
       CAST(sum(cost) OVER ({RUNWIN}) AS DECIMAL(38,9)) AS cum_cost,
       CAST(sum(CASE WHEN tests_pass THEN 1 ELSE 0 END) OVER ({RUNWIN}) AS BIGINT) AS cum_tests_passed
FROM b_stage_metrics
""")
def _run_progress(b):
    """Running totals per run."""
    return W.run_progress(b.b_stage_metrics)


@query("cooldowns", bindings=SM, oracle=f"""
SELECT run_id, seq, stage, cum_tokens,
       CAST(CASE WHEN cum_tokens > 50000 THEN 30 ELSE 0 END AS INTEGER) AS cooldown_s
FROM (SELECT run_id, seq, stage, CAST(sum(tokens_used) OVER ({RUNWIN}) AS BIGINT) AS cum_tokens
      FROM b_stage_metrics) t
""")
def _cooldowns(b):
    """Cooldown after each stage."""
    return W.cooldowns(b.b_stage_metrics)


@query("cooldown_totals", bindings=SM, oracle=f"""
SELECT run_id, CAST(sum(CASE WHEN cum_tokens > 50000 THEN 30 ELSE 0 END) AS BIGINT) AS total_cooldown_s,
       CAST(sum(CASE WHEN cum_tokens > 50000 THEN 1 ELSE 0 END) AS BIGINT) AS stages_waited
FROM (SELECT run_id, sum(tokens_used) OVER ({RUNWIN}) AS cum_tokens FROM b_stage_metrics) t
GROUP BY run_id
""")
def _cooldown_totals(b):
    """Total cooldown per run."""
    return W.cooldown_totals(b.b_stage_metrics)


@query("budget_alerts", bindings=SM, oracle=f"""
SELECT run_id, seq, stage, CAST(cum_cost AS DECIMAL(38,9)) AS cum_cost, ts
FROM (SELECT run_id, seq, stage, ts, cost, sum(cost) OVER ({RUNWIN}) AS cum_cost FROM b_stage_metrics) t
WHERE cum_cost - cost <= CAST(1.00 AS DECIMAL(18,9)) AND cum_cost > CAST(1.00 AS DECIMAL(18,9))
""")
def _budget_alerts(b):
    """First stage where running cost exceeds 1.00."""
    return W.budget_alerts(b.b_stage_metrics, "1.00")


@query("stage_timeline", bindings=SM, oracle=f"""
SELECT run_id, seq, stage, CAST(end_off - duration_ms AS BIGINT) AS start_offset_ms,
       CAST(end_off AS BIGINT) AS end_offset_ms,
       run_start + to_milliseconds(CAST(end_off - duration_ms AS BIGINT)) AS start_at,
       run_start + to_milliseconds(CAST(end_off AS BIGINT)) AS end_at
FROM (SELECT run_id, seq, stage, duration_ms, sum(duration_ms) OVER ({RUNWIN}) AS end_off,
             min(ts) OVER ({RUNWIN}) AS run_start FROM b_stage_metrics) t
""")
def _stage_timeline(b):
    """Stage start/end from cumulative durations."""
    return W.stage_timeline(b.b_stage_metrics)


RUN_TYPE = "CASE run_id % 4 WHEN 0 THEN 'llm-wrapper' WHEN 1 THEN 'api' WHEN 2 THEN 'frontend' END"


@query("run_state", bindings=SM + ["b_snapshots"], oracle=f"""
SELECT m.*, COALESCE(s.snapshots, 0) AS snapshots, s.last_snapshot,
       CAST(p.n AS INTEGER) AS stages_planned,
       CAST(p.k AS VARCHAR) || '/' || CAST(p.n AS VARCHAR) AS progress
FROM (SELECT run_id, arg_max(stage, seq) AS current_stage,
             CAST(sum(tokens_used) AS BIGINT) AS total_tokens_used,
             CAST(sum(cost) AS DECIMAL(38,9)) AS total_cost,
             CAST(sum(CASE WHEN tests_pass THEN 1 ELSE 0 END) AS BIGINT) AS tests_passed_count,
             CAST(count(*) AS BIGINT) AS stages_completed,
             CAST(count(DISTINCT stage) AS BIGINT) AS distinct_stages
      FROM b_stage_metrics GROUP BY run_id) m
LEFT JOIN (SELECT run_id, CAST(count(*) AS BIGINT) AS snapshots, arg_max(snapshot_id, ts) AS last_snapshot
           FROM b_snapshots GROUP BY run_id) s ON m.run_id = s.run_id
JOIN (SELECT r.run_id, count(*) AS n, count(d.stage) AS k
      FROM (SELECT DISTINCT run_id, COALESCE({RUN_TYPE}, 'llm-wrapper') AS wt FROM b_stage_metrics) r
      JOIN {S.templates_sql()} t ON t.workflow_type = r.wt
      LEFT JOIN (SELECT DISTINCT run_id, stage FROM b_stage_metrics) d ON d.run_id = r.run_id AND d.stage = t.name
      GROUP BY r.run_id) p ON p.run_id = m.run_id
""")
def _run_state(b):
    """Current run state with progress k/n against the run's own plan."""
    runs = b.b_stage_metrics.select("run_id").distinct().select(
        "run_id", F.expr(RUN_TYPE).alias("workflow_type"), F.lit("/p").alias("project_path"))
    return W.run_state(b.b_stage_metrics, b.b_snapshots, ST.stage_plan(runs, S.templates_df(b.spark)))


@query("stage_ranking", bindings=SM, oracle="""
SELECT run_id, stage, cost, tokens,
       CAST(rank() OVER (PARTITION BY run_id ORDER BY cost DESC) AS BIGINT) AS cost_rank,
       CAST(cost AS DOUBLE) / CAST(sum(cost) OVER (PARTITION BY run_id) AS DOUBLE) AS cost_share
FROM (SELECT run_id, stage, CAST(sum(cost) AS DECIMAL(38,9)) AS cost,
             CAST(sum(tokens_used) AS BIGINT) AS tokens FROM b_stage_metrics GROUP BY run_id, stage) t
""")
def _stage_ranking(b):
    """Stage cost rank and share per run."""
    return W.stage_ranking(b.b_stage_metrics)


@query("usage_trend", bindings=SM, oracle="""
SELECT period, tokens, cost, tokens - lag(tokens) OVER (ORDER BY period) AS tokens_change,
       CAST(cost - lag(cost) OVER (ORDER BY period) AS DECIMAL(38,9)) AS cost_change
FROM (SELECT CAST(ts AS DATE) AS period, CAST(sum(tokens_used) AS BIGINT) AS tokens,
             CAST(sum(cost) AS DECIMAL(38,9)) AS cost FROM b_stage_metrics GROUP BY 1) d
""")
def _usage_trend(b):
    """Daily usage and day-over-day change."""
    return W.usage_trend(b.b_stage_metrics)


def _ord_case():
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in stage_ordinals().items())
    return f"CASE stage {whens} END"


@query("stage_order_audit", bindings=SM, oracle=f"""
SELECT run_id, seq, stage, CAST(ordinal AS INTEGER) AS ordinal, CAST(prev_max AS INTEGER) AS prev_max_ordinal
FROM (SELECT run_id, seq, stage, ordinal, max(ordinal) OVER ({RUNPREV}) AS prev_max
      FROM (SELECT *, {_ord_case()} AS ordinal FROM b_stage_metrics) a) t
WHERE ordinal < prev_max
""")
def _stage_order_audit(b):
    """Stages run after a later template stage."""
    return W.stage_order_audit(b.b_stage_metrics, stage_ordinals())


@query("failure_context", bindings=SM + ["b_snapshots"], oracle=f"""
SELECT f.run_id, f.seq, f.stage, f.error, f.tokens_before, f.cost_before, f.files_before, s.snapshot_id
FROM (SELECT * FROM (
        SELECT run_id, seq, stage, error, ts,
               CAST(COALESCE(sum(tokens_used) OVER ({RUNPREV}), 0) AS BIGINT) AS tokens_before,
               CAST(COALESCE(sum(cost) OVER ({RUNPREV}), 0) AS DECIMAL(38,9)) AS cost_before,
               CAST(COALESCE(sum(files_modified) OVER ({RUNPREV}), 0) AS BIGINT) AS files_before
        FROM b_stage_metrics) x WHERE error IS NOT NULL) f
ASOF LEFT JOIN b_snapshots s ON f.run_id = s.run_id AND f.ts >= s.ts
""")
def _failure_context(b):
    """Spend and last snapshot before each failure."""
    return W.failure_context(b.b_stage_metrics, b.b_snapshots)


@query("iteration_outcomes", bindings=["b_iterations"], oracle="""
WITH c AS (SELECT * FROM b_iterations WHERE iteration <= 5),
g AS (SELECT issue_id, min(CASE WHEN tests_pass THEN iteration END) AS first_pass,
             max(iteration) AS last_seen FROM c GROUP BY issue_id),
t AS (SELECT c.issue_id, sum(c.tokens_used) AS tokens_used FROM c JOIN g ON c.issue_id = g.issue_id
      WHERE g.first_pass IS NULL OR c.iteration <= g.first_pass GROUP BY c.issue_id),
f AS (SELECT g.*, CASE WHEN first_pass IS NOT NULL THEN first_pass - 1 ELSE last_seen END AS fails,
             COALESCE(first_pass, last_seen) AS n FROM g)
SELECT f.issue_id, CAST(n AS INTEGER) AS iterations,
       CASE WHEN first_pass IS NOT NULL THEN 'resolved' WHEN last_seen >= 5 THEN 'exhausted' ELSE 'open' END AS status,
       CAST(CASE WHEN fails <= 6 THEN 5 * fails * (fails + 1) // 2 ELSE 105 + 30 * (fails - 6) END AS BIGINT) AS backoff_s,
       CASE WHEN first_pass IS NOT NULL THEN 'Issue resolved in ' || CAST(n AS VARCHAR) || ' iteration(s)'
            WHEN last_seen >= 5 THEN 'Failed to fix issue after 5 iterations' END AS message,
       CAST(t.tokens_used AS BIGINT) AS tokens_used
FROM f JOIN t ON f.issue_id = t.issue_id
""")
def _iteration_outcomes(b):
    """Iterations until the first pass, back-off, outcome."""
    return W.iteration_outcomes(b.b_iterations)


@query("retry_accounting", bindings=["b_iterations"], oracle="""
SELECT issue_id, CAST(used AS INTEGER) AS attempts, first_ok IS NOT NULL AS succeeded,
       (first_ok IS NULL AND last_seen >= 3) AS exhausted,
       CAST((CASE WHEN used > 1 THEN 2 ELSE 0 END) + (CASE WHEN used > 2 THEN 4 ELSE 0 END) AS BIGINT) AS total_wait_s
FROM (SELECT issue_id, min(CASE WHEN tests_pass THEN iteration END) AS first_ok, max(iteration) AS last_seen,
             COALESCE(min(CASE WHEN tests_pass THEN iteration END), max(iteration)) AS used
      FROM b_iterations WHERE iteration <= 3 GROUP BY issue_id) g
""")
def _retry_accounting(b):
    """Retry attempts and waits."""
    return W.retry_accounting(b.b_iterations)


@query("agent_traces", bindings=["b_agent_steps"], oracle="""
WITH h AS (SELECT * FROM b_agent_steps WHERE step <= 15),
s AS (SELECT run_id, min(CASE WHEN NOT decision_ok OR instr(decision, 'DONE') > 0
                              OR instr(decision, 'COMPLETE') > 0 THEN step END) AS stop_step,
             max(step) AS last_step FROM h GROUP BY run_id),
e AS (SELECT h.* FROM h JOIN s ON h.run_id = s.run_id WHERE s.stop_step IS NULL OR h.step < s.stop_step),
t AS (SELECT run_id, CAST(count(*) AS INTEGER) AS steps,
             CAST(sum(CASE WHEN NOT success THEN 1 ELSE 0 END) AS INTEGER) AS failure_handoffs,
             string_agg('Step ' || CAST(step AS VARCHAR) || ': ' || trim(decision) || ' → '
                        || CASE WHEN success THEN 'OK' ELSE 'FAILED' END, chr(10) ORDER BY step) AS history
      FROM e GROUP BY run_id)
SELECT s.run_id, COALESCE(t.steps, 0) AS steps, COALESCE(t.failure_handoffs, 0) AS failure_handoffs,
       COALESCE(t.history, '') AS history,
       CASE WHEN s.stop_step IS NOT NULL THEN 'stopped' WHEN s.last_step >= 15 THEN 'max_steps'
            ELSE 'exhausted' END AS stop_reason,
       'Completed in ' || CAST(COALESCE(t.steps, 0) AS VARCHAR) || ' steps' AS summary
FROM s LEFT JOIN t ON s.run_id = t.run_id
""")
def _agent_traces(b):
    """Agent loop traces."""
    return W.agent_traces(b.b_agent_steps)


@query("rollback_targets", bindings=SM + ["b_snapshots"], oracle="""
SELECT f.run_id, f.seq, f.stage, f.ts AS failed_at, s.snapshot_id, s.ts AS snapshot_ts,
       (epoch_us(f.ts) - epoch_us(s.ts)) // 1000 AS work_lost_ms
FROM (SELECT * FROM b_stage_metrics WHERE NOT tests_pass) f
ASOF LEFT JOIN b_snapshots s ON f.run_id = s.run_id AND f.ts >= s.ts
""")
def _rollback_targets(b):
    """Backward as-of join of failures to snapshots, any stage."""
    return J.rollback_targets(b.b_stage_metrics, b.b_snapshots, critical_only=False)


# stage names that make critical and other stages fail
ROTATED = ("CASE event_id % 4 WHEN 0 THEN 'core-implementation' WHEN 1 THEN 'streaming' WHEN 2 THEN 'documentation' "
           "ELSE stage END")


@query("rollback_targets_critical", bindings=SM + ["b_snapshots"], oracle=f"""
SELECT f.run_id, f.seq, f.stage, f.ts AS failed_at, s.snapshot_id, s.ts AS snapshot_ts,
       (epoch_us(f.ts) - epoch_us(s.ts)) // 1000 AS work_lost_ms
FROM (SELECT run_id, seq, ts, {ROTATED} AS stage FROM b_stage_metrics WHERE NOT tests_pass) f
ASOF LEFT JOIN b_snapshots s ON f.run_id = s.run_id AND f.ts >= s.ts
WHERE f.stage IN (SELECT name FROM {S.templates_sql()} t WHERE critical_path AND workflow_type = 'llm-wrapper')
""")
def _rollback_targets_critical(b):
    """J2, default form: only failures of critical stages roll back."""
    m = b.b_stage_metrics.withColumn("stage", F.expr(ROTATED))
    return J.rollback_targets(m, b.b_snapshots)


@query("resolve_snapshots", bindings=["b_snapshots", "b_commits"], oracle=r"""
SELECT r.run_id, r.snapshot_id, c.commit_hash,
       CASE WHEN c.commit_hash IS NULL THEN 'Snapshot not found: ' || r.snapshot_id END AS error
FROM b_snapshots r
LEFT JOIN (SELECT run_id, sid, arg_max(hash, ts) AS commit_hash
           FROM (SELECT run_id, hash, ts, NULLIF(regexp_extract(message, 'Snapshot: (\S+)', 1), '') AS sid
                 FROM b_commits) x
           WHERE sid IS NOT NULL GROUP BY run_id, sid) c
  ON r.run_id = c.run_id AND r.snapshot_id = c.sid
""")
def _resolve_snapshots(b):
    """Snapshot id to newest matching commit."""
    return J.resolve_snapshots(b.b_snapshots, b.b_commits)


@query("reconcile_spend", bindings=SM, oracle="""
SELECT COALESCE(t.run_id, m.run_id) AS run_id, t.total_tokens, m.metric_tokens, t.total_cost, m.metric_cost,
       CAST(COALESCE(t.total_tokens, 0) - COALESCE(m.metric_tokens, 0) AS BIGINT) AS diff_tokens,
       CAST(COALESCE(t.total_cost, 0) - COALESCE(m.metric_cost, 0) AS DECIMAL(38,9)) AS diff_cost,
       CASE WHEN m.metric_tokens IS NULL THEN 'no_metrics' WHEN t.total_tokens IS NULL THEN 'no_totals'
            WHEN t.total_tokens = m.metric_tokens AND t.total_cost = m.metric_cost THEN 'match'
            ELSE 'mismatch' END AS status
FROM (SELECT run_id, CAST(sum(tokens_used) AS BIGINT) AS total_tokens, CAST(sum(cost) AS DECIMAL(38,9)) AS total_cost
      FROM b_stage_metrics GROUP BY run_id) t
FULL OUTER JOIN (SELECT run_id, CAST(sum(tokens_used) AS BIGINT) AS metric_tokens,
                        CAST(sum(cost) AS DECIMAL(38,9)) AS metric_cost
                 FROM b_stage_metrics WHERE error IS NULL GROUP BY run_id) m ON t.run_id = m.run_id
""")
def _reconcile_spend(b):
    """Run totals against metrics rows (full outer join)."""
    m = b.b_stage_metrics
    return J.reconcile_spend(m, m.filter(F.col("error").isNull()))
