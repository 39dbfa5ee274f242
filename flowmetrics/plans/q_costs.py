"""Registered queries: cost, estimates, settings, commands, features, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import aggregates as agg
from ..operators import cost as C
from ..operators import gates as G
from ..operators import joins as J
from .registry import query

EX = ["b_executions"]
CM = ["b_commands"]
COMPLEXITY_BY_SEQ = ("CASE seq % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' "
                     "ELSE 'extreme' END")
MODEL_BY_RUN = ("CASE run_id % 3 WHEN 0 THEN 'claude-sonnet-4-5' WHEN 1 THEN 'claude-opus-4' "
                "ELSE 'unlisted-model' END")
PREFIX_BY_RUN = ("CASE run_id % 4 WHEN 0 THEN 'llm-wrapper-dev' WHEN 1 THEN 'iterative-fix' "
                 "WHEN 2 THEN 'parallel-dev' ELSE 'nightly-batch' END")
CHANNEL_BY_EVENT = ("CASE event_id % 4 WHEN 0 THEN 'console' WHEN 1 THEN 'logging' "
                    "WHEN 2 THEN 'slack' ELSE 'webhook' END")


def _tok_sql(fn):
    return f"""
SELECT run_id, CAST(count(*) AS BIGINT) AS executions,
       CAST(sum(length(COALESCE(prompt, '') || COALESCE(output, ''))) AS BIGINT) AS chars,
       CAST(sum({fn}(length(COALESCE(prompt, '') || COALESCE(output, '')) / 4)) AS BIGINT) AS tokens
FROM b_executions GROUP BY run_id
"""


@query("token_accounting", bindings=EX, oracle=_tok_sql("floor"))
def _token_accounting(b):
    """B1: tokens per execution (floor), per-run totals."""
    return C.token_accounting(b.b_executions)


@query("token_accounting_ceil", bindings=EX, oracle=_tok_sql("ceil"))
def _token_accounting_ceil(b):
    """B1, example dialect (ceil)."""
    return C.token_accounting(b.b_executions, dialect="ceil")


@query("cost_accounting", bindings=["b_stage_metrics"], oracle=f"""
SELECT m.run_id, m.model, CAST(sum(m.tokens_used) AS BIGINT) AS tokens,
       CAST(sum(CAST(m.tokens_used * COALESCE(p.rate_per_token, CAST({S.default_rate()} AS DECIMAL(12,9)))
                AS DECIMAL(38,9))) AS DECIMAL(38,9)) AS cost,
       bool_or(p.rate_per_token IS NULL) AS default_price
FROM (SELECT run_id, tokens_used, {MODEL_BY_RUN} AS model FROM b_stage_metrics) m
LEFT JOIN {S.pricing_sql()} p ON m.model = p.model
GROUP BY m.run_id, m.model
""")
def _cost_accounting(b):
    """B2: per-model pricing with default fallback."""
    m = b.b_stage_metrics.select("run_id", "tokens_used", F.expr(MODEL_BY_RUN).alias("model"))
    return C.cost_accounting(m, S.pricing_df(b.spark))


def _plan(b):
    return b.b_executions.select("run_id", "seq", "prompt",
                                 F.expr(COMPLEXITY_BY_SEQ).alias("complexity"))


BUDGET_SQL = f"""
SELECT e.run_id, e.seq, e.complexity, length(e.prompt) // 4 AS prompt_tokens,
       CAST((length(e.prompt) // 4) * (1 + COALESCE(c.multiplier, 4)) AS BIGINT) AS tokens_estimate,
       CAST(CAST((length(e.prompt) // 4) * (1 + COALESCE(c.multiplier, 4)) AS BIGINT)
            * CAST({S.default_rate()} AS DECIMAL(12,9)) AS DECIMAL(38,9)) AS estimated_cost
FROM (SELECT run_id, seq, prompt, output, {COMPLEXITY_BY_SEQ} AS complexity FROM b_executions) e
LEFT JOIN {S.complexity_sql()} c ON e.complexity = c.name
"""


@query("budget_estimate", bindings=EX, oracle=BUDGET_SQL)
def _budget_estimate(b):
    """Stage budget estimate."""
    return C.budget_estimate(_plan(b), S.complexity_df(b.spark))


VARIANCE_SQL = f"""
WITH est AS ({BUDGET_SQL}),
act AS (SELECT run_id, seq, CAST(length(COALESCE(prompt, '') || COALESCE(output, '')) // 4 AS BIGINT) AS actual_tokens
        FROM b_executions)
SELECT est.run_id, est.seq, complexity, tokens_estimate, estimated_cost, actual_tokens,
       CAST(actual_tokens * CAST({S.default_rate()} AS DECIMAL(12,9)) AS DECIMAL(38,9)) AS actual_cost,
       CAST(CAST(actual_tokens * CAST({S.default_rate()} AS DECIMAL(12,9)) AS DECIMAL(38,9)) - estimated_cost
            AS DECIMAL(38,9)) AS variance,
       CASE WHEN CAST(estimated_cost AS DOUBLE) = 0 THEN NULL
            ELSE CAST(CAST(actual_tokens * CAST({S.default_rate()} AS DECIMAL(12,9)) AS DECIMAL(38,9)) AS DOUBLE)
                 / CAST(estimated_cost AS DOUBLE) END AS actual_to_estimate,
       CAST(actual_tokens * CAST({S.default_rate()} AS DECIMAL(12,9)) AS DECIMAL(38,9)) > estimated_cost AS over_budget
FROM est JOIN act ON est.run_id = act.run_id AND est.seq = act.seq
"""


@query("estimate_variance", bindings=EX, oracle=VARIANCE_SQL)
def _estimate_variance(b):
    """Estimate against actual cost."""
    est = C.budget_estimate(_plan(b), S.complexity_df(b.spark))
    return J.estimate_variance(b.b_executions, est)


@query("estimate_summary", bindings=EX, oracle=f"""
SELECT complexity, CAST(count(*) AS BIGINT) AS executions,
       CAST(sum(CASE WHEN over_budget THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share_over_budget,
       CAST(sum(estimated_cost) AS DECIMAL(38,9)) AS estimated_cost,
       CAST(sum(actual_cost) AS DECIMAL(38,9)) AS actual_cost
FROM ({VARIANCE_SQL}) v GROUP BY complexity
""")
def _estimate_summary(b):
    """J5 roll-up: share over budget per complexity."""
    est = C.budget_estimate(_plan(b), S.complexity_df(b.spark))
    return J.estimate_summary(J.estimate_variance(b.b_executions, est))


def _int_sql(c):
    return (f"regexp_replace(regexp_replace({c}, '([0-9])_([0-9])', '\\1\\2', 'g'), "
            f"'([0-9])_([0-9])', '\\1\\2', 'g')")


@query("effective_settings", bindings=["b_run_overrides"], oracle=f"""
SELECT o.run_id, o.environment, o.preset,
       COALESCE(TRY_CAST({_int_sql('o.max_tokens')} AS BIGINT), p.preset_max_tokens) AS max_tokens,
       COALESCE(TRY_CAST(o.temperature AS DOUBLE), p.preset_temperature) AS temperature,
       COALESCE(TRY_CAST({_int_sql('o.timeout')} AS INTEGER), p.preset_timeout_s) AS timeout_s,
       (TRY_CAST({_int_sql('o.max_tokens')} AS BIGINT) IS NOT NULL OR TRY_CAST(o.temperature AS DOUBLE) IS NOT NULL
        OR TRY_CAST({_int_sql('o.timeout')} AS INTEGER) IS NOT NULL) AS overridden
FROM (SELECT *, CASE WHEN environment IN ('production', 'staging', 'development') THEN environment
                     ELSE 'development' END AS preset FROM b_run_overrides) o
LEFT JOIN {S.env_presets_sql()} p ON o.preset = p.preset
""")
def _effective_settings(b):
    """Effective run settings."""
    return C.effective_settings(b.b_run_overrides, S.env_presets_df(b.spark))


@query("run_id_decode", bindings=["b_run_overrides"], oracle=f"""
SELECT p.workflow_type, d.prefix, DATE '1970-01-01' + CAST(d.started_ms // 86400000 AS INTEGER) AS start_day,
       CAST(count(*) AS BIGINT) AS runs
FROM (SELECT regexp_extract(workflow_id, '^(.+)-([0-9]+)$', 1) AS prefix,
             CAST(regexp_extract(workflow_id, '^(.+)-([0-9]+)$', 2) AS BIGINT) AS started_ms
      FROM (SELECT {PREFIX_BY_RUN} || '-' || CAST(1700000000000 + run_id AS VARCHAR) AS workflow_id
            FROM b_run_overrides) i) d
LEFT JOIN {S.run_id_prefixes_sql()} p ON d.prefix = p.prefix
GROUP BY 1, 2, 3
""")
def _run_id_decode(b):
    """Decode workflow ids; runs per type and day."""
    ids = b.b_run_overrides.select(
        F.concat(F.expr(PREFIX_BY_RUN), F.lit("-"),
                 (F.lit(1700000000000) + F.col("run_id")).cast("string")).alias("workflow_id"))
    return C.decode_run_ids(ids, S.run_id_prefixes_df(b.spark))


@query("search_invocations", bindings=CM, oracle="""
SELECT * FROM b_commands
WHERE starts_with(command, '/development:') AND duration_ms >= 1000 AND duration_ms <= 400000
  AND contains(output, 'ERROR')
""")
def _search(b):
    """Run search by prefix, duration and failure text."""
    return C.search_invocations(b.b_commands, "/development:", 1000, 400000, "ERROR")


@query("command_outcomes", bindings=CM, oracle="""
SELECT command, CAST(count(*) AS BIGINT) AS invocations,
       CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS BIGINT) AS strict_ok,
       CAST(sum(CASE WHEN l THEN 1 ELSE 0 END) AS BIGINT) AS loose_ok,
       CAST(sum(CASE WHEN s <> l THEN 1 ELSE 0 END) AS BIGINT) AS disagree
FROM (SELECT command, exit_code = 0 AND NOT contains(output, 'ERROR') AS s,
             exit_code = 0 AND NOT contains(lower(output), 'error') AS l FROM b_commands) t
GROUP BY command
""")
def _command_outcomes(b):
    """Strict against loose success rules."""
    return C.command_outcomes(b.b_commands)


@query("rule_disagreements", bindings=CM, oracle="""
SELECT event_id, session_id, command, exit_code, output,
       exit_code = 0 AND NOT contains(output, 'ERROR') AS strict_ok,
       exit_code = 0 AND NOT contains(lower(output), 'error') AS loose_ok
FROM b_commands
WHERE (exit_code = 0 AND NOT contains(output, 'ERROR')) <> (exit_code = 0 AND NOT contains(lower(output), 'error'))
""")
def _rule_disagreements(b):
    """Invocations where the strict and loose rules disagree."""
    return C.rule_disagreements(b.b_commands)


@query("pr_links", bindings=CM, oracle=r"""
SELECT session_id, pr_link, CAST(count(*) AS BIGINT) AS mentions
FROM (SELECT session_id, NULLIF(regexp_extract(output, 'https://github\.com/.*/pull/\d+', 0), '') AS pr_link
      FROM b_commands) t
WHERE pr_link IS NOT NULL GROUP BY session_id, pr_link
""")
def _pr_links(b):
    """Pull-request links per session."""
    return C.extract_pr_links(b.b_commands)


@query("command_metrics", bindings=CM, oracle="""
SELECT regexp_extract(command, '^/([^:]+):', 1) AS category, CAST(count(*) AS BIGINT) AS invocations,
       CAST(sum(CASE WHEN exit_code = 0 AND NOT contains(output, 'ERROR') THEN 1 ELSE 0 END) AS DOUBLE)
         / CAST(count(*) AS DOUBLE) AS success_rate,
       CAST(sum(tokens_used) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_tokens
FROM b_commands GROUP BY 1
""")
def _command_metrics(b):
    """Per-category success rate and tokens."""
    return agg.command_metrics(b.b_commands)


@query("command_catalogue", bindings=CM, oracle=f"""
SELECT g.command, g.category, g.name, g.uses, c.name IS NOT NULL AS known
FROM (SELECT command, NULLIF(regexp_extract(command, '^/([^:]+):', 1), '') AS category,
             NULLIF(regexp_extract(command, '^/[^:]+:(\\S+)', 1), '') AS name, CAST(count(*) AS BIGINT) AS uses
      FROM b_commands GROUP BY 1, 2, 3) g
LEFT JOIN {S.command_catalog_sql()} c ON g.category = c.category AND g.name = c.name
""")
def _command_catalogue(b):
    """Commands against the catalogue."""
    return J.command_catalogue(b.b_commands, S.command_catalog_df(b.spark))


@query("delivery_results", bindings=CM, oracle=f"""
SELECT request_id, bool_or(ok) AS delivered, CAST(count(DISTINCT channel) AS BIGINT) AS channels_tried,
       COALESCE(list_sort(list(DISTINCT channel) FILTER (WHERE NOT ok)), []) AS failed_channels,
       CAST(count(*) AS BIGINT) AS attempts
FROM (SELECT session_id AS request_id, {CHANNEL_BY_EVENT} AS channel, exit_code = 0 AS ok FROM b_commands) a
GROUP BY request_id
""")
def _delivery_results(b):
    """Composite delivery outcome per request."""
    a = b.b_commands.select(F.col("session_id").alias("request_id"),
                            F.expr(CHANNEL_BY_EVENT).alias("channel"),
                            (F.col("exit_code") == 0).alias("ok"))
    return agg.delivery_results(a)


FR = ["b_feature_runs"]


@query("feature_results", bindings=FR, oracle="""
SELECT run_id, idx, feature, 'feature-' || CAST(idx AS VARCHAR) || '-' || lower(replace(feature, ' ', '-')) AS branch,
       success, CASE WHEN success THEN 'OK' ELSE 'FAILED' END AS status, tokens_used
FROM b_feature_runs WHERE NOT raised
""")
def _feature_results(b):
    """Feature results with branch names."""
    return agg.feature_results(b.b_feature_runs)


@query("feature_results_collapse", bindings=FR, oracle=r"""
SELECT run_id, idx, feature, 'feature-' || CAST(idx AS VARCHAR) || '-' || regexp_replace(feature, '\s+', '-', 'g') AS branch,
       success, CASE WHEN success THEN 'OK' ELSE 'FAILED' END AS status, tokens_used
FROM b_feature_runs WHERE NOT raised
""")
def _feature_results_collapse(b):
    """G7, example dialect (collapse whitespace, keep case)."""
    return agg.feature_results(b.b_feature_runs, dialect="collapse")


@query("feature_summary", bindings=FR, oracle="""
SELECT run_id, CAST(sum(CASE WHEN NOT raised THEN 1 ELSE 0 END) AS BIGINT) AS returned,
       CAST(sum(CASE WHEN NOT raised AND success THEN 1 ELSE 0 END) AS BIGINT) AS ok,
       CAST(sum(CASE WHEN NOT raised AND NOT success THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CAST(sum(CASE WHEN raised THEN 1 ELSE 0 END) AS BIGINT) AS raised,
       CAST(sum(CASE WHEN NOT raised THEN tokens_used END) AS BIGINT) AS tokens_used
FROM b_feature_runs GROUP BY run_id
""")
def _feature_summary(b):
    """G7 roll-up per run."""
    return agg.feature_summary(b.b_feature_runs)


@query("parallel_speedup", bindings=FR, oracle="""
SELECT run_id, CAST(count(*) AS BIGINT) AS features, CAST(sum(duration_ms) AS BIGINT) AS serial_ms,
       CAST(max(duration_ms) AS BIGINT) AS elapsed_ms,
       CASE WHEN max(duration_ms) = 0 THEN NULL
            ELSE CAST(sum(duration_ms) AS DOUBLE) / CAST(max(duration_ms) AS DOUBLE) END AS speedup
FROM b_feature_runs GROUP BY run_id
""")
def _parallel_speedup(b):
    """Parallel speed-up per run."""
    return agg.parallel_speedup(b.b_feature_runs)


@query("snapshot_history", bindings=["b_snapshots"], oracle="""
SELECT run_id, CAST(count(*) AS BIGINT) AS snapshots, arg_min(snapshot_id, ts) AS first_snapshot,
       arg_max(snapshot_id, ts) AS last_snapshot, max(ts) AS last_snapshot_ts
FROM b_snapshots GROUP BY run_id
""")
def _snapshot_history(b):
    """Snapshot list summary per run."""
    return agg.snapshot_history(b.b_snapshots)


@query("snapshot_list", bindings=["b_snapshots"], oracle="""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS ordinal, snapshot_id, ts,
       row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) = count(*) OVER (PARTITION BY run_id) AS is_last
FROM b_snapshots
""")
def _snapshot_list(b):
    """Snapshots of each run in creation order, last one flagged."""
    return agg.snapshot_list(b.b_snapshots)


@query("activity_timeouts", bindings=["b_activity_events"], oracle=f"""
SELECT activity_id, run_id, activity, scheduled_at, limit_s, completed_after_s, status,
       scheduled_at + to_seconds(CAST(limit_s AS BIGINT)) AS deadline
FROM (SELECT e.*, CAST(CASE WHEN e.activity = 'execute' THEN least(l.limit_s, 1800) ELSE l.limit_s END AS INTEGER) AS limit_s2
      FROM b_activity_events e LEFT JOIN {S.activity_timeouts_sql()} l ON e.activity = l.activity) x
CROSS JOIN LATERAL (SELECT limit_s2 AS limit_s,
       CASE WHEN completed_after_s IS NULL THEN 'never_completed'
            WHEN completed_after_s > limit_s2 THEN 'timed_out' ELSE 'ok' END AS status) y
WHERE status <> 'ok'
""")
def _activity_timeouts(b):
    """Activities past their limit."""
    return J.activity_timeouts(b.b_activity_events, S.activity_timeouts_df(b.spark))


@query("activity_durations_unnamed", bindings=["b_activity_events"], oracle="""
WITH e AS (SELECT activity_id AS id, run_id, activity, 1 AS k, scheduled_at AS moment FROM b_activity_events
           UNION ALL SELECT activity_id, run_id, activity, 0, scheduled_at + to_seconds(completed_after_s)
           FROM b_activity_events WHERE completed_after_s IS NOT NULL),
n AS (SELECT *, first_value(CASE WHEN k = 0 THEN moment END IGNORE NULLS) OVER (
        PARTITION BY run_id ORDER BY moment, k, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS done FROM e)
SELECT CAST(NULL AS BIGINT) AS activity_id, run_id, activity, moment AS scheduled_at, done AS completed_at,
       (epoch_us(done) - epoch_us(moment)) // 1000 AS duration_ms
FROM n WHERE k = 1
""")
def _activity_durations_unnamed(b):
    """J8 for a history without activity ids: the next completion of the run."""
    rows = J.activity_event_rows(b.b_activity_events)
    return J.activity_durations(rows.withColumn("tie", F.col("activity_id"))
                                .withColumn("activity_id", F.lit(None).cast("bigint")), "tie")


@query("activity_durations", bindings=["b_activity_events"], oracle="""
SELECT activity_id, run_id, activity, scheduled_at, completed_at,
       (epoch_us(completed_at) - epoch_us(scheduled_at)) // 1000 AS duration_ms
FROM (SELECT activity_id, run_id, activity, scheduled_at,
             scheduled_at + to_seconds(completed_after_s) AS completed_at FROM b_activity_events) t
""")
def _activity_durations(b):
    """scheduled/completed pairs and durations."""
    return J.activity_durations(J.activity_event_rows(b.b_activity_events))


@query("new_files", bindings=["b_file_status"], oracle="""
SELECT a.run_id, a.name AS path, CAST(count(*) AS BIGINT) AS occurrences
FROM (SELECT run_id, string_split(path, ' ')[-1] AS name FROM b_file_status WHERE phase = 'after') a
WHERE a.name <> '' AND NOT EXISTS (
  SELECT 1 FROM b_file_status bf WHERE bf.phase = 'before' AND bf.run_id = a.run_id
    AND string_split(bf.path, ' ')[-1] = a.name)
GROUP BY a.run_id, a.name
""")
def _new_files(b):
    """New files between two listings."""
    return J.new_files(b.b_file_status)


GS = ["b_gates", "b_signals"]


@query("approval_gates_independent", bindings=GS, oracle="""
SELECT gate_id, run_id, stage, opened_at,
       CASE WHEN d_sig IS NULL THEN 'timeout' WHEN d_sig = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome,
       COALESCE(d_ts, opened_at + INTERVAL 3600 SECOND) AS decided_at,
       (epoch_us(COALESCE(d_ts, opened_at + INTERVAL 3600 SECOND)) - epoch_us(opened_at)) // 1000 AS wait_ms
FROM (SELECT g.gate_id, g.run_id, g.stage, g.opened_at,
             arg_min(s.signal, (s.ts, s.signal_id)) AS d_sig, min(s.ts) AS d_ts
      FROM b_gates g LEFT JOIN b_signals s
        ON g.run_id = s.run_id AND s.ts >= g.opened_at AND s.ts <= g.opened_at + INTERVAL 3600 SECOND
      GROUP BY 1, 2, 3, 4) t
""")
def _gates_independent(b):
    """J4 independent: interval join, first signal within the limit."""
    return G.approval_gates(b.b_gates, b.b_signals, mode="independent")


STICKY_SQL = """
WITH u AS (
  SELECT run_id, opened_at AS t, 1 AS kind, gate_id AS id, stage, NULL AS signal FROM b_gates
  UNION ALL
  SELECT run_id, ts AS t, 0 AS kind, signal_id AS id, NULL AS stage, signal FROM b_signals),
n AS (SELECT *, sum(kind) OVER (PARTITION BY run_id ORDER BY t, kind, id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gate_no FROM u),
seg AS (SELECT run_id, gate_no, count(*) AS cnt, arg_max(signal, (t, id)) AS last_signal,
               min(t) AS first_t, arg_min(signal, (t, id)) AS first_signal
        FROM n WHERE kind = 0 GROUP BY run_id, gate_no),
g AS (SELECT n.run_id, n.id AS gate_id, n.stage, n.t AS opened_at, n.gate_no,
             COALESCE(p.cnt, 0) AS cnt, p.last_signal, q.first_t, q.first_signal
      FROM n LEFT JOIN seg p ON p.run_id = n.run_id AND p.gate_no = n.gate_no - 1
             LEFT JOIN seg q ON q.run_id = n.run_id AND q.gate_no = n.gate_no
      WHERE n.kind = 1),
m AS (SELECT *,
        COALESCE(last_value(CASE WHEN cnt >= 2 THEN TRUE WHEN cnt = 0 THEN FALSE END IGNORE NULLS)
                 OVER (PARTITION BY run_id ORDER BY gate_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 TRUE) AS flag_set,
        first_value(first_t IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY gate_no
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_t,
        first_value(CASE WHEN first_t IS NOT NULL THEN first_signal END IGNORE NULLS) OVER (
                 PARTITION BY run_id ORDER BY gate_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_signal
      FROM g),
d AS (SELECT *,
        CASE WHEN flag_set THEN last_signal
             WHEN next_t IS NOT NULL AND next_t <= opened_at + INTERVAL 3600 SECOND THEN next_signal END AS dsig,
        CASE WHEN flag_set THEN opened_at
             WHEN next_t IS NOT NULL AND next_t <= opened_at + INTERVAL 3600 SECOND THEN next_t
             ELSE opened_at + INTERVAL 3600 SECOND END AS dts
      FROM m),
o AS (SELECT *, CASE WHEN dsig IS NULL THEN 'timeout' WHEN dsig = 'approve' THEN 'approved'
                     ELSE 'rejected' END AS outcome0 FROM d),
c AS (SELECT *, max(CASE WHEN outcome0 <> 'approved' THEN 1 END) OVER (
               PARTITION BY run_id ORDER BY gate_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed_before
      FROM o)
SELECT gate_id, run_id, stage, opened_at,
       CASE WHEN failed_before IS NOT NULL THEN 'not_reached' ELSE outcome0 END AS outcome,
       CASE WHEN failed_before IS NULL THEN dts END AS decided_at,
       CASE WHEN failed_before IS NULL THEN (epoch_us(dts) - epoch_us(opened_at)) // 1000 END AS wait_ms
FROM c
"""


@query("approval_gates_sticky", bindings=GS, oracle=STICKY_SQL)
def _gates_sticky(b):
    """J4 sticky: the run's flag semantics, by carried scans."""
    return G.approval_gates(b.b_gates, b.b_signals, mode="sticky")
