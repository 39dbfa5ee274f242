"""Registered queries: test logs, git text, notifications, stage plans."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import aggregates as agg
from ..operators import logs as L
from ..operators import notify as N
from ..operators import stages as ST
from .registry import query

TL = ["b_test_logs"]

_EMPTY = "CAST([] AS VARCHAR[])"
PARSE_SQL = f"""
SELECT run_id, duration_ms, ts, framework,
  CASE
    WHEN framework = 'npm' AND json_valid(output) THEN COALESCE(CAST(json_extract(output, '$.success') AS BOOLEAN), return_code = 0)
    WHEN framework IN ('npm', 'pytest', 'cargo', 'go') THEN return_code = 0
    ELSE FALSE END AS success,
  CAST(CASE
    WHEN framework = 'npm' AND json_valid(output) THEN COALESCE(CAST(json_extract(output, '$.numTotalTests') AS INTEGER), 0)
    WHEN framework = 'npm' THEN 0
    WHEN framework = 'pytest' THEN p + f + e
    WHEN framework IN ('cargo', 'go') THEN cp + cf
    ELSE 0 END AS INTEGER) AS total_tests,
  CAST(CASE
    WHEN framework = 'npm' AND json_valid(output) THEN COALESCE(CAST(json_extract(output, '$.numPassedTests') AS INTEGER), 0)
    WHEN framework = 'npm' THEN CASE WHEN return_code = 0 THEN 1 ELSE 0 END
    WHEN framework = 'pytest' THEN p
    WHEN framework IN ('cargo', 'go') THEN cp
    ELSE 0 END AS INTEGER) AS passed,
  CAST(CASE
    WHEN framework = 'npm' AND json_valid(output) THEN COALESCE(CAST(json_extract(output, '$.numFailedTests') AS INTEGER), 0)
    WHEN framework = 'npm' THEN CASE WHEN return_code = 0 THEN 0 ELSE 1 END
    WHEN framework = 'pytest' THEN f + e
    WHEN framework IN ('cargo', 'go') THEN cf
    ELSE 1 END AS INTEGER) AS failed,
  CASE
    WHEN framework = 'npm' AND json_valid(output) THEN {_EMPTY}
    WHEN framework IN ('npm', 'pytest', 'cargo', 'go') THEN CASE WHEN return_code = 0 THEN {_EMPTY} ELSE [output] END
    ELSE ['{L.NO_FRAMEWORK}'] END AS errors,
  CASE WHEN framework = 'npm' AND json_valid(output)
       THEN CAST(json_extract(output, '$.coverageMap.total.lines.pct') AS DOUBLE) END AS coverage
FROM (SELECT run_id, duration_ms, ts, lower(framework) AS framework, output, return_code,
        COALESCE(CAST(NULLIF(regexp_extract(output, '(\\d+) passed', 1), '') AS INTEGER), 0) AS p,
        COALESCE(CAST(NULLIF(regexp_extract(output, '(\\d+) failed', 1), '') AS INTEGER), 0) AS f,
        COALESCE(CAST(NULLIF(regexp_extract(output, '(\\d+) error', 1), '') AS INTEGER), 0) AS e,
        CASE lower(framework)
          WHEN 'cargo' THEN len(regexp_extract_all(output, 'test .+ \\.\\.\\. ok'))
          ELSE len(regexp_extract_all(output, '--- PASS:')) END AS cp,
        CASE lower(framework)
          WHEN 'cargo' THEN len(regexp_extract_all(output, 'test .+ \\.\\.\\. FAILED'))
          ELSE len(regexp_extract_all(output, '--- FAIL:')) END AS cf
      FROM b_test_logs) t
"""


@query("test_results", bindings=TL, oracle=PARSE_SQL)
def _test_results(b):
    """Parse npm / pytest / cargo / go logs to test results."""
    return L.parse_test_logs(b.b_test_logs)


@query("test_rollup", bindings=TL, oracle=f"""
WITH r AS ({PARSE_SQL})
SELECT framework, CAST(count(*) AS BIGINT) AS runs,
       CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successes,
       CAST(sum(total_tests) AS BIGINT) AS total_tests, CAST(sum(passed) AS BIGINT) AS passed,
       CAST(sum(failed) AS BIGINT) AS failed,
       CASE WHEN sum(total_tests) = 0 THEN NULL
            ELSE CAST(sum(passed) AS DOUBLE) / CAST(sum(total_tests) AS DOUBLE) END AS pass_rate
FROM r GROUP BY framework
""")
def _test_rollup(b):
    """C5 roll-up per framework."""
    return L.test_rollup(L.parse_test_logs(b.b_test_logs))


@query("coverage_trend", bindings=TL, oracle=f"""
WITH r AS ({PARSE_SQL})
SELECT CAST(date_trunc('month', ts) AS DATE) AS period, framework, CAST(count(*) AS BIGINT) AS test_runs,
       CAST(count(coverage) AS BIGINT) AS with_coverage,
       CASE WHEN count(coverage) = 0 THEN NULL
            ELSE sum(coverage) / CAST(count(coverage) AS DOUBLE) END AS avg_coverage
FROM r GROUP BY 1, 2
""")
def _coverage_trend(b):
    """Mean coverage per month and framework."""
    return agg.coverage_trend(L.test_coverage(b.b_test_logs))


def _parse_go_batch(output, rc):
    """C4 over whole batches of logs."""
    ok = pc.equal(rc, 0)
    passed, failed = (pc.fill_null(pc.count_substring(output, x), 0) for x in ("--- PASS:", "--- FAIL:"))
    outputs = pa.ListArray.from_arrays(pa.array(range(len(output) + 1), pa.int32()), output)
    return {"success": ok, "total_tests": pc.add(passed, failed), "passed": passed, "failed": failed,
            "errors": pc.if_else(ok, pa.scalar([], pa.list_(pa.string())), outputs)}


@query("vectorised_dialect", bindings=TL, oracle=PARSE_SQL)
def _vectorised_dialect(b):
    """One dialect as a function over Arrow batches, beside the column
    parsers of the others in one dispatch; equal to the column form of it."""
    return L.parse_test_logs(b.b_test_logs, {**L.DIALECTS, "go": L.vectorised(_parse_go_batch)})


@query("test_results_detected", bindings=["b_test_logs", "b_project_files"], oracle=f"""
WITH d AS (SELECT f.project_id, arg_min(m.framework, m.priority) AS found
           FROM b_project_files f
           LEFT JOIN {S.framework_markers_sql()} m
             ON f.path = m.marker OR (suffix(m.marker, '/') AND starts_with(f.path, m.marker) AND f.path <> m.marker)
           GROUP BY f.project_id),
x AS (SELECT l.run_id, l.duration_ms, l.ts, l.return_code, l.output, l.run_id % 7 = 3 AS missing,
             CASE l.run_id % 3 WHEN 0 THEN d.found WHEN 1 THEN COALESCE(d.found, 'tap') ELSE l.framework END AS framework
      FROM b_test_logs l LEFT JOIN d ON d.project_id = l.run_id),
r AS ({PARSE_SQL.replace("SELECT run_id, duration_ms, ts, framework,", "SELECT missing, run_id, duration_ms, ts, framework,", 1)
       .replace("SELECT run_id, duration_ms, ts, lower(framework)", "SELECT missing, run_id, duration_ms, ts, lower(framework)")
       .replace("FROM b_test_logs", "FROM x")})
SELECT run_id, duration_ms, ts, framework,
       CASE WHEN m THEN FALSE ELSE success END AS success, CASE WHEN m THEN 0 ELSE total_tests END AS total_tests,
       CASE WHEN m THEN 0 ELSE passed END AS passed, CASE WHEN m THEN 1 ELSE failed END AS failed,
       CASE WHEN m THEN [framework || ' not found'] ELSE errors END AS errors, CASE WHEN NOT m THEN coverage END AS coverage
FROM (SELECT *, COALESCE(missing AND framework IN ('npm', 'pytest', 'cargo', 'go'), FALSE) AS m FROM r) y
""")
def _test_results_detected(b):
    """C5 with fall-back: logs of no or an unknown framework take the one
    detected for their project (C6); some tools are missing."""
    logs = b.b_test_logs.withColumn("project_id", F.col("run_id")).withColumn(
        "framework", F.when(F.col("run_id") % 3 == 0, None).when(F.col("run_id") % 3 == 1, F.lit("tap"))
        .otherwise(F.col("framework"))).withColumn("tool_missing", F.col("run_id") % 7 == 3)
    detected = L.detect_framework(b.b_project_files, S.framework_markers_df(b.spark))
    return L.parse_test_logs(L.with_detected(logs, detected))


@query("framework_detection", bindings=["b_project_files"], oracle=f"""
SELECT f.project_id, arg_min(m.framework, m.priority) AS framework
FROM b_project_files f
LEFT JOIN {S.framework_markers_sql()} m
  ON f.path = m.marker OR (suffix(m.marker, '/') AND starts_with(f.path, m.marker) AND f.path <> m.marker)
GROUP BY f.project_id
""")
def _framework_detection(b):
    """Framework per project from its files."""
    return L.detect_framework(b.b_project_files, S.framework_markers_df(b.spark))


@query("changed_files", bindings=["b_file_status"], oracle=r"""
SELECT run_id, CAST(count(*) AS BIGINT) AS files_changed, CAST(count(DISTINCT file) AS BIGINT) AS distinct_files
FROM (SELECT run_id, regexp_extract(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\S+\s+(.*)$', 1) AS file
      FROM (SELECT run_id, unnest(string_split(' M ' || path, chr(10))) AS line FROM b_file_status) a) b
WHERE file <> '' GROUP BY run_id
""")
def _changed_files(b):
    """Porcelain status lines to changed files per run."""
    fs = b.b_file_status.select("run_id", F.concat(F.lit(" M "), F.col("path")).alias("raw"))
    return L.changed_file_counts(fs)


@query("changed_file_rows", bindings=["b_file_status"], oracle=r"""
SELECT run_id, file
FROM (SELECT run_id, regexp_extract(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\S+\s+(.*)$', 1) AS file
      FROM (SELECT run_id, unnest(string_split(' M ' || path, chr(10))) AS line FROM b_file_status) a) b
WHERE file <> ''
""")
def _changed_file_rows(b):
    """One row per changed file parsed from porcelain status lines."""
    fs = b.b_file_status.select("run_id", F.concat(F.lit(" M "), F.col("path")).alias("raw"))
    return L.changed_files(fs)


@query("diff_totals", bindings=["b_diff_stats"], oracle=r"""
SELECT run_id,
       CAST(sum(COALESCE(CAST(NULLIF(regexp_extract(diff_output, '(\d+) insertions?.*?(\d+) deletions?', 1), '') AS BIGINT), 0)) AS BIGINT) AS lines_added,
       CAST(sum(COALESCE(CAST(NULLIF(regexp_extract(diff_output, '(\d+) insertions?.*?(\d+) deletions?', 2), '') AS BIGINT), 0)) AS BIGINT) AS lines_removed,
       CAST(count(*) AS BIGINT) AS diffs
FROM b_diff_stats GROUP BY run_id
""")
def _diff_totals(b):
    """Diff --stat totals per run."""
    return L.diff_totals(b.b_diff_stats)


PREVIEW_SQL = """
SELECT run_id, CAST(count(*) AS BIGINT) AS files_count,
       list(path ORDER BY path) FILTER (WHERE rn <= 10) AS files_preview
FROM (SELECT run_id, path, row_number() OVER (PARTITION BY run_id ORDER BY path) AS rn
      FROM (SELECT DISTINCT run_id, path FROM b_file_status) d) t
GROUP BY run_id
"""


@query("file_previews", bindings=["b_file_status"], oracle=f"""
SELECT run_id, files_count,
       array_to_string(list_transform(files_preview, lambda x: '- ' || x), chr(10))
       || CASE WHEN files_count > 10 THEN chr(10) || '... and ' || CAST(files_count - 10 AS VARCHAR) || ' more'
               ELSE '' END AS preview
FROM ({PREVIEW_SQL}) p
""")
def _file_previews(b):
    """First 10 files and "... and N more" per run."""
    p = N.file_previews(b.b_file_status)
    return p.select("run_id", "files_count",
                    N.preview_text(F.col("files_preview"), F.col("files_count")).alias("preview"))


def _requests(b, previews=None):
    p = N.file_previews(b.b_file_status) if previews is None else previews
    g = b.b_gates.select(F.col("gate_id").alias("request_id"), "run_id", "stage")
    return g.join(p, "run_id", "left").select(
        "request_id", "run_id", "stage", N.approval_message(F.col("stage")).alias("message"),
        "files_preview", "files_count", F.lit(None).cast("string").alias("diff_url"))


@query("render_notifications", bindings=["b_gates", "b_file_status"], oracle=f"""
WITH p AS ({PREVIEW_SQL}),
r AS (SELECT g.gate_id AS request_id, g.stage, 'Stage ''' || g.stage || ''' complete. Review required.' AS message,
             COALESCE(p.files_preview, CAST([] AS VARCHAR[])) AS fp, COALESCE(p.files_count, 0) AS fc,
             COALESCE(w.names, CAST([] AS VARCHAR[])) AS names
      FROM b_gates g LEFT JOIN p ON g.run_id = p.run_id
      LEFT JOIN (SELECT run_id, list(DISTINCT path ORDER BY path) AS names FROM b_file_status GROUP BY run_id) w
        ON g.run_id = w.run_id),
t AS (SELECT *, array_to_string(list_transform(fp, lambda x: '- ' || x), chr(10))
                || CASE WHEN fc > 10 THEN chr(10) || '... and ' || CAST(fc - 10 AS VARCHAR) || ' more' ELSE '' END AS plain,
                array_to_string(list_transform(fp, lambda x: '  - ' || x), chr(10))
                || CASE WHEN fc > 10 THEN chr(10) || '  ... and ' || CAST(fc - 10 AS VARCHAR) || ' more' ELSE '' END AS indented
      FROM r)
SELECT request_id, 'console' AS channel, CAST(0 AS INTEGER) AS part,
       '{N.SEPARATOR}' || chr(10) || 'NOTIFICATION: Stage ''' || stage || ''' requires attention' || chr(10)
       || 'Message: ' || message || chr(10) || 'Files changed: ' || CAST(fc AS VARCHAR)
       || CASE WHEN fc > 0 THEN chr(10) || indented ELSE '' END || chr(10) || '{N.SEPARATOR}' AS payload FROM t
UNION ALL
SELECT request_id, 'logging', 0, 'Notification: stage=' || stage || ', message=' || message
       || ', files_changed=' || CAST(fc AS VARCHAR) FROM t
UNION ALL
SELECT request_id, 'webhook', 0, CAST(json_object('stage', stage, 'message', message, 'files_changed', names,
       'diff_url', NULL) AS VARCHAR) FROM t
UNION ALL
SELECT request_id, 'slack', 0, CAST(json_object('username', 'flowmetrics', 'blocks',
       list_filter([json_object('type', 'header', 'text', json_object('type', 'plain_text',
                        'text', 'Stage ''' || stage || ''' requires attention')),
                    json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', message)),
                    CASE WHEN fc > 0 THEN json_object('type', 'section', 'text', json_object('type', 'mrkdwn',
                        'text', '*Files changed:*' || chr(10) || '```' || plain || '```')) END], lambda x: x IS NOT NULL))
       AS VARCHAR) FROM t
""")
def _render_notifications(b):
    """Approval notifications per gate rendered for four channels."""
    previews, parts = N.file_lists(b.b_file_status)
    return N.render_notifications(_requests(b, previews), files=parts)


def _render_pager(stage, message, preview, count, diff_url):
    """One line for a pager: the stage, the number of files and the first of them."""
    return F.concat(F.lit("["), F.upper(stage), F.lit("] "), count.cast("string"), F.lit(" files"),
                    F.when(count > 0, F.concat(F.lit(", first "), F.get(preview, F.lit(0)))).otherwise(F.lit("")))


@query("custom_channel", bindings=["b_gates", "b_file_status"], oracle=f"""
WITH p AS ({PREVIEW_SQL}),
r AS (SELECT g.gate_id AS request_id, g.stage, COALESCE(p.files_count, 0) AS fc, p.files_preview AS fp
      FROM b_gates g LEFT JOIN p ON g.run_id = p.run_id)
SELECT request_id, 'pager' AS channel, CAST(0 AS INTEGER) AS part,
       '[' || upper(stage) || '] ' || CAST(fc AS VARCHAR) || ' files' || CASE WHEN fc > 0 THEN ', first ' || fp[1] ELSE '' END AS payload
FROM r
UNION ALL
SELECT request_id, 'logging', 0, 'Notification: stage=' || stage || ', message=Stage ''' || stage
       || ''' complete. Review required., files_changed=' || CAST(fc AS VARCHAR) FROM r
""")
def _custom_channel(b):
    """A registered channel, routed to and rendered beside a built-in one."""
    with N.renderer("pager", _render_pager):
        requests = _requests(b).withColumn("configured_channel", F.lit("pager"))
        routed = N.route_channels(requests).filter(F.col("channel") == "pager").drop("configured_channel", "channel")
        return N.render_notifications(routed, ["pager", "logging"])


ROUTE = ("CASE event_id % 6 WHEN 0 THEN 'console' WHEN 1 THEN 'logging' WHEN 2 THEN 'slack' "
         "WHEN 3 THEN 'webhook' WHEN 4 THEN 'pager' END")


@query("channel_routing", bindings=["b_commands"], oracle=f"""
SELECT configured_channel, CASE WHEN configured_channel IN ('console', 'logging', 'slack', 'webhook')
       THEN configured_channel ELSE 'console' END AS channel, CAST(count(*) AS BIGINT) AS notifications
FROM (SELECT {ROUTE} AS configured_channel FROM b_commands) t GROUP BY 1, 2
""")
def _channel_routing(b):
    """Configured channel to effective channel."""
    c = b.b_commands.select(F.expr(ROUTE).alias("configured_channel"))
    return N.route_channels(c).groupBy("configured_channel", "channel").agg(
        F.count(F.lit(1)).cast("bigint").alias("notifications"))


TYPE_BY_RUN = ("CASE run_id % 4 WHEN 0 THEN 'llm-wrapper' WHEN 1 THEN 'api' WHEN 2 THEN 'frontend' "
               "ELSE 'mobile' END")
SKIP_BY_RUN = "CASE run_id % 3 WHEN 0 THEN 'testing' WHEN 1 THEN 'documentation' END"
CUSTOM_PROMPT = "Custom scaffold for {project_path}"


@query("stage_plan", bindings=["b_run_overrides"], oracle=f"""
WITH r AS (SELECT run_id, CASE WHEN wt IN ('api', 'frontend', 'llm-wrapper') THEN wt ELSE 'llm-wrapper' END AS workflow_type,
                  '/projects/run-' || CAST(run_id AS VARCHAR) AS project_path, skip
           FROM (SELECT run_id, {TYPE_BY_RUN} AS wt, {SKIP_BY_RUN} AS skip FROM b_run_overrides) x)
SELECT r.run_id, r.workflow_type, t.ord, t.name AS stage,
       replace(CASE WHEN r.run_id % 5 = 0 AND t.name = 'scaffold' THEN '{CUSTOM_PROMPT}' ELSE t.prompt_template END,
               '{{project_path}}', r.project_path) AS prompt,
       t.requires_approval, t.critical_path, t.skip_tests, {S.TEMPLATE_MAX_TOKENS} AS max_tokens,
       CAST({S.TEMPLATE_TEMPERATURE} AS DOUBLE) AS temperature
FROM r JOIN {S.templates_sql()} t ON r.workflow_type = t.workflow_type
WHERE r.skip IS NULL OR t.name <> r.skip
""")
def _stage_plan(b):
    """Stage plan per run from templates, skips and custom prompts."""
    o = b.b_run_overrides
    runs = o.select("run_id", F.expr(TYPE_BY_RUN).alias("workflow_type"),
                    F.concat(F.lit("/projects/run-"), F.col("run_id").cast("string")).alias("project_path"))
    skips = o.select("run_id", F.expr(SKIP_BY_RUN).alias("stage")).filter(F.col("stage").isNotNull())
    overrides = o.filter(F.col("run_id") % 5 == 0).select(
        "run_id", F.lit("scaffold").alias("stage"), F.lit(CUSTOM_PROMPT).alias("prompt"))
    return ST.stage_plan(runs, S.templates_df(b.spark), skips, overrides)
