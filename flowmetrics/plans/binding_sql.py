"""Binding SQL: scalable stand-ins for every domain table over the given
parquet tables (the texts of FIXTURES.md section B).  The DuckDB oracle uses
them verbatim; Spark runs the same text except where a per-run window would
send a hot key to one task (see :mod:`flowmetrics.plans.tables`)."""

BINDING_SQL = {
    "b_stage_metrics": """
SELECT user_id AS run_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       event_id,
       CASE event_type WHEN 'signup' THEN 'scaffold' WHEN 'view' THEN 'core-implementation'
            WHEN 'click' THEN 'streaming' WHEN 'purchase' THEN 'testing' ELSE 'error-handling' END AS stage,
       CAST(round(value * 100) AS BIGINT) AS tokens_used,
       CAST(CAST(round(value * 100) AS BIGINT) * CAST(0.000009 AS DECIMAL(12,9)) AS DECIMAL(18,9)) AS cost,
       CAST((event_id % 600 + 1) * 1000 AS BIGINT) AS duration_ms,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS files_modified,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 3 AS lines_added,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS lines_removed,
       NOT (event_type = 'error' AND event_id % 2 = 0) AS tests_pass,
       CASE WHEN event_type = 'error' AND event_id % 10 = 1 THEN 'Critical stage error-handling failed tests'
            WHEN event_type = 'error' AND event_id % 10 = 5 THEN 'Approval timeout for stage core-implementation'
       END AS error,
       ts
FROM events
""",
    "b_executions": """
SELECT conv_id AS run_id, turn AS seq, prompt, output
FROM (SELECT conv_id, turn, role, text AS prompt,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output
      FROM conversations) t
WHERE role = 'user' AND next_role = 'assistant'
""",
    "b_gates": """
SELECT event_id AS gate_id, user_id AS run_id, 'core-implementation' AS stage, ts AS opened_at
FROM events WHERE event_type = 'view' AND event_id % 3 = 0
""",
    "b_signals": """
SELECT event_id AS signal_id, user_id AS run_id, ts,
       CASE WHEN event_type = 'click' THEN 'approve' ELSE 'reject' END AS signal
FROM events WHERE event_type IN ('click', 'error')
""",
    "b_snapshots": """
SELECT user_id AS run_id, event_id, concat('snapshot-', CAST(1700000000 + event_id AS VARCHAR(20))) AS snapshot_id, ts
FROM events WHERE event_type = 'view'
""",
    "b_feature_runs": """
SELECT o_custkey AS run_id, o_orderkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx,
       concat('Add Feature ', CAST(o_orderkey % 97 AS VARCHAR(10))) AS feature,
       o_orderstatus <> 'F' AS success,
       o_orderpriority = '5-LOW' AS raised,
       CAST(round(o_totalprice) AS BIGINT) AS tokens_used,
       CAST((o_orderkey % 600 + 1) * 1000 AS BIGINT) AS duration_ms
FROM orders
""",
    "b_iterations": """
SELECT l_orderkey AS issue_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_shipdate, l_returnflag, l_linestatus) AS INT) AS iteration,
       l_returnflag = 'R' AS tests_pass,
       CAST(l_quantity AS BIGINT) * 100 AS tokens_used
FROM lineitem
""",
    "b_test_logs": """
SELECT l_orderkey AS run_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pytest' WHEN 2 THEN 'cargo' ELSE 'go' END AS framework,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS return_code,
       CAST((l_partkey % 60 + 1) * 1000 AS BIGINT) AS duration_ms,
       l_shipdate AS ts,
       CASE l_linenumber % 4
         WHEN 0 THEN CASE WHEN l_linestatus = 'O'
              THEN concat('{"success": ', CASE WHEN l_returnflag = 'A' THEN 'false' ELSE 'true' END,
                   ', "numTotalTests": ', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)),
                   ', "numPassedTests": ', CAST(CAST(l_quantity AS INT) - 1 AS VARCHAR(10)), ', "numFailedTests": 1, "coverageMap": {"total": {"lines": {"pct": ',
                   CAST(l_partkey % 100 AS VARCHAR(10)), '.5}}}}')
              ELSE 'npm ERR! missing script: test' END
         WHEN 1 THEN concat('..F', CASE WHEN l_returnflag = 'A' THEN ' 2 failed,' ELSE '' END, ' ',
                   CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), ' passed',
                   CASE WHEN l_linestatus = 'F' THEN ', 1 error' ELSE '' END, ' in 0.12s')
         WHEN 2 THEN concat('test a::b ... ok', chr(10), 'test a::c ... ',
                   CASE WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'ok' END)
         ELSE concat('--- PASS: TestA (0.00s)', chr(10), CASE WHEN l_returnflag = 'A' THEN '--- FAIL: TestB (0.00s)'
                   ELSE '    --- PASS: TestB/sub (0.00s)' END) END AS output
FROM lineitem
""",
    "b_file_status": """
SELECT l_orderkey AS run_id, CASE WHEN l_linestatus = 'F' THEN 'before' ELSE 'after' END AS phase,
       concat('src/part', CAST(l_partkey % 50 AS VARCHAR(10)), '.py') AS path
FROM lineitem
""",
    "b_diff_stats": """
SELECT l_orderkey AS run_id, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_returnflag = 'N' THEN concat(' 1 file changed, ', CAST(l_partkey AS VARCHAR(20)), ' insertions(+)')
            ELSE concat(' 2 files changed, ', CAST(l_partkey AS VARCHAR(20)), ' insertions(+), ',
                        CAST(l_suppkey AS VARCHAR(20)), ' deletions(-)') END AS diff_output
FROM lineitem
""",
    "b_commands": """
SELECT event_id, user_id AS session_id, ts,
       CASE event_type WHEN 'signup' THEN '/project:create-feature' WHEN 'view' THEN '/documentation:api-docs'
            WHEN 'click' THEN '/testing:generate-tests' WHEN 'purchase' THEN '/deployment:prepare-release'
            ELSE '/development:debug-session' END AS command,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'ERROR: failed'
            WHEN event_id % 11 = 0 THEN 'finished with 0 errors'
            WHEN event_id % 17 = 0 THEN 'opened https://github.com/acme/app/pull/17 for review' ELSE 'ok' END AS output,
       CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS exit_code,
       CAST(round(value * 100) AS BIGINT) AS tokens_used,
       CAST((event_id % 600 + 1) * 1000 AS BIGINT) AS duration_ms
FROM events
""",
    "b_run_overrides": """
SELECT c_custkey AS run_id,
       CASE c_nationkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' ELSE 'qa' END AS environment,
       CASE c_custkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(1000 + c_custkey AS VARCHAR(20)) END AS max_tokens,
       CASE c_custkey % 7 WHEN 0 THEN 'warm' WHEN 1 THEN '0.7' END AS temperature,
       CASE c_custkey % 3 WHEN 0 THEN '900' END AS timeout
FROM customer
""",
    "b_activity_events": """
SELECT event_id AS activity_id, user_id AS run_id,
       CASE event_type WHEN 'signup' THEN 'estimate' WHEN 'view' THEN 'execute' WHEN 'click' THEN 'tests'
            WHEN 'purchase' THEN 'snapshot' ELSE 'notify' END AS activity,
       ts AS scheduled_at,
       CASE WHEN event_id % 9 <> 0 THEN CAST((event_id % 600 + 1) * 2 AS BIGINT) END AS completed_after_s
FROM events
""",
    "b_project_files": """
SELECT l_orderkey AS project_id,
       CASE l_partkey % 8 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pyproject.toml' WHEN 2 THEN 'Cargo.toml'
            WHEN 3 THEN 'go.mod' WHEN 4 THEN 'tests/test_a.py' ELSE concat('src/f', CAST(l_partkey % 50 AS VARCHAR(10)), '.c') END AS path
FROM lineitem
""",
    "b_commits": """
SELECT user_id AS run_id, concat('c', CAST(event_id AS VARCHAR(20))) AS hash, event_id, ts,
       CASE WHEN event_type = 'view' THEN concat('Snapshot: snapshot-', CAST(1700000000 + event_id % 40 AS VARCHAR(20)))
            ELSE concat('work ', CAST(event_id AS VARCHAR(20))) END AS message
FROM events
""",
    "b_agent_steps": """
SELECT user_id AS run_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step,
       CASE WHEN event_id % 29 = 0 THEN 'DONE' ELSE '/testing:generate-tests' END AS decision,
       event_id % 31 <> 0 AS decision_ok,
       event_type <> 'error' AS success
FROM events
""",
}
