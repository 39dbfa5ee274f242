"""Edge cases: override parsing quirks, event-log lines from the documents,
rendered notification text, and the sticky gates in batch and in a stream
on a crafted run with overlapping gates and simultaneous signals."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from flowmetrics import schemas as S
from flowmetrics.operators import cost as C
from flowmetrics.operators import gates as G
from flowmetrics.operators import notify as N
from flowmetrics.session import scratch_path
from flowmetrics.sources.events import parse_run_events
from flowmetrics.streaming import streams as SS

T0 = datetime(2024, 1, 14, 12, 0, 0)


def test_override_parsing(spark):
    rows = [(1, "production", "1_000", " 0.25 ", "abc"), (2, "qa", " 8 ", "warm", "8.0"),
            (3, "staging", None, None, "900")]
    o = spark.createDataFrame(rows, "run_id long, environment string, max_tokens string, "
                                    "temperature string, timeout string")
    got = {r.run_id: (r.preset, r.max_tokens, r.temperature, r.timeout_s)
           for r in C.effective_settings(o, S.env_presets_df(spark)).collect()}
    assert got[1] == ("production", 1000, 0.25, 600)      # '1_000' is 1000, as int() reads it
    assert got[2] == ("development", 8, 0.3, 1800)        # unknown env; '8.0' is not an int
    assert got[3] == ("staging", 8000, 0.3, 900)


def test_event_lines_from_the_documents(spark):
    lines = ["[12:34:01] WorkflowStarted",
             "[12:34:02] ActivityScheduled: executeStage (scaffold)",
             "[12:34:45] ActivityCompleted: 2,340 tokens, $0.04",
             "[12:34:52] ActivityCompleted: 15/15 tests passing",
             "[12:36:16] SignalReceived: approve",
             "..."]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rs = parse_run_events(df).collect()
    assert [r.kind for r in rs] == ["WorkflowStarted", "ActivityScheduled", "ActivityCompleted",
                                    "ActivityCompleted", "SignalReceived", None]
    assert rs[1].label == "scaffold"
    assert (rs[2].tokens, str(rs[2].cost)) == (2340, "0.040000000")
    assert (rs[3].tests_passing, rs[3].tests_total) == (15, 15)
    assert rs[0].second_of_day == 12 * 3600 + 34 * 60 + 1


def test_console_and_logging_render(spark):
    req = spark.createDataFrame(
        [(1, "core-implementation", [f"f{i}.py" for i in range(10)], 12, "http://diff")],
        "request_id long, stage string, files_preview array<string>, files_count long, diff_url string"
    ).withColumn("message", N.approval_message(F.col("stage")))
    out = {r.channel: r.payload for r in N.render_notifications(req).collect()}
    console = out["console"].split("\n")
    assert console[0] == "=" * 50 and console[-1] == "=" * 50
    assert console[1] == "NOTIFICATION: Stage 'core-implementation' requires attention"
    assert console[2] == "Message: Stage 'core-implementation' complete. Review required."
    assert console[3] == "Files changed: 12"
    assert console[4] == "  - f0.py" and console[14] == "  ... and 2 more"
    assert console[15] == "View diff: http://diff"
    assert out["logging"] == ("Notification: stage=core-implementation, message=Stage "
                              "'core-implementation' complete. Review required., files_changed=12")
    assert '"diff_url":"http://diff"' in out["webhook"]
    assert out["slack"].count('"type":"section"') == 3


def _tricky(spark):
    s = timedelta(seconds=1)
    gates = [(1, 1, "a", T0), (2, 1, "b", T0 + 100 * s), (3, 1, "c", T0 + 5000 * s),
             (4, 2, "a", T0), (5, 2, "b", T0 + 10 * s),            # run 2: second gate opens while waiting
             (6, 3, "a", T0 + 50 * s), (7, 3, "b", T0 + 9000 * s)]  # run 3: signal at the opening instant
    sigs = [(1, 1, T0 + 20 * s, "approve"), (2, 1, T0 + 30 * s, "approve"),   # flag set before gate 2
            (3, 1, T0 + 40 * s, "reject"),                                   # last wins: reject
            (4, 2, T0 + 60 * s, "approve"),
            (5, 3, T0 + 50 * s, "approve"), (6, 3, T0 + 9000 * s + 3601 * s, "approve")]
    g = spark.createDataFrame(gates, "gate_id long, run_id long, stage string, opened_at timestamp_ntz")
    sg = spark.createDataFrame(sigs, "signal_id long, run_id long, ts timestamp_ntz, signal string")
    return g, sg


def test_sticky_tricky_batch(spark):
    g, sg = _tricky(spark)
    got = {r.gate_id: r.outcome for r in G.approval_gates(g, sg, mode="sticky").collect()}
    assert got == {1: "approved", 2: "rejected", 3: "not_reached",
                   4: "approved", 5: "approved",
                   6: "approved", 7: "timeout"}


def test_sticky_stream_equals_batch(spark):
    g, sg = _tricky(spark)
    gpath, spath = scratch_path(spark, "t-gates"), scratch_path(spark, "t-sigs")
    g.write.parquet(gpath)
    sg.write.parquet(spath)
    end = spark.createDataFrame([(-1, -1, datetime(2200, 1, 1), "approve")], sg.schema)
    end.write.mode("append").parquet(spath)
    gs = SS.to_event_time(spark.readStream.schema(g.schema).parquet(gpath), "opened_at")
    ss = SS.to_event_time(spark.readStream.schema(sg.schema).parquet(spath), "ts")
    out = scratch_path(spark, "t-out")
    SS.run_to_table(SS.approval_gate_stream(gs, ss, "1 hour"), out, scratch_path(spark, "t-ck"))
    stream = {(r.gate_id, r.outcome, r.decided_at) for r in spark.read.parquet(out)
              .filter("run_id >= 0").select("gate_id", "outcome",
                                            F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))
              .collect()}
    batch = {(r.gate_id, r.outcome, r.decided_at)
             for r in G.approval_gates(g, sg, mode="sticky").collect()}
    assert stream == batch


def test_coverage_path_equals_full_parse(spark):
    from flowmetrics.operators import logs as L
    from flowmetrics.plans.tables import Bindings
    b = Bindings(spark, "/root/testdata/sf0.001")
    full = L.parse_test_logs(b.b_test_logs).select("run_id", "framework", "ts", "coverage")
    lean = L.test_coverage(b.b_test_logs).select("run_id", "framework", "ts", "coverage")
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, lean.collect()))
    assert lean.filter("coverage IS NOT NULL").count() > 0


def test_activity_pairs_without_ids(spark):
    from flowmetrics.operators import joins as J
    s = timedelta(seconds=1)
    rows = [(None, 1, "execute", "ActivityScheduled", T0),
            (None, 1, "execute", "ActivityCompleted", T0 + 43 * s),
            (None, 1, "tests", "ActivityScheduled", T0 + 44 * s),
            (None, 1, "tests", "ActivityCompleted", T0 + 50 * s),
            (None, 1, "notify", "ActivityScheduled", T0 + 50 * s),   # completion at the same instant is earlier
            (7, 2, "execute", "ActivityScheduled", T0),
            (7, 2, "execute", "ActivityCompleted", T0 + 5 * s)]
    ev = spark.createDataFrame(rows, "activity_id long, run_id long, activity string, kind string, "
                                     "at timestamp_ntz")
    got = {(r.run_id, r.activity): r.duration_ms for r in J.activity_durations(ev).collect()}
    assert got == {(1, "execute"): 43000, (1, "tests"): 6000, (1, "notify"): None,
                   (2, "execute"): 5000}


def test_run_id_from_path(spark, tmp_path):
    from flowmetrics.sources.metrics import read_metrics
    for run in ("11", "run-1700000000000"):
        d = tmp_path / f"run_id={run}"
        d.mkdir()
        (d / "metrics.jsonl").write_text(
            '{"stage": "scaffold", "tokens_used": 10, "cost": 0.00009, "duration_ms": 1, '
            '"files_modified": 0, "lines_added": 0, "lines_removed": 0, "tests_pass": true, '
            '"error": null, "timestamp": "2024-01-14T12:00:00"}\n{broken\n')
    good, bad = read_metrics(spark, str(tmp_path), run_id_from_path=True)
    assert sorted(r.run_id for r in good.select("run_id").collect()) == ["11", "run-1700000000000"]
    assert bad.count() == 2


def test_dashboard_drops_rows_behind_the_watermark(spark):
    """S5 in update mode: a restart on the same checkpoint keeps the
    watermark; a row older than it (here 5 h late against a 2 h watermark)
    is not counted, an on-time row is.  (Complete mode keeps every window and
    so never drops late rows; the registered query uses it for batch parity.)"""
    from decimal import Decimal
    schema = ("run_id long, seq long, stage string, tokens_used long, cost decimal(18,9), "
              "duration_ms long, tests_pass boolean, ts timestamp_ntz")
    first = [(1, i, "scaffold", 10, Decimal("0.00009"), 1000, True, T0 + timedelta(hours=i))
             for i in range(6)]
    later = [(1, 7, "scaffold", 10, Decimal("0.00009"), 1000, True, T0),                      # late
             (1, 8, "scaffold", 10, Decimal("0.00009"), 1000, True, T0 + timedelta(hours=5))]  # on time
    src, out, ck = scratch_path(spark, "t-dash"), scratch_path(spark, "t-dash-out"), scratch_path(spark, "t-dash-ck")
    spark.createDataFrame(first, schema).write.parquet(src)

    def run():
        s = SS.to_event_time(spark.readStream.schema(schema).parquet(src))
        SS.run_to_table(SS.windowed_dashboard(s, "1 hour", "2 hours"), out, ck, mode="update")

    run()
    spark.createDataFrame(later, schema).write.mode("append").parquet(src)
    run()
    latest = {}
    for r in spark.read.parquet(out).select(
            F.col("window_start").cast("timestamp_ntz").alias("w"), "records", "batch_id").collect():
        if r.w.hour not in latest or r.batch_id > latest[r.w.hour][0]:
            latest[r.w.hour] = (r.batch_id, r.records)
    rows = {h: rec for h, (_, rec) in latest.items()}
    assert rows[12] == 1          # the 12:00 row counted once; its late copy dropped
    assert rows[17] == 2          # the on-time row joined its window


def test_python_number_rules_of_overrides(spark):
    from flowmetrics import schemas as S
    from flowmetrics.operators.cost import effective_settings
    rows = [("0.7f", None), ("0.7d", 0.7), ("1_0.5", 10.5), ("1__0", None), (" 2. ", 2.0), (".5e1", 5.0), ("x", None)]
    o = spark.createDataFrame([(i, "staging", None, t, "1_0") for i, (t, _) in enumerate(rows)],
                              "run_id long, environment string, max_tokens string, temperature string, timeout string")
    got = {r.run_id: r for r in effective_settings(o, S.env_presets_df(spark)).collect()}
    preset = float({p[0]: p[2] for p in S.ENV_PRESETS}["staging"])
    for i, (text, want) in enumerate(rows):
        want = preset if text == "0.7d" or want is None else want
        assert got[i].temperature == want, text
        assert got[i].timeout_s == 10


def test_malformed_run_ids_are_kept(spark):
    from flowmetrics import schemas as S
    from flowmetrics.operators.cost import decode_run_ids
    df = spark.createDataFrame([("garbage",), ("",), (None,), ("x-99999999999999999999999",)], "workflow_id string")
    got = decode_run_ids(df, S.run_id_prefixes_df(spark)).collect()
    assert sum(r.runs for r in got) == 4 and all(r.workflow_type is None for r in got)


def test_npm_empty_output_and_text_coverage(spark):
    from flowmetrics.operators.logs import parse_test_logs
    logs = spark.createDataFrame(
        [(1, "npm", "", 1), (2, "npm", " ", 1),
         (3, "npm", '{"success":true,"numTotalTests":5,"numPassedTests":5,"numFailedTests":0,'
                    '"coverageMap":{"total":{"lines":{"pct":"Unknown"}}}}', 0)],
        "run_id long, framework string, output string, return_code int")
    got = {r.run_id: r for r in parse_test_logs(logs).collect()}
    assert (got[1].total_tests, got[1].passed, got[1].failed, got[1].errors) == (0, 0, 1, [""])
    assert (got[2].failed, got[2].errors) == (1, [" "])
    assert (got[3].total_tests, got[3].passed, got[3].coverage) == (5, 5, None)


def test_unknown_framework_falls_back_to_detection(spark):
    from flowmetrics.operators.logs import parse_test_logs, with_detected
    logs = spark.createDataFrame([(1, "p", None, "2 passed", 0), (2, "p", "mocha", "1 passed", 0), (3, "q", None, "", 0)],
                                 "run_id long, project_id string, framework string, output string, return_code int")
    found = spark.createDataFrame([("p", "pytest")], "project_id string, framework string")
    got = {r.run_id: r for r in parse_test_logs(with_detected(logs, found)).collect()}
    assert got[1].passed == 2 and got[2].passed == 1 and got[2].framework == "pytest"
    assert got[3].errors == ["No supported test framework detected"]


def test_missing_tool(spark):
    from flowmetrics.operators.logs import parse_test_logs
    logs = spark.createDataFrame([(1, "cargo", None, 1, True)],
                                 "run_id long, framework string, output string, return_code int, tool_missing boolean")
    r = parse_test_logs(logs).first()
    assert (r.failed, r.errors) == (1, ["cargo not found"])


def test_zero_cost_run_has_no_share(spark):
    from flowmetrics.operators.windows import stage_ranking
    m = spark.createDataFrame([(1, "a", Decimal(0), 1)], "run_id long, stage string, cost decimal(18,9), tokens_used long")
    assert stage_ranking(m).first().cost_share is None


def test_hourly_usage_keeps_hours(spark):
    from flowmetrics.operators.windows import usage_trend
    m = spark.createDataFrame([(T0 + timedelta(hours=i), 1, Decimal(0)) for i in range(3)],
                              "ts timestamp_ntz, tokens_used long, cost decimal(18,9)")
    assert usage_trend(m, "hour").count() == 3


def test_webhook_carries_every_file_in_parts(spark):
    import json
    from flowmetrics.operators import notify as N
    files = spark.createDataFrame([(1, f"f{i:02d}") for i in range(14)], "run_id long, path string")
    req = spark.createDataFrame([(9, 1, "s", "m", ["f00"], 14, None), (8, 2, "s", "m", None, None, None)],
                                "request_id long, run_id long, stage string, message string, "
                                "files_preview array<string>, files_count long, diff_url string")
    got = N.render_notifications(req, ["webhook"], files=N.file_parts(files, size=6)).collect()
    parts = sorted((r.part, json.loads(r.payload)) for r in got if r.request_id == 9)
    assert [p["part"] for _, p in parts] == [1, 2, 3] and parts[0][1]["parts"] == 3
    assert sum((p["files_changed"] for _, p in parts), []) == [f"f{i:02d}" for i in range(14)]
    assert json.loads([r for r in got if r.request_id == 8][0].payload)["files_changed"] == []


def test_preview_with_another_length(spark):
    from flowmetrics.operators import notify as N
    files = spark.createDataFrame([(1, f"f{i}") for i in range(8)], "run_id long, path string")
    p = N.file_previews(files, n=5).select(N.preview_text(F.col("files_preview"), F.col("files_count"), 5).alias("t"))
    assert p.first().t.split("\n")[-1] == "... and 3 more"


def test_outbox_is_idempotent_across_batches(spark, tmp_path):
    from flowmetrics.sources.outbox import read_outbox, write_outbox
    df = spark.createDataFrame([(1, "slack", "x"), (1, "slack", "x")], "request_id long, channel string, payload string")
    for batch in (0, 1, 0):
        write_outbox(df, str(tmp_path / "o"), batch)
    assert read_outbox(spark, str(tmp_path / "o")).count() == 1


def test_shapes_keep_broken_lines_apart_and_read_zones(spark, tmp_path):
    from flowmetrics.sources.metrics import normalise_metrics, read_metric_shapes
    (tmp_path / "m").write_text('{"feature":"f","branch":"b","testsPassing":true,"timestamp":"2024-01-14T12:34:56.789Z"}\n'
                                '{"stage":"s","timestamp":"2024-01-14T12:34:56+02:00"}\n'
                                '{"stage":"t","timestamp":"2024-01-14T12:34:56"}\n{broken\n')
    good, bad = read_metric_shapes(spark, str(tmp_path / "m"))
    got = {r.stage: r for r in normalise_metrics(good).collect()}
    assert bad.count() == 1 and set(got) == {"feature-f", "s", "t"} and got["feature-f"].kind == "feature"
    assert got["feature-f"].timestamp == datetime(2024, 1, 14, 12, 34, 56, 789000)
    assert got["s"].timestamp == datetime(2024, 1, 14, 10, 34, 56)
    assert got["t"].timestamp == datetime(2024, 1, 14, 12, 34, 56)


def test_scaffold_prompt_text():
    from flowmetrics.schemas import STAGE_TEMPLATES
    text = [t[3] for t in STAGE_TEMPLATES if t[0] == "llm-wrapper" and t[2] == "scaffold"][0]
    assert text.endswith("- Cost tracking\nSetup project structure in {project_path}")


def test_plan_gives_complexity_and_budget(spark):
    from flowmetrics import schemas as S
    from flowmetrics.operators import cost as C
    from flowmetrics.operators import stages as ST
    runs = spark.createDataFrame([(1, "api", "/p")], "run_id long, workflow_type string, project_path string")
    plan = C.plan_complexity(ST.stage_plan(runs, S.templates_df(spark))).withColumn("seq", F.col("ord"))
    est = C.budget_estimate(plan, S.complexity_df(spark)).collect()
    assert {r.complexity for r in est} <= {"high", "medium"} and len(est) == plan.count()
    assert all(r.tokens_estimate == r.prompt_tokens * (9 if r.complexity == "high" else 5) for r in est)


def test_registered_channel_is_rendered_and_routed(spark):
    from flowmetrics.operators import notify as N
    N.register_renderer("pager", lambda stage, message, preview, count, diff_url: stage)
    try:
        df = spark.createDataFrame([("pager",), ("fax",)], "configured_channel string")
        assert sorted(r.channel for r in N.route_channels(df).collect()) == ["console", "pager"]
        req = spark.createDataFrame([(1, "s", "m", None, None, None)], "request_id long, stage string, message string, "
                                    "files_preview array<string>, files_count long, diff_url string")
        assert "pager" in {r.channel for r in N.render_notifications(req).collect()}
    finally:
        del N.RENDERERS["pager"]


def test_registered_dialect_is_used(spark):
    from flowmetrics.operators.logs import parse_test_logs, register_dialect
    from flowmetrics.functions import testlogs
    register_dialect("Tap", testlogs.parse_pytest)
    try:
        logs = spark.createDataFrame([(1, "TAP", "3 passed", 0)], "run_id long, framework string, output string, return_code int")
        assert parse_test_logs(logs).first().passed == 3
    finally:
        del testlogs.DIALECTS["tap"]


def test_progress_against_the_runs_own_plan(spark):
    from flowmetrics.operators.windows import run_state
    m = spark.createDataFrame([(1, i + 1, s, 1, Decimal(0), True) for i, s in enumerate(["a", "b", "x"])],
                              "run_id long, seq long, stage string, tokens_used long, cost decimal(18,9), tests_pass boolean")
    snaps = spark.createDataFrame([], "run_id long, snapshot_id string, ts timestamp_ntz, event_id long")
    plan = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "run_id long, stage string")
    assert run_state(m, snaps, plan).first().progress == "2/3"


def test_only_critical_failures_roll_back_by_default(spark):
    from flowmetrics.operators.joins import rollback_targets
    m = spark.createDataFrame([(1, 1, "streaming", T0, 1, False), (1, 2, "documentation", T0, 2, False)],
                              "run_id long, seq long, stage string, ts timestamp_ntz, event_id long, tests_pass boolean")
    snaps = spark.createDataFrame([(1, "s", T0, 0)], "run_id long, snapshot_id string, ts timestamp_ntz, event_id long")
    assert [r.stage for r in rollback_targets(m, snaps).collect()] == ["streaming"]
