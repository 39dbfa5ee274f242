"""Golden rows (FIXTURES.md section C), one test per line."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from flowmetrics import schemas as S
from flowmetrics.operators import aggregates as agg
from flowmetrics.operators import cost as C
from flowmetrics.operators import gates as G
from flowmetrics.operators import logs as L
from flowmetrics.operators import notify as N
from flowmetrics.operators import windows as W

T0 = datetime(2024, 1, 14, 12, 0, 0)


def test_tokens_floor_and_ceil(spark):
    df = spark.createDataFrame([("abcdefg",)], "t string")
    r = df.select(C.estimate_tokens(F.col("t")).alias("f"),
                  C.estimate_tokens(F.col("t"), "ceil").alias("c")).first()
    assert (r.f, r.c) == (1, 2)


def test_cost_models(spark):
    df = spark.createDataFrame([(1, m, 1000) for m in ("claude-sonnet-4-5", "claude-opus-4", "x")],
                               "run_id long, model string, tokens_used long")
    got = {r.model: r.cost for r in C.cost_accounting(df, S.pricing_df(spark)).collect()}
    assert got == {"claude-sonnet-4-5": Decimal("0.009"), "claude-opus-4": Decimal("0.045"),
                   "x": Decimal("0.009")}


def test_budget_estimate(spark):
    plan = spark.createDataFrame([(1, 1, "a" * 400, "high"), (1, 2, "a" * 400, "unknown")],
                                 "run_id long, seq long, prompt string, complexity string")
    got = {r.seq: (r.tokens_estimate, r.estimated_cost)
           for r in C.budget_estimate(plan, S.complexity_df(spark)).collect()}
    assert got == {1: (900, Decimal("0.0081")), 2: (500, Decimal("0.0045"))}


def test_stage_cost_table(spark):
    toks = [2340, 12850, 8420, 6780, 15200, 4100]
    costs = ["0.04", "0.23", "0.15", "0.12", "0.27", "0.07"]
    m = spark.createDataFrame([(1, i, f"s{i}", t, Decimal(c)) for i, (t, c) in enumerate(zip(toks, costs))],
                              "run_id long, seq long, stage string, tokens_used long, cost decimal(18,9)")
    total = agg.stage_cost_report(m).filter("stage = 'TOTAL'").first()
    assert (total.tokens, total.cost) == (49690, Decimal("0.88"))
    assert agg.total_cost(m).first().total_cost == total.cost


def test_parallel_timing(spark):
    fr = spark.createDataFrame([(1, d * 1000) for d in (204, 135, 241, 333)], "run_id long, duration_ms long")
    r = agg.parallel_speedup(fr).first()
    assert (r.serial_ms, r.elapsed_ms, round(r.speedup, 1)) == (913000, 333000, 2.7)


def _metrics(spark, durations, start=datetime(2024, 1, 14, 12, 0, 1)):
    rows, t = [], start
    for i, d in enumerate(durations, start=1):
        rows.append((1, i, f"s{i}", 0, Decimal(0), d * 1000, 0, True, None, t))
        t += timedelta(seconds=d)
    return spark.createDataFrame(rows, "run_id long, seq long, stage string, tokens_used long, "
                                       "cost decimal(18,9), duration_ms long, files_modified int, "
                                       "tests_pass boolean, error string, ts timestamp_ntz")


def test_timeline(spark):
    m = _metrics(spark, [135, 270, 200, 165, 310, 110])
    ends = [r.end_at.strftime("%H:%M:%S") for r in W.stage_timeline(m).orderBy("seq").collect()]
    assert ends == ["12:02:16", "12:06:46", "12:10:06", "12:12:51", "12:18:01", "12:19:51"]


def test_iterations_and_backoff(spark):
    it = spark.createDataFrame([(1, 1, False, 10), (1, 2, False, 10), (1, 3, True, 10), (1, 4, True, 10)],
                               "issue_id long, iteration int, tests_pass boolean, tokens_used long")
    r = W.iteration_outcomes(it).first()
    assert (r.iterations, r.status, r.backoff_s, r.message, r.tokens_used) == \
        (3, "resolved", 15, "Issue resolved in 3 iteration(s)", 30)


def test_iterations_exhausted(spark):
    it = spark.createDataFrame([(1, i, False, 1) for i in range(1, 8)],
                               "issue_id long, iteration int, tests_pass boolean, tokens_used long")
    r = W.iteration_outcomes(it).first()
    assert (r.iterations, r.status, r.backoff_s) == (5, "exhausted", 5 + 10 + 15 + 20 + 25)


def test_branch_names(spark):
    df = spark.createDataFrame([(0, "User  Auth")], "idx int, feature string")
    r = df.select(agg.branch_name(F.col("idx"), F.col("feature")).alias("p"),
                  agg.branch_name(F.col("idx"), F.col("feature"), "collapse").alias("c")).first()
    assert (r.p, r.c) == ("feature-0-user--auth", "feature-0-User-Auth")
    r2 = spark.createDataFrame([(0, "User Auth")], "idx int, feature string") \
        .select(agg.branch_name(F.col("idx"), F.col("feature")).alias("p")).first()
    assert r2.p == "feature-0-user-auth"


def test_run_id_decode(spark):
    df = spark.createDataFrame([("llm-wrapper-dev-1705234567890",), ("other-1",)], "workflow_id string")
    got = {(r.prefix, r.workflow_type, str(r.start_day)) for r in
           C.decode_run_ids(df, S.run_id_prefixes_df(spark)).collect()}
    assert ("llm-wrapper-dev", "develop", "2024-01-14") in got
    assert ("other", None, "1970-01-01") in got


def test_diff_stat(spark):
    df = spark.createDataFrame([(1, "2 files changed, 5 insertions(+), 3 deletions(-)"),
                                (2, "1 file changed, 5 insertions(+)")], "run_id long, diff_output string")
    got = {r.run_id: (r.lines_added, r.lines_removed) for r in L.diff_totals(df).collect()}
    assert got == {1: (5, 3), 2: (0, 0)}


def test_porcelain(spark):
    df = spark.createDataFrame([(1, " M a.py\n?? b c.py\nR  x -> y\n\nsolo")], "run_id long, raw string")
    assert [r.file for r in L.changed_files(df).collect()] == ["a.py", "b c.py", "x -> y"]


def _logs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, framework string, output string, return_code int")


def test_pytest_counts(spark):
    r = L.parse_test_logs(_logs(spark, [(1, "pytest", "3 failed, 7 passed, 2 errors in 1s", 1)])).first()
    assert (r.total_tests, r.passed, r.failed, r.success) == (12, 7, 5, False)


def test_npm_bad_json(spark):
    rs = L.parse_test_logs(_logs(spark, [(1, "npm", "boom", 1), (2, "npm", "boom", 0)])).orderBy("run_id").collect()
    assert [(r.total_tests, r.passed, r.failed, r.errors) for r in rs] == [(0, 0, 1, ["boom"]), (0, 1, 0, [])]


def test_npm_json(spark):
    out = '{"numTotalTests": 4, "numPassedTests": 3, "numFailedTests": 1, "coverageMap": {"total": {"lines": {"pct": 81.5}}}}'
    r = L.parse_test_logs(_logs(spark, [(1, "npm", out, 1)])).first()
    assert (r.success, r.total_tests, r.passed, r.failed, r.coverage, r.errors) == (False, 4, 3, 1, 81.5, [])


def test_dispatch(spark):
    df = _logs(spark, [(1, "PyTest", "2 passed", 0), (2, None, "x", 0), (3, "pytest", "", 127)]) \
        .withColumn("tool_missing", F.col("run_id") == 3)
    rs = {r.run_id: r for r in L.parse_test_logs(df).collect()}
    assert (rs[1].framework, rs[1].passed) == ("pytest", 2)
    assert (rs[2].total_tests, rs[2].passed, rs[2].failed, rs[2].errors) == \
        (0, 0, 1, ["No supported test framework detected"])
    assert rs[3].errors == ["pytest not found"]


def test_cargo_and_go(spark):
    rs = {r.run_id: r for r in L.parse_test_logs(_logs(spark, [
        (1, "cargo", "test a::b ... ok\ntest a::c ... FAILED", 101),
        (2, "go", "--- PASS: TestA (0.00s)\n    --- PASS: TestB/sub (0.00s)", 0)])).collect()}
    assert (rs[1].passed, rs[1].failed, rs[2].passed, rs[2].failed) == (1, 1, 2, 0)


def test_failure_row_flag(spark):
    m = _metrics(spark, [10]).withColumn("error", F.lit("Final test suite failed"))
    assert agg.failed_stages(m).count() == 0
    assert agg.failed_stages(m, include_errors=True).count() == 1


def test_file_preview(spark):
    files = spark.createDataFrame([(1, f"f{i:02d}.py") for i in range(12)], "run_id long, path string")
    p = N.file_previews(files).first()
    text = spark.createDataFrame([p], p.__fields__) \
        .select(N.preview_text(F.col("files_preview"), F.col("files_count")).alias("t")).first().t
    assert text.split("\n")[0] == "- f00.py" and text.split("\n")[-1] == "... and 2 more"
    assert len(text.split("\n")) == 11


def _gates(spark, gates, signals):
    g = spark.createDataFrame([(gid, 1, "s", T0 + timedelta(seconds=t)) for gid, t in gates],
                              "gate_id long, run_id long, stage string, opened_at timestamp_ntz")
    s = spark.createDataFrame([(sid, 1, T0 + timedelta(seconds=t), v) for sid, t, v in signals],
                              "signal_id long, run_id long, ts timestamp_ntz, signal string")
    return g, s


def test_sticky_signal_before_gate(spark):
    g, s = _gates(spark, [(1, 10)], [(1, 5, "approve")])
    r = G.approval_gates(g, s, mode="sticky").first()
    assert (r.outcome, r.decided_at) == ("approved", T0 + timedelta(seconds=10))
    assert G.approval_gates(g, s, mode="independent").first().outcome == "timeout"


def test_gate_timeout(spark):
    g, s = _gates(spark, [(1, 0)], [(1, 3601, "approve")])
    for mode in ("sticky", "independent"):
        r = G.approval_gates(g, s, mode=mode).first()
        assert (r.outcome, r.decided_at) == ("timeout", T0 + timedelta(seconds=3600)), mode


def test_sticky_cut_after_rejection(spark):
    g, s = _gates(spark, [(1, 0), (2, 10000)], [(1, 30, "reject"), (2, 10010, "approve")])
    got = {r.gate_id: r.outcome for r in G.approval_gates(g, s, mode="sticky").collect()}
    assert got == {1: "rejected", 2: "not_reached"}


def test_sticky_flag_consumed(spark):
    # approval at 20 decides gate 1 and is cleared; gate 2 waits for a new signal
    g, s = _gates(spark, [(1, 0), (2, 100)], [(1, 20, "approve"), (2, 150, "reject")])
    got = {r.gate_id: (r.outcome, r.wait_ms) for r in G.approval_gates(g, s, mode="sticky").collect()}
    assert got == {1: ("approved", 20000), 2: ("rejected", 50000)}


def test_cooldown(spark):
    m = _metrics(spark, [1, 1, 1, 1]).drop("tokens_used") \
        .withColumn("tokens_used", F.element_at(F.array(*[F.lit(x) for x in (40000, 10000, 1, 9999)]),
                                                F.col("seq").cast("int")).cast("bigint"))
    got = [r.cooldown_s for r in W.cooldowns(m).orderBy("seq").collect()]
    assert got == [0, 0, 30, 30]


def test_metrics_sample_lines(spark, tmp_path):
    from flowmetrics.sources.metrics import read_metrics
    p = tmp_path / "m.jsonl"
    p.write_text(
        '{"stage": "scaffold", "tokens_used": 2345, "cost": 0.0234, "duration_ms": 45000, "files_modified": 12, '
        '"lines_added": 456, "lines_removed": 0, "tests_pass": true, "error": null, "timestamp": "2024-01-14T12:16:08.123456"}\n'
        '{"stage": "core-implementation", "tokens_used": 5678, "cost": 0.0567, "duration_ms": 120000, "files_modified": 8, '
        '"lines_added": 789, "lines_removed": 123, "tests_pass": true, "error": null, "timestamp": "2024-01-14T12:18:15.123456"}\n'
        'not json\n')
    good, bad = read_metrics(spark, str(p))
    assert good.count() == 2 and bad.count() == 1
    assert good.agg(F.sum("cost")).first()[0] == Decimal("0.0801")
    assert good.filter(F.col("error").isNotNull()).count() == 0


def test_status_block(spark):
    rows = [(1, 1, 10, "scaffold", 5000, Decimal("0.0500"), True, T0),
            (1, 2, 11, "core-implementation", 10234, Decimal("0.1023"), False, T0 + timedelta(minutes=5))]
    m = spark.createDataFrame(rows, "run_id long, seq long, event_id long, stage string, tokens_used long, "
                                    "cost decimal(18,9), tests_pass boolean, ts timestamp_ntz")
    snaps = spark.createDataFrame([(1, 1, "snapshot-1705234567", T0), (1, 2, "snapshot-1705234867", T0)],
                                  "run_id long, event_id long, snapshot_id string, ts timestamp_ntz")
    r = W.run_state(m, snaps).first()
    assert (r.current_stage, r.total_tokens_used, r.total_cost, r.tests_passed_count, r.snapshots) == \
        ("core-implementation", 15234, Decimal("0.1523"), 1, 2)
    assert r.last_snapshot == "snapshot-1705234867"


def test_quirk_flags(spark):
    df = spark.createDataFrame([(1, "1 file changed, 5 insertions(+)"),
                                (2, "1 file changed, 4 deletions(-)")], "run_id long, diff_output string")
    got = {r.run_id: (r.lines_added, r.lines_removed) for r in L.diff_totals(df, require_both=False).collect()}
    assert got == {1: (5, 0), 2: (0, 4)}
    it = spark.createDataFrame([(1, i, False, 1) for i in range(1, 6)],
                               "issue_id long, iteration int, tests_pass boolean, tokens_used long")
    assert W.iteration_outcomes(it, backoff_after_last=False).first().backoff_s == 5 + 10 + 15 + 20
    m = _metrics(spark, [1, 1, 1])
    snaps = spark.createDataFrame([], "run_id long, event_id long, snapshot_id string, ts timestamp_ntz")
    assert agg.run_summary(m, snaps, reference_denominator=True).first().testable_stages == 2
    assert agg.run_summary(m, snaps).first().testable_stages == 3
