"""Plans of the stream queries: what they read and shuffle once."""

from flowmetrics.plans import q_io
from flowmetrics.plans.tables import Bindings


def _events(spark, path, n=200):
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 600) AS ts",
        "id % 7 AS user_id", "element_at(array('signup', 'view', 'click', 'purchase', 'error'), int(id % 5) + 1) AS event_type",
        "double(id) AS value", "'{\"n\": 1}' AS props").repartition(4).write.parquet(f"{path}/events.parquet")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stuck_activities_read_all_files(spark, tmp_path, monkeypatch):
    """As many files as tasks, and no lookup a state row for a count."""
    _events(spark, str(tmp_path))
    seen = {}

    def run(b, build, mode):
        seen["files"] = len(spark.read.parquet(seen["paths"][0]).inputFiles())
        return spark.createDataFrame([], "activity_id long, run_id long, activity string, scheduled_at timestamp_ntz, "
                                         "limit_s int, completed_at timestamp_ntz")

    own = q_io.scratch_path
    monkeypatch.setattr(q_io, "scratch_path", lambda s, n: seen.setdefault("paths", []).append(own(s, n)) or seen["paths"][-1])
    monkeypatch.setattr(q_io, "_run", run)
    q_io._stream_stuck(Bindings(spark, str(tmp_path)))
    assert seen["files"] >= 4
    assert q_io.STREAM_CONF["spark__sql__streaming__stateStore__rocksdb__trackTotalNumberOfRows"] == "false"


def test_dedupe_numbers_the_rows_once(spark, tmp_path, monkeypatch):
    """All copies that arrive come from one numbering: a task holds one sort of its rows."""
    _events(spark, str(tmp_path))
    seen = []
    own = q_io._arrivals
    monkeypatch.setattr(q_io, "_arrivals", lambda b, rows: seen.append(rows) or own(b, rows))
    out = q_io._stream_dedupe(Bindings(spark, str(tmp_path)))
    assert _plan(seen[0]).count("Window [") == 1 and "Union" not in _plan(seen[0])
    by = {(r.event_id, r.slice): r["count"] for r in seen[0].groupBy("event_id", "slice").count().collect()}
    assert by[(3, 0)] == 2 and by[(4, 0)] == 1 and by[(4, 1)] == 1 and by[(7, 4)] == 1 and (7, 0) not in by
    assert out.count() == 200 and [r.event_id for r in out.filter("late").collect()] == [7]


def test_outbox_does_not_shuffle_its_lists_again(spark, monkeypatch):
    b = Bindings(spark, "none")
    rows = spark.createDataFrame([(i % 50, f"f{i:03d}") for i in range(400)], "run_id long, path string")
    static = q_io._static_by_run(b, rows)
    keys = spark.range(10).withColumnRenamed("id", "run_id").hint("merge").join(static, "run_id", "left")
    plan = keys._jdf.queryExecution().sparkPlan().toString()
    exchanged = keys._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" in plan and exchanged.count("Exchange hashpartitioning") == 1
    assert static.count() == 400


def test_lists_of_numbered_names_are_the_file_lists(spark):
    from flowmetrics.operators import notify as N
    files = spark.createDataFrame([(i % 3, f"f{i % 20:02d}") for i in range(100)], "run_id long, path string")
    for got, want in zip(N.lists_of(N.numbered_names(files), size=12), (N.file_previews(files), N.file_parts(files, size=12))):
        cols = sorted(want.columns)
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_null_names_keep_their_place_in_previews(spark):
    from flowmetrics.operators import notify as N
    files = spark.createDataFrame([(1, None), (1, "b"), (1, "a"), (2, "c")], "run_id long, path string")
    got = {r.run_id: (r.files_count, r.files_preview) for r in N.previews_of(N.numbered_names(files), n=2).collect()}
    want = {r.run_id: (r.files_count, r.files_preview) for r in N.file_previews(files, n=2).collect()}
    assert got == want == {1: (3, [None, "a"]), 2: (1, ["c"])}
