"""Streams with keyed state over several batches: what is emitted when, what
becomes of rows behind the watermark, and that state goes."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flowmetrics.operators import gates as G
from flowmetrics.session import scratch_path, session_conf
from flowmetrics.streaming import keyed as K
from flowmetrics.streaming import streams as SS

T0 = datetime(2024, 1, 14, 12)
S = timedelta(seconds=1)
FAR = datetime(2200, 1, 1)
GATES = "gate_id long, run_id long, stage string, opened_at timestamp_ntz"
SIGNALS = "signal_id long, run_id long, ts timestamp_ntz, signal string"
CONF = {"spark__sql__session__timeZone": "UTC", "spark__sql__shuffle__partitions": "2",
        **{k.replace(".", "__"): v for k, v in K.STATE_STORE.items()}}


class Batches:
    """A stream fed batch by batch on one checkpoint."""

    def __init__(self, spark, schemas, build, mode="append"):
        self.spark, self.schemas, self.build, self.mode = spark, schemas, build, mode
        self.src = {n: scratch_path(spark, f"t-{n}") for n in schemas}
        self.out, self.ckpt = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt")
        self.states = []
        for p in self.src.values():
            SS.make_folder(spark, p)

    def feed(self, **rows):
        for n, r in rows.items():
            self.spark.createDataFrame(r, self.schemas[n]).coalesce(1).write.mode("append").parquet(self.src[n])
        with session_conf(self.spark, **CONF):
            df = self.build({n: self.spark.readStream.schema(s).parquet(self.src[n]) for n, s in self.schemas.items()})
            for name, kind in df.dtypes:
                if kind == "timestamp":
                    df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
            sink = self._sink()
            q = (df.writeStream.outputMode(self.mode).foreachBatch(sink).option("checkpointLocation", self.ckpt)
                 .trigger(availableNow=True).start())
            q.awaitTermination()
            last = [p for p in q.recentProgress if p["stateOperators"]]
            if last:
                self.states.append(sum(o["numRowsTotal"] for o in last[-1]["stateOperators"]))
            self.schema = df.schema
        return self

    def _sink(self):
        out = self.out

        def sink(batch, batch_id):
            SS.write_batch(batch.withColumn("batch_id", F.lit(batch_id)), out)
        return sink

    def rows(self):
        return SS.table(self.spark, self.out, self.schema).collect()


def gate_batches(spark, watermark="1 hour"):
    return Batches(spark, {"gates": GATES, "signals": SIGNALS}, lambda s: K.gate_stream(
        SS.to_event_time(s["gates"], "opened_at"), SS.to_event_time(s["signals"]), watermark))


def test_gates_of_a_hot_run_over_several_batches(spark):
    """One run holds most rows; its events arrive over four batches, in no order within one."""
    rng = random.Random(4)
    gates, signals = [], []
    for run in (1, 1, 1, 2, 3):
        for _ in range(40):
            gates.append((len(gates), run, "a", T0 + S * rng.randrange(0, 40_000)))
            for _ in range(3):
                signals.append((len(signals), run, T0 + S * rng.randrange(0, 40_000), "approve" if rng.random() < 0.97 else "reject"))
    b = gate_batches(spark)
    for i in range(4):
        lo, hi = T0 + S * 10_000 * i, T0 + S * 10_000 * (i + 1)
        g = [x for x in gates if lo <= x[3] < hi]
        s = [x for x in signals if lo <= x[2] < hi] + ([(-1, -1, FAR, "approve")] if i == 3 else [])
        rng.shuffle(g)
        rng.shuffle(s)
        b.feed(gates=g, signals=s)
    got = {(r.gate_id, r.outcome, r.decided_at) for r in b.rows() if r.run_id > 0}
    want = G.approval_gates(spark.createDataFrame(gates, GATES), spark.createDataFrame(signals, SIGNALS), mode="sticky")
    assert got == {(r.gate_id, r.outcome, r.decided_at) for r in want.collect()}
    assert len({r.batch_id for r in b.rows()}) > 1  # decided as the watermark went on, not all at the end


def test_late_gates_and_signals_leave_as_rows(spark):
    b = gate_batches(spark)
    b.feed(gates=[(1, 1, "a", T0), (2, 1, "b", T0 + 9000 * S)], signals=[(1, 1, T0 + 20 * S, "approve")])
    b.feed(gates=[(3, 1, "late", T0 + 10 * S)], signals=[(2, 1, T0 + 5 * S, "reject"), (3, 1, T0 + 9010 * S, "approve")])
    b.feed(gates=[], signals=[(-1, -1, FAR, "approve")])
    got = sorted((r.gate_id or 0, r.outcome, r.signal_id or 0) for r in b.rows() if r.run_id > 0)
    assert got == [(0, "late", 2), (1, "approved", 0), (2, "approved", 0), (3, "late", 0)]


def test_timeout_fires_at_the_gate_s_own_deadline(spark):
    """A gate times out as soon as the watermark passes its deadline, though nothing more comes for its run."""
    b = gate_batches(spark, "10 seconds")
    b.feed(gates=[(1, 1, "a", T0), (2, 1, "b", T0 + 5 * S)], signals=[(1, 2, T0 + 3000 * S, "approve")])
    assert [r for r in b.rows()] == []
    b.feed(gates=[], signals=[(2, 2, T0 + 3700 * S, "approve")])
    assert sorted((r.gate_id, r.outcome, r.decided_at) for r in b.rows()) == [
        (1, "timeout", T0 + 3600 * S), (2, "not_reached", None)]


def test_gates_without_input(spark):
    b = gate_batches(spark)
    b.feed(gates=[], signals=[])
    assert b.rows() == []


METRICS = "run_id long, tokens_used long, cost decimal(18,9), ts timestamp_ntz"


def metric(run, tokens, cost, at):
    return (run, tokens, Decimal(cost), T0 + S * at)


def test_alerts_once_and_state_goes(spark):
    b = Batches(spark, {"m": METRICS}, lambda s: K.alert_stream(SS.to_event_time(s["m"]), 100, "1.00", "10 seconds", 3600))
    b.feed(m=[metric(1, 60, "0.5", 0), metric(2, 10, "0.1", 1), metric(3, 1, "0", 2)])
    b.feed(m=[metric(1, 60, "0.6", 10), metric(2, 95, "0.1", 11)])
    b.feed(m=[metric(1, 60, "0.6", 20), metric(2, 95, "2", 21)])
    got = sorted((r.run_id, r.alert, r.total, r.at) for r in b.rows())
    assert got == [(1, "budget", "1.100000000", T0 + 10 * S), (1, "cooldown", "120", T0 + 10 * S),
                   (2, "budget", "2.200000000", T0 + 21 * S), (2, "cooldown", "105", T0 + 11 * S)]
    held = b.states[-1]
    b.feed(m=[metric(9, 1, "0", 90_000)])  # every other run has been idle for its keep time
    b.feed(m=[metric(9, 1, "0", 90_001)])
    assert b.states[-1] < held
    b.feed(m=[metric(1, 200, "0", 90_002)])  # a cleared run starts anew
    assert len(b.rows()) == 5


def test_null_amounts_and_times_count_as_nothing(spark):
    b = Batches(spark, {"m": METRICS}, lambda s: K.alert_stream(SS.to_event_time(s["m"]), 100, "1.00"))
    b.feed(m=[(1, None, None, None), (1, 101, None, T0)])
    assert [(r.run_id, r.alert, r.total) for r in b.rows()] == [(1, "cooldown", "101")]


SCHED = "activity_id long, run_id long, activity string, scheduled_at timestamp_ntz, limit_s int"
DONE = "activity_id long, completed_at timestamp_ntz"


def test_alert_at_each_activity_s_own_deadline(spark):
    """A short limit is alerted although another activity's limit is far longer."""
    b = Batches(spark, {"s": SCHED, "d": DONE}, lambda s: K.deadline_stream(
        SS.to_event_time(s["s"], "scheduled_at"), SS.to_event_time(s["d"], "completed_at"), "1 second"))
    b.feed(s=[(1, 1, "tests", T0, 60), (2, 1, "execute", T0, 7200), (3, 1, "tests", T0, 60), (4, 1, "tests", T0, 60)],
           d=[(3, T0 + 50 * S), (9, T0)])
    assert b.rows() == []
    b.feed(s=[(5, 2, "tests", T0 + 100 * S, 60)], d=[(4, T0 + 61 * S)])
    got = {r.activity_id: (r.alert_at, r.completed_at) for r in b.rows()}
    assert got == {1: (T0 + 60 * S, None), 4: (T0 + 60 * S, T0 + 61 * S)}
    b.feed(s=[(6, 2, "tests", T0, 30)], d=[(2, T0 + 100 * S)])  # a schedule behind its own deadline
    assert 6 in {r.activity_id for r in b.rows()} and 2 not in {r.activity_id for r in b.rows()}
    b.feed(s=[], d=[(-1, FAR)])
    assert {r.activity_id for r in b.rows()} == {1, 4, 5, 6}


def test_duplicates_across_batches_and_expiring_state(spark):
    schema = "id long, ts timestamp_ntz"
    b = Batches(spark, {"m": schema}, lambda s: SS.dedupe_stream(SS.to_event_time(s["m"]), "10 seconds"))
    first = [(i, T0 + S * i) for i in range(50)]
    b.feed(m=first + first[:10])
    b.feed(m=first[45:] + [(100, T0 + 55 * S)])
    assert sorted(r.id for r in b.rows()) == [*range(50), 100]
    full = max(b.states)
    b.feed(m=[(101, T0 + 5000 * S)])
    b.feed(m=[(3, T0 + 3 * S), (7, T0 - S), (102, T0 + 5001 * S)])  # behind the watermark: a copy and a new row
    assert b.states[-1] < full
    emitted = SS.table(spark, b.out, b.schema).drop("batch_id")
    landed = spark.read.parquet(b.src["m"])
    assert [r.id for r in SS.late_rows(landed, emitted).collect()] == [7]


def test_run_state_writes_changed_runs_only(spark):
    schema = "run_id long, seq long, stage string, tokens_used long, cost decimal(18,9), tests_pass boolean"
    b = Batches(spark, {"m": schema}, lambda s: SS.live_run_state(s["m"]), "update")
    b.feed(m=[(i, 1, "a", 10, Decimal("0.1"), True) for i in range(20)])
    b.feed(m=[(3, 2, "b", 5, Decimal("0.1"), False)])
    versions = SS.table(spark, b.out, b.schema)
    assert sorted(r["count"] for r in versions.groupBy("batch_id").count().collect()) == [1, 20]
    now = {r.run_id: (r.current_stage, r.total_tokens_used, r.stages_completed) for r in SS.latest(versions, "run_id").collect()}
    assert len(now) == 20 and now[3] == ("b", 15, 2) and now[4] == ("a", 10, 1)
    folded = scratch_path(spark, "folded")
    SS.compact(spark, b.out, b.schema, "run_id", max(r.batch_id for r in versions.collect()), folded)
    assert {r.run_id: (r.current_stage, r.total_tokens_used, r.stages_completed)
            for r in SS.table(spark, folded, b.schema).collect()} == now


def test_closed_windows_and_what_they_lack(spark):
    schema = "stage string, tokens_used long, cost decimal(18,9), duration_ms long, tests_pass boolean, ts timestamp_ntz"
    h = timedelta(hours=1)

    def row(at, tokens=1):
        return ("a", tokens, Decimal("0.1"), 1000, True, at)

    b = Batches(spark, {"m": schema}, lambda s: SS.windowed_dashboard(SS.to_event_time(s["m"]), "1 hour", "2 hours"))
    b.feed(m=[row(T0 + i * h) for i in range(6)])
    assert {r.window_start for r in b.rows()} == {T0, T0 + h, T0 + 2 * h}  # the open ones wait
    b.feed(m=[row(T0, 7), row(T0 + 3 * h), row(T0 - h, 9), row(T0 + 9 * h)])
    closed = SS.table(spark, b.out, b.schema)
    assert len({(r.window_start, r.stage) for r in closed.collect()}) == closed.count()  # each window once
    landed = spark.read.parquet(b.src["m"])
    got = {r.window_start: (r.records, r.late_records, r.late_tokens) for r in SS.window_corrections(landed, closed)
           .filter(F.col("window_end") <= F.lit(T0 + 7 * h).cast("timestamp_ntz")).collect()}
    assert got[T0] == (1, 1, 7) and got[T0 + 3 * h] == (2, 0, 0) and got[T0 - h] == (None, 1, 9)


@pytest.mark.parametrize("path_there", [False, True])
def test_table_without_batches_is_empty(spark, tmp_path, path_there):
    path = tmp_path / "none"
    if path_there:
        path.mkdir()
    schema = spark.createDataFrame([], "a long").schema
    assert SS.table(spark, str(path), schema).collect() == []
