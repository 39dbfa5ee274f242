"""Keyed streams: state by buckets of keys, not by key, and keys that are null."""

from datetime import datetime, timedelta
from decimal import Decimal

from flowmetrics.session import scratch_path
from flowmetrics.streaming import keyed as K
from flowmetrics.streaming import streams as SS

from test_keyed_streams import DONE, FAR, METRICS, S, SCHED, T0, Batches, gate_batches


def test_deadlines_kept_by_bucket(spark):
    """Thousands of waiting activities take a few entries a bucket; one without an id stands for itself."""
    b = Batches(spark, {"s": SCHED, "d": DONE}, lambda s: K.deadline_stream(
        SS.to_event_time(s["s"], "scheduled_at"), SS.to_event_time(s["d"], "completed_at"), "1 second"))
    n = 3000
    big = 2**60 + 1  # ids of more than 53 bits stay whole beside null ones
    b.feed(s=[(big + i, i, "tests", T0 + S * (i % 7), 60) for i in range(n)] + [(None, None, "tests", T0, 60)] * 2,
           d=[(big + i, T0 + 30 * S) for i in range(0, n, 3)])
    assert b.states[-1] < n
    b.feed(s=[], d=[(-1, FAR)])
    got = b.rows()
    assert sorted(r.activity_id for r in got if r.activity_id is not None) == [big + i for i in range(n) if i % 3]
    assert sum(r.activity_id is None and r.run_id is None for r in got) == 2
    assert all(r.alert_at == r.scheduled_at + timedelta(seconds=60) for r in got)


def test_alerts_kept_by_bucket(spark):
    b = Batches(spark, {"m": METRICS}, lambda s: K.alert_stream(SS.to_event_time(s["m"]), 100, "1.00"))
    n = 3000
    b.feed(m=[(i, 60, Decimal("0.6"), T0) for i in range(n)] + [(None, 60, Decimal("0.1"), T0)])
    assert b.rows() == [] and b.states[-1] < n
    b.feed(m=[(i, 60, Decimal("0.6"), T0 + S) for i in range(n)] + [(None, 60, Decimal("0.1"), T0 + S)])
    got = b.rows()
    assert len(got) == 2 * n + 1 and {(r.alert, r.total) for r in got} == {("cooldown", "120"), ("budget", "1.200000000")}
    assert [r.alert for r in got if r.run_id is None] == ["cooldown"]


def test_gates_kept_by_bucket(spark):
    b = gate_batches(spark)
    n = 3000
    b.feed(gates=[(i, i, "a", T0 + S * (i % 5)) for i in range(n)], signals=[(i, i, T0 + S * 10, "approve") for i in range(0, n, 2)])
    assert b.rows() == [] and b.states[-1] < n
    b.feed(gates=[(n, 1, "late", None)], signals=[(-1, -1, FAR, "approve")])
    got = {r.gate_id: r.outcome for r in b.rows() if r.run_id != -1}
    assert got == {**{i: "timeout" if i % 2 else "approved" for i in range(n)}, n: "late"}
