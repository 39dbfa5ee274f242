"""Approval gates (J4), batch.

``independent``: each gate is decided by the first signal of its run in
``[opened_at, opened_at + timeout]``; none -> ``timeout`` at the deadline.
An interval join in meaning; computed as a forward scan for the next signal
(no pairs).

``sticky`` (what a real run does): one nullable flag per run, set by every
signal (last wins), even before a gate opens; a gate opening while the flag
is set is decided at once; otherwise the first signal after opening decides,
or the run times out.  Only approval clears the flag; a rejection or timeout
ends the run, so later gates are ``not_reached``.

For gate k let ``cnt_k`` be the number of signals after gate k-1 up to and
including gate k's opening, ``last_k`` the latest of them, ``next_k`` the first
signal after gate k opened.  The flag is set at gate k exactly when
``cnt_k >= 2``, or ``cnt_k == 1`` and it was set at gate k-1 (or k is the first
gate); ``cnt_k == 0`` means it is not.  So "set at k" is the last decisive
(``cnt != 1``) gate's verdict, carried forward: a ``last non-null`` scan, no
per-run loop and no per-run Python.  All scans are the skew-safe ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import ms_between
from ..plans.scan import prefix_scan
from ..schemas import APPROVAL_TIMEOUT_S




def _finish(df: DataFrame) -> DataFrame:
    return df.select("gate_id", "run_id", "stage", "opened_at", "outcome", "decided_at",
                     ms_between("opened_at", "decided_at").alias("wait_ms"))


def approval_gates(gates: DataFrame, signals: DataFrame, timeout_s: int = APPROVAL_TIMEOUT_S,
                   mode: str = "sticky", timeout_outcome: str = "timeout") -> DataFrame:
    """``timeout_outcome``: the outcome of a gate without a signal inside its limit
    (the example dialect tells it from a rejection by nothing: ``rejected``)."""
    if mode not in ("independent", "sticky"):
        raise ValueError("mode must be 'independent' or 'sticky'")
    out = (_independent if mode == "independent" else _sticky)(gates, signals, timeout_s)
    if timeout_outcome == "timeout":
        return out
    outcome = F.when(F.col("outcome") == "timeout", F.lit(timeout_outcome)).otherwise(F.col("outcome"))
    return out.withColumn("outcome", outcome)


def _independent(gates: DataFrame, signals: DataFrame, timeout_s: int) -> DataFrame:
    """First signal at or after each gate's opening, decided if within the
    limit.  A forward ``first`` scan over gates and signals of the run (a
    gate sorts before a signal of the same instant), so no gate/signal pairs
    are formed at all, however dense a run is."""
    g = gates.select("run_id", F.col("opened_at").alias("t"), F.lit(0).alias("kind"),
                     F.col("gate_id").alias("id"), "stage", F.lit(None).cast("string").alias("signal"))
    s = signals.select("run_id", F.col("ts").alias("t"), F.lit(1).alias("kind"),
                       F.col("signal_id").alias("id"), F.lit(None).cast("string").alias("stage"),
                       "signal")
    sig = F.when(F.col("kind") == 1, F.struct(F.col("t").alias("t"), F.col("signal").alias("signal")))
    sc = prefix_scan(g.unionByName(s), ["run_id"], ["t", "kind", "id"],
                     [("d", "first", sig, "after")])
    deadline = F.timestamp_add("SECOND", F.lit(timeout_s), F.col("t"))
    hit = F.col("d").isNotNull() & (F.col("d.t") <= deadline)
    out = sc.filter(F.col("kind") == 0).select(
        F.col("id").alias("gate_id"), "run_id", "stage", F.col("t").alias("opened_at"),
        F.when(~hit, "timeout").when(F.col("d.signal") == "approve", "approved")
         .otherwise("rejected").alias("outcome"),
        F.when(hit, F.col("d.t")).otherwise(deadline).alias("decided_at"))
    return _finish(out)


def _sticky(gates: DataFrame, signals: DataFrame, timeout_s: int) -> DataFrame:
    g = gates.select("run_id", F.col("opened_at").alias("t"), F.lit(1).alias("kind"),
                     F.col("gate_id").alias("id"), "stage", F.lit(None).cast("string").alias("signal"))
    s = signals.select("run_id", F.col("ts").alias("t"), F.lit(0).alias("kind"),
                       F.col("signal_id").alias("id"), F.lit(None).cast("string").alias("stage"),
                       "signal")
    # signals sort before a gate opening at the same instant: they set the flag
    u = g.unionByName(s)
    order = ["t", "kind", "id"]
    numbered = prefix_scan(u, ["run_id"], order,
                           [("gate_no", "count", F.when(F.col("kind") == 1, F.lit(1)))])
    numbered = numbered.withColumn("gate_no", F.coalesce("gate_no", F.lit(0)).cast("bigint"))

    sig_struct = F.struct(F.col("t").alias("t"), F.col("id").alias("id"),
                          F.col("signal").alias("signal"))
    seg = (numbered.filter(F.col("kind") == 0).groupBy("run_id", "gate_no").agg(
        F.count(F.lit(1)).alias("cnt"), F.max(sig_struct).alias("last"),
        F.min(sig_struct).alias("first")))
    gk = numbered.filter(F.col("kind") == 1).select(
        "run_id", F.col("id").alias("gate_id"), "stage", F.col("t").alias("opened_at"), "gate_no")
    before = seg.select("run_id", (F.col("gate_no") + 1).alias("gate_no"), "cnt", "last")
    after = seg.select("run_id", "gate_no", F.col("first").alias("first_in_seg"))
    gk = gk.join(before, ["run_id", "gate_no"], "left").join(after, ["run_id", "gate_no"], "left")
    gk = gk.withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    decisive = F.when(F.col("cnt") >= 2, F.lit(True)).when(F.col("cnt") == 0, F.lit(False))
    gorder = ["gate_no"]
    # verdict carried forward and next signal looked ahead: one scan, two frames
    sc = prefix_scan(gk, ["run_id"], gorder,
                     [("set_mode", "last", decisive, "upto"),
                      ("next_sig", "first", F.col("first_in_seg"), "from")])
    flag_set = F.coalesce(F.col("set_mode"), F.lit(True))
    deadline = F.timestamp_add("SECOND", F.lit(timeout_s), F.col("opened_at"))
    waited_ok = F.col("next_sig").isNotNull() & (F.col("next_sig.t") <= deadline)
    decided_sig = F.when(flag_set, F.col("last.signal")).when(waited_ok, F.col("next_sig.signal"))
    outcome = (F.when(decided_sig.isNull(), "timeout")
               .when(decided_sig == "approve", "approved").otherwise("rejected"))
    decided_at = (F.when(flag_set, F.col("opened_at")).when(waited_ok, F.col("next_sig.t"))
                  .otherwise(deadline))
    dec = sc.select("run_id", "gate_id", "stage", "opened_at", "gate_no",
                    outcome.alias("outcome"), decided_at.alias("decided_at"))
    # a gate after the run's first failing gate is not reached: the first
    # failure per run is one partial aggregation (one row per run), joined back
    first_fail = dec.filter(F.col("outcome") != "approved").groupBy("run_id") \
        .agg(F.min("gate_no").alias("first_fail"))
    cut = dec.join(first_fail, "run_id", "left")
    reached = F.col("first_fail").isNull() | (F.col("gate_no") <= F.col("first_fail"))
    out = cut.select(
        "gate_id", "run_id", "stage", "opened_at",
        F.when(reached, F.col("outcome")).otherwise("not_reached").alias("outcome"),
        F.when(reached, F.col("decided_at")).alias("decided_at"))
    return _finish(out)
