"""Approval gates against brute force: a plain Python walk over each run's
events (the flag semantics written directly) on hundreds of random small
runs, with coarse times so that gates and signals often coincide."""

import random
from datetime import datetime, timedelta

from flowmetrics.operators import gates as G

T0 = datetime(2024, 3, 1)
LIMIT = 3600


def _random_runs(n_runs=300, seed=17):
    rnd = random.Random(seed)
    gates, signals, gid, sid = [], [], 0, 0
    for run in range(n_runs):
        for _ in range(rnd.randint(0, 4)):
            gid += 1
            gates.append((gid, run, f"s{gid}", T0 + timedelta(seconds=rnd.randrange(0, 4 * 3600, 600))))
        for _ in range(rnd.randint(0, 6)):
            sid += 1
            signals.append((sid, run, T0 + timedelta(seconds=rnd.randrange(0, 5 * 3600, 600)),
                            rnd.choice(["approve", "approve", "reject"])))
    return gates, signals


def _sticky_reference(gates, signals):
    """Events in (time, signal-before-gate, id) order; the flag is the last
    signal since the previous decision; a gate opening with the flag set is
    decided at once, otherwise by the first signal after it (it may be the
    same signal that decided an earlier gate still counted as open), or it
    times out; a rejection or timeout ends the run."""
    out = {}
    by_run = {}
    for g in gates:
        by_run.setdefault(g[1], ([], []))[0].append(g)
    for s in signals:
        by_run.setdefault(s[1], ([], []))[1].append(s)
    lim = timedelta(seconds=LIMIT)
    for run, (gs, ss) in by_run.items():
        gs = sorted(gs, key=lambda g: (g[3], g[0]))
        ss = sorted(ss, key=lambda s: (s[2], s[0]))
        failed = False
        last_decision = None        # (time, signal id) of the previous gate's decision
        for g in gs:
            gid, _, _, opened = g
            if failed:
                out[gid] = ("not_reached", None)
                continue
            # signals after the previous decision, up to and including the opening
            after_prev = [s for s in ss if last_decision is None or (s[2], s[0]) > last_decision]
            pending = [s for s in after_prev if s[2] <= opened]
            if pending:
                s = pending[-1]
                outcome, at = ("approved" if s[3] == "approve" else "rejected"), opened
                # the flag is cleared at the opening: later signals start anew
                last_decision = (opened, max(p[0] for p in pending))
            else:
                nxt = [s for s in ss if s[2] > opened]
                if nxt and nxt[0][2] <= opened + lim:
                    s = nxt[0]
                    outcome, at = ("approved" if s[3] == "approve" else "rejected"), s[2]
                    last_decision = (s[2], s[0])
                else:
                    outcome, at = "timeout", opened + lim
            out[gid] = (outcome, at)
            if outcome != "approved":
                failed = True
    return out


def _independent_reference(gates, signals):
    out = {}
    lim = timedelta(seconds=LIMIT)
    for gid, run, _, opened in gates:
        c = sorted((s for s in signals if s[1] == run and opened <= s[2] <= opened + lim),
                   key=lambda s: (s[2], s[0]))
        if c:
            out[gid] = ("approved" if c[0][3] == "approve" else "rejected", c[0][2])
        else:
            out[gid] = ("timeout", opened + lim)
    return out


def test_gates_against_brute_force(spark):
    gates, signals = _random_runs()
    g = spark.createDataFrame(gates, "gate_id long, run_id long, stage string, opened_at timestamp_ntz")
    s = spark.createDataFrame(signals, "signal_id long, run_id long, ts timestamp_ntz, signal string")
    for mode, ref in (("sticky", _sticky_reference), ("independent", _independent_reference)):
        got = {r.gate_id: (r.outcome, r.decided_at)
               for r in G.approval_gates(g, s, LIMIT, mode=mode).collect()}
        exp = ref(gates, signals)
        assert len(got) == len(gates)
        bad = {k: (got[k], exp[k]) for k in exp if got[k] != exp[k]}
        assert not bad, (mode, list(bad.items())[:5])
