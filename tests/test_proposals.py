"""Merge proposals against a replay of the log, one step after another."""

from __future__ import annotations

import random

from spindrift.operators import proposals

LOG = "proposal string, at long, seq long, action string, extra int"


def replay(log):
    first = lambda x: (x is not None, x or 0)
    state, holds, holder, out = {}, {}, {}, {}
    for p, at, seq, action, _ in sorted(set(log), key=lambda r: (first(r[1]), first(r[2]), r[3] or "")):
        s = state.get(p)
        if p is None or action not in proposals.ACTIONS:
            result = "unknown"
        elif s is None:
            result = "applied" if action == "propose" else "missing"
        elif action == "propose":
            result = "open"
        elif action == "reverse":
            result = {"approved": "applied", "reversed": "reversed"}.get(s, "not approved")
        else:
            result = "applied" if s == "pending" else "decided"
        if result == "applied":
            state[p] = {"propose": "pending", "approve": "approved", "reject": "rejected", "reverse": "reversed"}[action]
            for i in SOURCES.get(p, ()):
                if action == "approve":
                    holder[i] = p
                elif action == "reverse" and holder.get(i) == p:
                    del holder[i]
        out[p, at, seq, action] = result
    return state, out, holder


SOURCES = {f"p{k}": [k, k + 1, (k * 3) % 7] for k in range(8)}


def test_the_log_equals_a_replay(spark):
    rng = random.Random(2)
    some = lambda x, p=0.95: x if rng.random() < p else None
    log = [(some(f"p{rng.randrange(8)}"), some(rng.randrange(40)), some(i), rng.choice([*proposals.ACTIONS, "approve", "bogus", None]), 1) for i in range(260)]
    log += [log[5], log[5], ("p9", 1, 1, "approve", 1)]
    table = spark.createDataFrame(log, LOG).repartition(4)
    state, out, holder = replay(log)
    assert {r.proposal: r.state for r in proposals.states(table).collect()} == state and set(state.values()) >= {"approved", "reversed"}
    got = proposals.outcomes(table).collect()
    assert len(got) == len(out) and {(r.proposal, r.at, r.seq, r.action): r.outcome for r in got} == out
    sources = spark.createDataFrame([(p, i) for p, ids in SOURCES.items() for i in ids] + [("p1", None), (None, 3), ("p1", 1)], "proposal string, id long")
    assert {r.id: r.proposal for r in proposals.merged_into(table, sources).collect()} == holder


def test_reverse_after_approve_restores_every_source(spark):
    steps = [("a", 1, 1, "propose", 0), ("a", 2, 2, "approve", 0), ("b", 3, 3, "propose", 0), ("b", 4, 4, "approve", 0)]
    sources = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "proposal string, id long")
    merged = lambda log: {r.id: r.proposal for r in proposals.merged_into(spark.createDataFrame(log, LOG), sources).collect()}
    assert merged(steps) == {1: "a", 2: "b", 3: "b"}
    assert merged([*steps, ("a", 5, 5, "reverse", 0)]) == {2: "b", 3: "b"}
    assert merged([*steps, ("a", 5, 5, "reverse", 0), ("b", 6, 6, "reverse", 0)]) == {} == merged([])
