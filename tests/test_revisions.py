"""Batches of edge revisions against a replay of one step after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spindrift.operators import revisions as rv

VERSION = "edge string, src long, dst long, valid_from long, valid_to long, weight double, recorded_at long, recorded_to long"
STEP = VERSION + ", step long, kind string, reopen boolean, extra int"


def random_steps(seed: int, n: int):
    rng = random.Random(seed)
    some = lambda f, p=0.6: f() if rng.random() < p else None
    kinds = ["create", "create", "revise", "revise", "revise", "close", "retract", "bogus", None]
    return [(some(lambda: f"e{min(rng.randint(0, 9), 5)}", 0.97), rng.randint(1, 3), 7, some(lambda: rng.randint(0, 50), 0.4), some(lambda: rng.randint(0, 99), 0.4), some(lambda: rng.randint(1, 9) / 8), some(lambda: rng.randint(0, 60), 0.97), some(lambda: rng.randint(0, 90), 0.1), some(lambda: i, 0.9), rng.choice(kinds), some(lambda: rng.random() < 0.3), 1) for i in range(n)]


def replay(versions, steps):
    """Each step on the whole list of versions."""
    versions, out = [list(v) for v in versions], []
    first = lambda x: (x is not None, x)
    for e, src, dst, vf, vt, w, at, rt, step, kind, reopen, _ in sorted((s for s in steps if s[0] is not None), key=lambda s: (first(s[6]), -1 if s[8] is None else s[8], s[9] or "")):
        live = sorted((v for v in versions if v[0] == e and v[7] is None), key=lambda v: (v[6], v[3], v[5]))
        cur = live[-1] if live else None
        if kind not in rv.KINDS or at is None:
            result = "unknown"
        elif kind == "create":
            result = "open" if cur else "applied"
            new = [e, src, dst, at if vf is None else vf, vt, 1.0 if w is None else w, at, rt]
        elif not cur:
            result = "missing"
        elif kind == "retract":
            result = "applied" if at > cur[6] else "late"
            new = None
        else:
            result, at = "applied", max(at, cur[6] + 1)
            revise = kind == "revise"
            end = None if revise and reopen else cur[4] if vt is None else vt
            new = [e, cur[1], cur[2], vf if revise and vf is not None else cur[3], end, w if revise and w is not None else cur[5], at, rt if revise else None]
        if result == "applied":
            if new and (new[4] is not None and new[4] <= new[3] or new[7] is not None and new[7] <= new[6]):
                result = "interval"
            else:
                if cur:
                    cur[7] = at
                versions += [new] if new else []
        out.append((e, -1 if step is None else step, kind or "", result))
    out += [(None, -1 if s[8] is None else s[8], s[9] or "", "unknown") for s in steps if s[0] is None]
    return [tuple(v) for v in versions], out


BEFORE = [("e0", 1, 2, 5, None, 0.5, 10, None), ("e0", 1, 2, 5, None, 0.25, 2, 10), ("e1", 3, 2, 0, 40, 0.5, 30, None), ("idle", 1, 1, 0, None, 1.0, 0, None), ("e2", 1, 1, 0, None, 1.0, 0, 5), (None, 1, 1, 0, None, 1.0, 0, None)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_equals_a_replay(spark):
    before = spark.createDataFrame(BEFORE, VERSION).repartition(2)
    for seed in range(4):
        steps = random_steps(seed, 160)
        batch = spark.createDataFrame(steps, STEP).repartition(5)
        want, outcomes = replay(BEFORE, steps)
        after = rv.revise(before, batch)
        assert rows(after) == sorted(want, key=str)
        assert rows(rv.outcomes(before, batch)) == sorted(outcomes, key=str)
        assert {o for *_, o in outcomes} >= {"applied", "open", "missing", "interval", "late", "unknown"}
        for valid, known in ((0, 20), (30, 40), (60, 70), (10, 95)):
            seen = [v for v in want if v[3] <= valid and (v[4] is None or v[4] > valid) and v[6] <= known and (v[7] is None or v[7] > known)]
            assert rows(after.filter(rv.as_of(F.lit(valid), F.lit(known)))) == sorted(seen, key=str)


def test_a_batch_in_two_parts_equals_the_whole(spark):
    steps = sorted((s for s in random_steps(9, 120) if s[6] is not None), key=lambda s: s[6])
    before, batch = spark.createDataFrame(BEFORE, VERSION), lambda part: spark.createDataFrame(part, STEP)
    cut = next(i for i in range(60, 120) if steps[i][6] != steps[i - 1][6])
    assert rows(rv.revise(rv.revise(before, batch(steps[:cut])), batch(steps[cut:]))) == rows(rv.revise(before, batch(steps)))


def test_nothing_to_revise(spark):
    before, none = spark.createDataFrame(BEFORE, VERSION), spark.createDataFrame([], STEP)
    assert rows(rv.revise(before, none)) == sorted(BEFORE, key=str) and rv.outcomes(before, none).isEmpty()
    assert rv.revise(before.limit(0), none).isEmpty()


def test_of_several_open_versions_the_latest_counts(spark):
    double = [("e", 1, 2, 0, None, 0.5, 1, None), ("e", 1, 2, 0, None, 0.75, 4, None)]
    step = [("e", None, None, None, 9, None, 6, None, 1, "close", None, 1)]
    assert rows(rv.revise(spark.createDataFrame(double, VERSION), spark.createDataFrame(step, STEP))) == sorted(replay(double, step)[0], key=str)
