"""The consolidation job and its reverse against plain loops, and tables of numbered states."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import consolidation
from spindrift.sources import generations

SCHEMA = "id string, content string, kind string, vector array<double>, cluster string, importance long, created_s long, n long, consolidated_into string, consolidated_s long, consolidated_n long"
AT = 1_700_000_000


def record_rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=6)
    shapes = {"tight": [np.array([1.0, 0, 0, 0, 0, x]) for x in np.linspace(0, 0.2, 9)], "near": [centre + rng.normal(size=6) * 0.6 for _ in range(9)], "far": list(rng.normal(size=(11, 6))), "same": [centre] * 4, "few": [centre] * 2}
    rows = [(f"{g}{i}", f"{g} text {i}", "fact", v.tolist(), g, 5, 0, i, None, None, None) for g, vs in shapes.items() for i, v in enumerate(vs)]
    rows += [("young", "t", "fact", centre.tolist(), "far", 5, AT, 1, None, None, None), ("vital", "t", "fact", centre.tolist(), "far", 90, 0, 1, None, None, None), ("bare", None, "fact", None, "far", 5, 0, 1, None, None, None)]
    return [*rows, ("odd", None, None, centre.tolist(), None, None, None, None, None, None, None), (None, "no id", "fact", centre.tolist(), "far", 5, 0, 1, None, None, None)]


def plain_plan(rows, theta):
    out = {}
    for g in {r[4] for r in rows if r[4]}:
        own = sorted((r[0], np.array(r[3]) / np.linalg.norm(r[3])) for r in rows if r[4] == g and r[0] and r[3] and r[5] <= 30 and r[6] < AT)
        n = len(own)
        if n < 3:
            continue
        v = np.array([x for _, x in own])
        far = np.array([1 - np.mean([v[i] @ v[j] for j in range(n) if j != i]) for i in range(n)])
        values = np.maximum(np.linalg.eigvalsh(np.cov(v.T, bias=True)), 0)
        total = values.sum()
        d = max(1, total**2 / (values**2).sum()) if total > 1e-12 else 1
        limit = theta * 2 ** (1 / d)
        if far.mean() > 1.25 * limit:
            order = sorted(range(n), key=lambda i: (-np.floor(far[i] * 1e6 + 0.5), own[i][0]))
            out[g] = "prune", {own[i][0] for i in order[max(2, -(-n // 2)) :]}
        else:
            tight = far.mean() < 0.75 * limit and (total <= 1e-12 or values[-1] / total > 0.55 or far.mean() <= 0)
            out[g] = "centroid" if tight else "medoid", {k for k, _ in own}
    return out


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(record_rows(), SCHEMA).repartition(3)


def job(records, theta=consolidation.THETA):
    due = consolidation.due(records, F.col("importance"), F.col("created_s"), AT).select("id", "cluster", "content", "vector")
    return consolidation.consolidate(records, due, AT, theta)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_job_equals_a_plain_loop(records):
    want = plain_plan(record_rows(), consolidation.THETA)
    assert {s for s, _ in want.values()} == {"centroid", "medoid", "prune"}
    after = {r.id: r for r in job(records).collect()}
    made = {r.id: r for r in after.values() if r.consolidated_n is not None}
    groups = {}
    for r in after.values():
        if r.consolidated_into:
            groups.setdefault(r.consolidated_into, set()).add(r.id)
            assert r.consolidated_s == AT
    assert sorted(map(sorted, groups.values())) == sorted(sorted(ids) for _, ids in want.values())
    by = {frozenset(ids): s for s, ids in want.values()}
    for into, ids in groups.items():
        head = consolidation.HEADS[by[frozenset(ids)]]
        assert made[into].consolidated_n == len(ids) and made[into].content.startswith(head) and made[into].kind == "context" and made[into].n is None
        assert by[frozenset(ids)] == "prune" or made[into].content.removeprefix(head) in {after[i].content for i in ids}
    assert len(made) == len(groups) and len(after) == len({r[0] for r in record_rows()}) + len(made)


def test_job_again_changes_nothing_and_reverse_gives_the_first_table(records, spark):
    once = spark.createDataFrame(job(records).collect(), records.schema)
    assert table(job(once)) == table(once)
    made = once.filter("consolidated_n IS NOT NULL").select("id")
    assert table(consolidation.reverse(once, made)) == table(records)
    one = made.limit(1).collect()[0].id
    part = consolidation.reverse(once, spark.createDataFrame([(one,), (one,), ("unknown",), ("young",), (None,)], "id string"))
    assert {r.consolidated_into for r in part.collect()} == {r.consolidated_into for r in once.collect()} - {one} and part.filter(F.col("id") == one).isEmpty()
    assert part.count() == once.count() - 1
    outer = once.withColumn("consolidated_into", F.when(F.col("id") == one, "outer").otherwise(F.col("consolidated_into")))
    assert table(consolidation.reverse(outer, spark.createDataFrame([(one,)], "id string"))) == table(outer)


def test_job_on_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert job(none).isEmpty() and consolidation.reverse(none, none.select("id")).isEmpty()


def test_safety(spark):
    shapes = spark.createDataFrame([(1.0, 0.2), (1.0, 0.23), (4.0, 0.13), (0.0, 0.0)], "dimension double, spread double")
    got = [(r.safe, r.representatives) for r in consolidation.safety(shapes).collect()]
    assert got == [(True, 2), (False, 2), (True, 8), (True, 1)]


def test_states_of_a_table(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert generations.current(spark, folder) is None
    rows = spark.range(5)
    assert generations.publish(rows, folder) == 1
    (tmp_path / "store" / "state-00000002").mkdir()
    (tmp_path / "store" / "state-00000002" / "part-lost.parquet").write_bytes(b"half a file")  # a job that was lost
    assert generations.current(spark, folder).count() == 5
    assert generations.publish(generations.current(spark, folder).filter("id > 1"), folder) == 2
    assert generations.current(spark, folder).count() == 3
    generations.drop_before(spark, folder, 9)
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["state-00000002"] and generations.current(spark, folder).count() == 3
