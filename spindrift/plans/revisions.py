"""Queries over revisions: a customer and its nation are an edge, every order is a step of its customer's edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import revisions
from spindrift.plans.registry import query, table

DAY = 86400000
T0 = 852076800000  # 1997-01-01
#: Fields of a step by the number of its order; times are in milliseconds, half of them in whole years so that many are equal.
STEPS = {
    "kind": "CASE o_orderkey % 9 WHEN 0 THEN 'create' WHEN 1 THEN 'create' WHEN 2 THEN 'close' WHEN 3 THEN 'retract' ELSE 'revise' END",
    "valid_from": f"CASE WHEN o_orderkey % 4 = 1 THEN {T0} + (o_orderkey % 700) * {DAY} END",
    "valid_to": f"CASE WHEN o_orderkey % 9 = 2 OR o_orderkey % 5 = 2 THEN {T0} + (o_orderkey % 1500) * {DAY} END",
    "weight": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "recorded_to": f"CASE WHEN o_orderkey % 31 = 4 THEN {T0 + 3000 * DAY} END",
    "reopen": "o_orderkey % 11 = 5",
}
_AT = {"spark": "CAST(datediff(o_orderdate, DATE'1970-01-01') AS BIGINT) * 86400000", "sql": "CAST(datediff('day', DATE '1970-01-01', o_orderdate) AS BIGINT) * 86400000"}
RECORDED = "CASE WHEN o_orderkey % 2 = 0 THEN {at} ELSE {at} - ({at}) % 31536000000 END"

#: z (edge, dst, versions, o, step, kind, outcome): the replay of one step after another.
REPLAY = f"""s AS (SELECT o_custkey AS edge, c_nationkey AS dst, o_orderkey AS step, {", ".join(f"{v} AS {k}" for k, v in STEPS.items())}, {RECORDED.format(at=_AT["sql"])} AS ra FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY ra, step, kind) AS i FROM s),
    r AS (SELECT c_custkey AS edge, 0::BIGINT AS i, NULL::BIGINT AS step, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, CASE WHEN c_custkey % 2 = 0 THEN {T0}::BIGINT END AS vf, NULL::BIGINT AS vt,
            CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE END AS w, CASE WHEN c_custkey % 2 = 0 THEN {T0}::BIGINT END AS ra, NULL::STRUCT(vf BIGINT, vt BIGINT, w DOUBLE, ra BIGINT, rt BIGINT)[] AS done FROM customer
        UNION ALL
        SELECT edge, i, step, kind, outcome, CASE WHEN outcome <> 'applied' THEN vf WHEN kind = 'retract' OR nrt IS NOT NULL THEN NULL ELSE nvf END,
            CASE WHEN outcome <> 'applied' THEN vt WHEN kind = 'retract' OR nrt IS NOT NULL THEN NULL ELSE nvt END, CASE WHEN outcome <> 'applied' THEN w WHEN kind = 'retract' OR nrt IS NOT NULL THEN NULL ELSE nw END,
            CASE WHEN outcome <> 'applied' THEN ra WHEN kind = 'retract' OR nrt IS NOT NULL THEN NULL ELSE nra END,
            CASE WHEN outcome = 'applied' THEN list_concat(CASE WHEN ra IS NOT NULL THEN [{{{{'vf': vf, 'vt': vt, 'w': w, 'ra': ra, 'rt': nra}}}}] END,
                CASE WHEN kind <> 'retract' AND nrt IS NOT NULL THEN [{{{{'vf': nvf, 'vt': nvt, 'w': nw, 'ra': nra, 'rt': nrt}}}}] END) END
        FROM (SELECT *, CASE WHEN kind = 'create' AND ra IS NOT NULL THEN 'open' WHEN kind <> 'create' AND ra IS NULL THEN 'missing' WHEN kind = 'retract' THEN CASE WHEN sra <= ra THEN 'late' ELSE 'applied' END
                WHEN coalesce(nvt <= nvf, false) OR coalesce(nrt <= nra, false) THEN 'interval' ELSE 'applied' END AS outcome
            FROM (SELECT r.edge, n.i, n.step, n.kind, r.vf, r.vt, r.w, r.ra, n.ra AS sra, CASE WHEN n.kind IN ('create', 'retract') THEN n.ra ELSE greatest(n.ra, r.ra + 1) END AS nra,
                CASE n.kind WHEN 'create' THEN coalesce(valid_from, n.ra) WHEN 'revise' THEN coalesce(valid_from, r.vf) ELSE r.vf END AS nvf,
                CASE WHEN n.kind = 'create' THEN valid_to WHEN n.kind = 'revise' AND reopen THEN NULL ELSE coalesce(valid_to, r.vt) END AS nvt,
                CASE n.kind WHEN 'create' THEN coalesce(weight, 1) WHEN 'revise' THEN coalesce(weight, r.w) ELSE r.w END AS nw, CASE WHEN n.kind IN ('create', 'revise') THEN recorded_to END AS nrt
                FROM r JOIN n ON n.edge = r.edge AND n.i = r.i + 1))),
    v AS (SELECT edge, d.vf AS valid_from, d.vt AS valid_to, d.w AS weight, d.ra AS recorded_at, d.rt AS recorded_to FROM (SELECT edge, unnest(done) AS d FROM r WHERE done IS NOT NULL)
        UNION ALL SELECT edge, vf, vt, w, ra, NULL FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY edge ORDER BY i DESC) = 1) WHERE ra IS NOT NULL)""".replace("{{", "{").replace("}}", "}")


def _tables(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    none = lambda t: F.lit(None).cast(t)
    first = customers.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("edge"), F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"), F.lit(T0).cast("long").alias("valid_from"), none("long").alias("valid_to"),
        F.lit(0.5).alias("weight"), F.lit(T0).cast("long").alias("recorded_at"), none("long").alias("recorded_to"),
    )
    steps = table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    steps = steps.selectExpr("o_custkey AS edge", "o_custkey AS src", "CAST(c_nationkey AS BIGINT) AS dst", "o_orderkey AS step", *(f"{v} AS {k}" for k, v in STEPS.items()), f"{RECORDED.format(at=_AT['spark'])} AS recorded_at")
    return first, steps


@query(f"WITH RECURSIVE {REPLAY} SELECT edge, c_nationkey::BIGINT AS dst, valid_from, valid_to, weight, recorded_at, recorded_to FROM v JOIN customer ON c_custkey = edge")
def edge_revisions(spark, sf_dir):
    """All versions of every edge after the batch."""
    return revisions.revise(*_tables(spark, sf_dir)).drop("src")


@query(f"WITH RECURSIVE {REPLAY} SELECT edge, step, kind, outcome FROM r WHERE i > 0")
def edge_revision_outcomes(spark, sf_dir):
    """What became of every step."""
    return revisions.outcomes(*_tables(spark, sf_dir))


TIMES = [(T0 + a * DAY, T0 + b * DAY) for a in (0, 300, 900) for b in (100, 500, 1200)]


@query(f"""WITH RECURSIVE {REPLAY}, t(valid_at, known_at) AS (VALUES {", ".join(f"({a}, {b})" for a, b in TIMES)})
    SELECT valid_at, known_at, count(*) AS edges, round(sum(weight), 6) AS weight FROM v JOIN t ON valid_from <= valid_at AND (valid_to IS NULL OR valid_to > valid_at)
        AND recorded_at <= known_at AND (recorded_to IS NULL OR recorded_to > known_at) GROUP BY 1, 2""")
def edge_revisions_as_of(spark, sf_dir):
    """How many edges held at several times, as believed at several times."""
    made = revisions.revise(*_tables(spark, sf_dir))
    flags = F.array(*(F.when(revisions.as_of(F.lit(a), F.lit(b)), F.struct(F.lit(a).cast("long").alias("valid_at"), F.lit(b).cast("long").alias("known_at"))) for a, b in TIMES))
    seen = made.select("weight", F.explode(F.array_compact(flags)).alias("t"))
    return seen.groupBy("t.valid_at", "t.known_at").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))
