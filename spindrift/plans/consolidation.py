"""Queries over consolidation: documents with the vectors of their ids are records, a vector's label is its cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import vectors
from spindrift.operators import cluster, consolidation
from spindrift.plans.registry import AS_OF, M, memories, query, table
from spindrift.sources.tables import stored

#: v (id, g, u): due records with their cluster and unit vector; n2 (g, n, spread, dimension).
SHAPES = f"""{M}, v AS (SELECT id, label AS g, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u
        FROM m JOIN embeddings ON vec_id = id WHERE importance <= 30 AND {AS_OF} - created_s >= 90 * 86400),
    x AS (SELECT id, g, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM v), s AS (SELECT g, i, sum(x) AS s, count(*) AS n FROM x GROUP BY 1, 2),
    c AS (SELECT a.g, a.i, b.i AS j, sum(a.x * b.x) / count(*) AS c FROM x a JOIN x b ON a.id = b.id GROUP BY 1, 2, 3),
    c2 AS (SELECT c.g, c.i, c.j, c.c - a.s / a.n * b.s / b.n AS c FROM c JOIN s a ON a.g = c.g AND a.i = c.i JOIN s b ON b.g = c.g AND b.i = c.j),
    d AS (SELECT g, greatest(1::DOUBLE, pow(sum(c) FILTER (i = j), 2) / sum(c * c)) AS dimension FROM c2 GROUP BY g),
    n2 AS (SELECT g, n, 1 - (q - n) / (n * (n - 1)) AS spread, dimension, {consolidation.THETA} * pow(2::DOUBLE, 1 / dimension) AS theta
        FROM (SELECT g, max(n) AS n, sum(s * s) AS q FROM s GROUP BY g) JOIN d USING (g) WHERE n >= 3)"""


def _records(spark, sf_dir):
    own = memories(spark, sf_dir, "id", "content", "kind", "importance", "created_s")
    rows = own.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster")), "id", "left")
    none = {"consolidated_into": "string", "consolidated_s": "long", "consolidated_n": "long"}
    return rows.withColumn("id", F.col("id").cast("string")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


def _due(records):
    return consolidation.due(records, F.col("importance"), F.col("created_s"), AS_OF).select("id", "cluster", "content", "vector")


@query(f"""WITH {SHAPES} SELECT g AS cluster, n AS members, round(spread, 6) AS spread, round(dimension, 6) AS dimension,
    CAST(greatest(1, ceil(round(exp(dimension * 0.5), 9))) AS BIGINT) AS representatives, spread < theta * 0.75 AS safe FROM n2""")
def consolidation_candidates(spark, sf_dir):
    """Clusters of old, unimportant records: their geometry, whether they may be summed up, and in how many rows."""
    own = _due(_records(spark, sf_dir)).filter("vector IS NOT NULL").select("cluster", vectors.normalize(F.col("vector")).alias("vector"))
    shapes = consolidation.safety(cluster.geometry(own, "cluster", "vector", consolidation.THETA).filter("n >= 3"))
    return shapes.select("cluster", F.col("n").alias("members"), F.round("spread", 6).alias("spread"), F.round("dimension", 6).alias("dimension"), "representatives", "safe")


@query(f"""WITH {SHAPES}, k AS (SELECT a.id, a.g, 1 - avg(list_dot_product(a.u, b.u)) AS far FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
    r AS (SELECT id, g, n, spread > theta * 1.25 AS prune, row_number() OVER (PARTITION BY g ORDER BY -floor(far * 1e6 + 0.5), id::VARCHAR) - 1 AS place FROM k JOIN n2 USING (g)),
    o AS (SELECT id, g, CASE WHEN prune THEN place >= greatest(2, ceil(n * 0.5)) ELSE true END AS gone FROM r)
    SELECT id::VARCHAR AS id, count(*) OVER (PARTITION BY g) AS members FROM o WHERE gone""")
def consolidation_run(spark, sf_dir):
    """Records that the job sums up, each with the number of members that its summary states."""
    records = _records(spark, sf_dir)
    after = stored(consolidation.consolidate(records.drop("cluster"), _due(records), AS_OF))
    made = after.filter("consolidated_n IS NOT NULL").select(F.col("id").alias("consolidated_into"), F.col("consolidated_n").alias("members"))
    return after.filter("consolidated_n IS NULL").join(made, "consolidated_into").select("id", "members")


@query(f"WITH {M} SELECT id::VARCHAR AS id, kind, importance, sha256(coalesce(content, '')) AS sha, false AS consolidated FROM m")
def consolidation_undo(spark, sf_dir):
    """The records after the job and its reverse: as they were."""
    records = _records(spark, sf_dir)
    after = stored(consolidation.consolidate(records.drop("cluster"), _due(records), AS_OF))
    back = consolidation.reverse(after, after.filter("consolidated_n IS NOT NULL").select("id"))
    return back.select("id", "kind", "importance", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"), F.coalesce("consolidated_into", "consolidated_s", "consolidated_n").isNotNull().alias("consolidated"))
