"""Consolidation of old, unimportant records: what may be summed up, the batch job that does it, and its reverse.

A table of records has id, content, kind, vector, consolidated_into, consolidated_s and consolidated_n (of a summary: of how
many); other columns are kept, and null in summaries. A cluster's geometry (spread of its vectors, effective dimension of
their covariance, share of its first direction) decides: a tight cluster, or one near the limit, becomes a summary with
the content of its medoid; of a diverse one the half that is most unlike its other members stays. A summary's id follows
from its members, and a job whose time is in the table already changes nothing, so it may be tried again.

Distinctness is 1 minus the mean cosine to the others, which is a product with the cluster's vector sum: no pairs are made.
Members are ranked by ranges of all rows (`placed`), so a cluster that holds a third of them is no single task.

Defined results: rows without an id, a vector or a cluster are never consolidated; ties go to the least id; an empty table gives an
empty table. Only summaries that aren't themselves consolidated can be reversed; other ids are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import vectors
from spindrift.operators import cluster
from spindrift.operators.summary_tree import placed
from spindrift.sources.tables import stored

THETA = 0.15
LEAST, KEEP = 3, 0.5
#: Of a cluster's strategy: how its summary begins.
HEADS = {"centroid": "[Consolidated] ", "medoid": "[Consolidated-Medoid] ", "prune": "[Consolidated-Pruned] "}


def due(records: DataFrame, importance: Column, created_s: Column, at_s: int, most: int = 30, days: int = 90) -> DataFrame:
    """Records that are old and unimportant, and neither summaries nor parts of one."""
    return records.filter((importance <= most) & (at_s - created_s >= days * 86400) & F.col("consolidated_into").isNull() & F.col("consolidated_n").isNull())


def safety(geometry: DataFrame, theta: float = THETA) -> DataFrame:
    """geometry with limit (the spread under which a cluster may be summed up), safe and representatives."""
    limit = theta * F.pow(F.lit(2.0), 1 / F.greatest("dimension", F.lit(1.0))) * 0.75
    wanted = F.greatest(F.lit(1), F.ceil(F.round(F.exp(F.col("dimension") * 0.5), 9))).cast("long")
    return geometry.withColumn("limit", limit).withColumn("safe", F.col("spread") < F.col("limit")).withColumn("representatives", wanted)


def distinctness(members: DataFrame) -> DataFrame:
    """members (id, cluster, vector) with n and distinct, 1 minus the mean cosine to the other members; 0 of a lone one."""
    unit = members.withColumn("_u", vectors.normalize(F.col("vector")))
    sums = cluster.centroids(unit.select("cluster", "_u"), "cluster", "_u").select("cluster", "n", F.transform("centroid", lambda x: x * F.col("n")).alias("_sum"))
    others = (vectors.dot(F.col("_u"), F.col("_sum")) - vectors.dot(F.col("_u"), F.col("_u"))) / (F.col("n") - 1)
    return unit.join(sums, "cluster").withColumn("distinct", F.when(F.col("n") > 1, 1 - others).otherwise(0.0)).drop("_u", "_sum")


def planned(members: DataFrame, theta: float = THETA) -> DataFrame:
    """id, cluster, strategy, n, into of the members (id, cluster, content, vector) that are to be summed up; into is the summary's id."""
    own = members.filter("id IS NOT NULL AND cluster IS NOT NULL AND vector IS NOT NULL").withColumn("vector", F.col("vector").cast("array<double>"))
    shapes = cluster.geometry(own.select("cluster", vectors.normalize(F.col("vector")).alias("vector")), "cluster", "vector", theta).filter(F.col("n") >= LEAST).select("cluster", "strategy")
    ranked = distinctness(own.select("id", "cluster", "vector")).join(shapes, "cluster")
    ranked = ranked.select("cluster", "id", "strategy", (-vectors.bucket(F.col("distinct"))).alias("_order"))
    whole = ranked.filter("strategy <> 'prune'").select("id", "cluster", "strategy")
    rest = placed(ranked.filter("strategy = 'prune'"), "cluster", "_order", "id").filter(F.col("place") >= F.greatest(F.lit(2), F.ceil(F.col("n") * KEEP)))
    gone = stored(whole.unionByName(rest.select("id", "cluster", "strategy")))
    marks = [F.hex(F.bit_xor(F.xxhash64(F.lit(i), "id"))) for i in range(2)]
    names = gone.groupBy("cluster").agg(F.count("*").alias("n"), F.concat(F.lit("summary-"), *marks).alias("into"))
    return gone.join(names, "cluster").select("id", "cluster", "strategy", "n", "into")


def consolidate(records: DataFrame, members: DataFrame, at_s: int, theta: float = THETA) -> DataFrame:
    """The table after the job of the time at_s: members (id, cluster, content, vector) are candidates with their clusters."""
    if not records.filter(F.col("consolidated_n").isNotNull() & (F.col("consolidated_s") == at_s)).isEmpty():
        return records
    plan = stored(planned(members, theta))
    own = members.join(plan.select("id", "cluster"), ["id", "cluster"], "left_semi").withColumn("vector", F.col("vector").cast("array<double>"))
    middle = cluster.medoid(own.select("cluster", "id", "vector"), "cluster", "id", "vector")
    named = plan.groupBy("cluster", "strategy", "n", "into").agg(F.count("*").alias("_n"))
    head = F.coalesce(*(F.when(F.col("strategy") == s, h) for s, h in HEADS.items()))
    said = F.when(F.col("strategy") == "prune", F.format_string("%d similar records", "n")).otherwise(F.coalesce("content", F.lit("")))
    made = named.join(middle.join(own, ["cluster", "id"]).dropDuplicates(["cluster"]), "cluster")
    made = made.select(F.col("into").alias("id"), F.concat(head, said).alias("content"), F.lit("context").alias("kind"), "vector", F.lit(at_s).cast("long").alias("consolidated_s"), F.col("n").alias("consolidated_n"))
    kind = records.schema["vector"].dataType
    made = made.withColumn("vector", F.col("vector").cast(kind))
    marked = records.join(plan.select("id", "into"), "id", "left")
    done = F.col("into").isNotNull() & F.col("consolidated_into").isNull()
    marked = marked.withColumns({"consolidated_into": F.when(done, F.col("into")).otherwise(F.col("consolidated_into")), "consolidated_s": F.when(done, F.lit(at_s)).otherwise(F.col("consolidated_s"))})
    return marked.select(records.columns).unionByName(made, allowMissingColumns=True).select(records.columns)


def reverse(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """The table with the summaries (id) taken out and their members as they were."""
    gone = records.filter("consolidated_n IS NOT NULL AND consolidated_into IS NULL").join(summaries.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("_gone"))
    gone = stored(gone)
    kept = records.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    back = kept.join(gone, F.col("consolidated_into") == F.col("_gone"), "left")
    free = F.col("_gone").isNotNull()
    back = back.withColumns({"consolidated_into": F.when(free, None).otherwise(F.col("consolidated_into")), "consolidated_s": F.when(free, None).otherwise(F.col("consolidated_s"))})
    return back.select(records.columns)
