"""Clusters of vectors: spread, representatives, geometry and leader clustering.

Rows without a vector are left out by the caller; ties go to the least key; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import vectors


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, centroid (the mean vector), by one aggregation over exploded coordinates."""
    parts = rows.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy(group, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def spread(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, n, spread: the mean cosine distance of all pairs of unit vectors, in linear time: 1 - (|sum|^2 - n) / (n (n - 1))."""
    c = centroids(rows, group, vector)
    length = F.pow(vectors.magnitude(F.col("centroid")) * F.col("n"), 2)
    return c.select(group, "n", F.when(F.col("n") > 1, 1 - (length - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("spread"))


def medoid(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, key: the member most similar to the mean (the least key of ties)."""
    near = rows.join(centroids(rows, group, vector).select(group, "centroid"), group).withColumn("_s", vectors.bucket(vectors.cosine(F.col(vector), F.col("centroid"))))
    return near.groupBy(group).agg(F.min_by(key, F.struct(-F.col("_s"), F.col(key))).alias(key))


def geometry(rows: DataFrame, group: str, vector: str, theta: float = 0.7) -> DataFrame:
    """group, n, dimension (participation ratio of the spectrum), concentration, strategy. Each task sums moments of its
    rows (n, sum and Gram matrix of d x d), so that no group's vectors meet in one place."""

    def moments(pdf_iter):
        import pandas as pd

        for pdf in pdf_iter:
            out = []
            for g, part in pdf.groupby(group):
                v = np.stack([np.asarray(x, np.float64) for x in part[vector]])
                out.append((g, len(v), v.sum(0).tolist(), (v.T @ v).ravel().tolist()))
            yield pd.DataFrame(out, columns=["g", "n", "s", "c"])

    kind = rows.schema[group].dataType.simpleString()
    parts = rows.select(group, vector).mapInPandas(moments, f"g {kind}, n long, s array<double>, c array<double>")

    def finish(pdf):
        import pandas as pd

        n = int(pdf["n"].sum())
        s = np.sum(np.stack(pdf["s"]), 0)
        c = np.sum(np.stack(pdf["c"]), 0).reshape(len(s), len(s))
        cov = c / n - np.outer(s / n, s / n)
        values = np.maximum(np.linalg.eigvalsh(cov), 0)
        total = values.sum()
        dimension = max(1.0, total * total / max((values * values).sum(), 1e-300)) if total > 1e-12 else 1.0
        concentration = values[-1] / total if total > 1e-12 else 1.0
        spread_ = 1 - (s @ s - n) / (n * (n - 1)) if n > 1 else 0.0
        limit = theta * 2 ** (1 / dimension)
        strategy = "centroid" if n < 3 or spread_ < 0.75 * limit and (concentration > 0.55 or spread_ <= 0) else "prune" if spread_ > 1.25 * limit else "medoid"
        return pd.DataFrame([(pdf["g"].iloc[0], n, dimension, concentration, spread_, strategy)], columns=[group, "n", "dimension", "concentration", "spread", "strategy"])

    return parts.groupBy("g").applyInPandas(finish, f"{group} {kind}, n long, dimension double, concentration double, spread double, strategy string")


def leaders(rows: DataFrame, group: str, key: str, vector: str, theta: float) -> DataFrame:
    """group, key, cluster: in the order of the key, each vector joins the nearest cluster mean of at least theta or begins
    a cluster. Order dependent, so sequential within a group; groups (projects) run in parallel."""

    def run(pdf):
        pdf = pdf.sort_values(key)
        sums: list[np.ndarray] = []
        out = []
        for x in pdf[vector]:
            v = np.asarray(x, np.float64)
            v = v / (np.linalg.norm(v) or 1.0)
            if sums:
                m = np.stack(sums)
                s = m @ v / np.maximum(np.linalg.norm(m, axis=1), 1e-300)
                best = int(np.argmax(s))
            if sums and s[best] >= theta:
                sums[best] = sums[best] + v
            else:
                best = len(sums)
                sums.append(v)
            out.append(best)
        return pdf[[group, key]].assign(cluster=np.array(out, np.int64))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")


def summary(rows: DataFrame, group: str, kind: str, content: str, order: str, first: int = 3, head: int = 80) -> DataFrame:
    """group, summary: for each kind the heads of its first contents."""
    w = Window.partitionBy(group, kind).orderBy(order)
    heads = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first).select(group, kind, "_r", F.substring(F.regexp_replace(content, r"\s+", " "), 1, head).alias("_h"))
    lines = heads.groupBy(group, kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_h"))), lambda s: s["_h"]), "; ").alias("_l"))
    return lines.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "_l"))), lambda s: F.concat(s[kind], F.lit(": "), s["_l"])), "\n").alias("summary"))
