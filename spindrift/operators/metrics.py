"""Retrieval and calibration metrics. One aggregation each; thresholds are a short list that every row is counted for.

A null relevance, rank, gain or confidence adds nothing; a query without a relevant row has no recall and rank 0; ties in the ideal order
go to the least key; an empty table gives null means and zero counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(rows: DataFrame, query: str, relevant: str, rank: str, k: int = 5) -> DataFrame:
    """queries, recall5, mrr, hit1, any5 over all queries."""
    hit = F.col(relevant) == 1
    per = rows.groupBy(query).agg(
        (F.sum((hit & (F.col(rank) <= k)).cast("int")) / F.greatest(F.lit(1), F.sum(relevant))).alias("recall"),
        F.coalesce(1 / F.min(F.when(hit, F.col(rank))), F.lit(0.0)).alias("rr"),
        F.max((hit & (F.col(rank) == 1)).cast("int")).alias("first"),
        F.max((hit & (F.col(rank) <= k)).cast("int")).alias("any"),
    )
    return per.agg(F.count("*").alias("queries"), *(F.round(F.avg(a), 6).alias(b) for a, b in (("recall", "recall5"), ("rr", "mrr"), ("first", "hit1"), ("any", "any5"))))


def ndcg(rows: DataFrame, query: str, gain: str, order: list[str], key: str, k: int) -> DataFrame:
    """query, ndcg at k."""
    own = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(gain), key))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1)).otherwise(0.0))
    sums = rows.withColumn("_r", own).withColumn("_i", best).groupBy(query).agg(part("_r").alias("dcg"), part("_i").alias("ideal"))
    return sums.select(query, F.round(F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"))


def calibration(rows: DataFrame, confidence: str, relevant: str, bands: int = 10) -> DataFrame:
    """n, ece, brier: the bands' gaps between confidence and accuracy, weighted, and the mean squared error."""
    c, y = F.col(confidence), F.col(relevant)
    per = rows.groupBy(F.least(F.lit(bands - 1), F.floor(c * bands)).alias("band")).agg(F.count("*").alias("n"), F.avg(c).alias("c"), F.avg(y).alias("a"), F.sum((c - y) * (c - y)).alias("e"))
    total = F.sum("n")
    return per.agg(total.alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / total, 6).alias("ece"), F.round(F.sum("e") / total, 6).alias("brier"))


def selective(rows: DataFrame, confidence: str, relevant: str, thresholds: list[float]) -> DataFrame:
    """threshold, coverage, wrong_given, cwr: what a floor on the confidence would answer, and how wrongly."""
    each = rows.select(confidence, relevant, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    sure = (F.col(confidence) >= F.col("threshold")).cast("int")
    wrong = sure * (F.col(relevant) == 0).cast("int")
    return each.groupBy("threshold").agg(F.round(F.avg(sure), 6).alias("coverage"), F.round(F.sum(wrong) / F.greatest(F.lit(1), F.sum(sure)), 6).alias("wrong_given"), F.round(F.avg(wrong), 6).alias("cwr"))
