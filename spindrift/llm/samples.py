"""Bounded samples of labelled rows and shared numpy helpers of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents outside the held-out fold: those of least hash.

    Only ids and labels are ranked; the ids that won (at most `rows`, so they may be broadcast) pick the texts. Of
    several rows of a document the least text counts, so that `rows` bounds the rows too; a null text counts as empty.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
