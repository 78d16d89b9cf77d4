"""A training-data pipeline over `documents`: five stages, each one operator of spindrift.llm on all that its
predecessor kept. Every stage is written as Parquet to the shared folder and read again by the next one.

Columns of documents that the stages don't know are passed on to the last stage, whatever their names. n_chars
follows the text. A null text stays null up to packing, where it is empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import jaccard, langid, line_dedup, packing, repeats
from spindrift.llm.tables import held_out, named, table, written


def _others(docs: DataFrame) -> Column:
    """All columns but the text in one struct, _row, so that a text is carried once."""
    return F.struct(*named(*(c for c in docs.columns if c != "text"))).alias("_row")


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct _row, with the text in _kept as text and n_chars (where there is one) after it."""
    length = F.when(F.col("_kept").isNull(), F.col("_row")["n_chars"]).otherwise(F.length("_kept").cast("long")) if "n_chars" in columns else None
    new = {"text": F.col("_kept"), "n_chars": length}
    return rows.select(*((new[c] if c in new else F.col("_row")[c]).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, or no letter in it) go."""
    model = langid.train(docs.select("doc_id", "text", "lang").filter(~held_out()))
    own = docs.select(F.struct(*named(*docs.columns)).alias("_row"))
    return langid.identify(own, model, "_row", row=True).filter("lang_pred <> 'und'").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their site go; every document stays."""
    own = docs.select(_others(docs), "source", "text")
    return _with_text(line_dedup.drop_boilerplate(own).withColumn("_kept", F.col("text")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least doc_id stays, and any row without a doc_id."""
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*named(*docs.columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller doc_id holds go; every document stays."""
    own = docs.select("doc_id", "text", _others(docs), F.col("text").isNull().alias("_none"))
    own = repeats.remove_repeats(own, "_row", "_none", text=True)
    return _with_text(own.withColumn("_kept", F.when(~F.col("_none"), F.col("kept"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("pack", pack)]

#: Not expressible in SQL as a whole: the language model is learned, and tokens come from a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
