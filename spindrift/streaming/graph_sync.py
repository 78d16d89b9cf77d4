"""Upkeep of an entity graph by deltas: each micro-batch changes only the edges that its mentions touch.

A graph links every record to the first record (the least id) that names one of its entities, with the number of entities they share
that way; the full build is `star`. A batch's mentions that are new are compared with what is known of the same names: where
the first record stays, a new mention adds one to one edge; where an earlier record appears, the name's edges move to it, as
minus and plus one. Deltas are appended, and the graph is their sum, so it equals the full build after any split into batches.

Mentions and deltas are written to a folder for each batch, over what an earlier try of the batch left, and a batch reads those of
earlier batches alone: a batch that is tried again changes nothing. New mentions are written before they are compared, so that
they are found once.

Defined results: mentions with a null id or name are none; repeated mentions count once, in a batch and over batches; an
empty stream gives an empty graph.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.tables import shared_folder

DELTA = "src {id}, dst {id}, weight long"


def star(mentions: DataFrame) -> DataFrame:
    """src, dst, weight of mentions (id, name), built as a whole."""
    own = mentions.filter("id IS NOT NULL AND name IS NOT NULL").select("id", "name").distinct()
    first = own.groupBy("name").agg(F.min("id").alias("src"))
    return own.join(first, "name").filter("id <> src").groupBy("src", F.col("id").alias("dst")).agg(F.count("*").alias("weight"))


def arrived(known: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's new mentions: id, name."""
    own = batch.filter("id IS NOT NULL AND name IS NOT NULL").select("id", "name").distinct()
    return own.join(known, ["id", "name"], "left_anti")


def deltas(known: DataFrame, new: DataFrame) -> DataFrame:
    """How new mentions change the edges: src, dst, weight (which may be negative)."""
    arrivals = new.groupBy("name").agg(F.min("id").alias("arrived"))
    before = known.join(arrivals.select("name"), "name", "left_semi").groupBy("name").agg(F.min("id").alias("before"))
    firsts = before.join(arrivals, "name", "right").select("name", "before", F.least("before", "arrived").alias("after"))
    old = known.select("id", "name").join(firsts.filter("before > after"), "name")
    link = lambda src, n: F.struct(F.col(src).alias("src"), F.lit(n).cast("long").alias("weight"))
    changes = new.join(firsts, "name").select("id", F.array(link("after", 1)).alias("links")).unionByName(old.select("id", F.array(link("before", -1), link("after", 1)).alias("links")))
    changes = changes.select(F.col("id").alias("dst"), F.inline("links")).filter("src <> dst")
    return changes.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter("weight <> 0")


def current(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The graph that a folder's deltas add up to; kind: the type of ids."""
    parts = spark.read.schema(DELTA.format(id=kind) + ", batch long").parquet(f"{folder}/edges")
    return parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def maintain(stream: DataFrame, folder: str | None = None, at_once: bool = True) -> str:
    """Bring the graph in the folder up to date with a stream of mentions (id, name), and give the folder."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    kind = stream.schema["id"].dataType.simpleString()
    mentions = f"id {kind}, name string"
    spark.createDataFrame([], mentions).write.mode("overwrite").parquet(f"{folder}/mentions/batch=-1")
    spark.createDataFrame([], DELTA.format(id=kind)).write.mode("overwrite").parquet(f"{folder}/edges/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        known = own.read.schema(f"{mentions}, batch long").parquet(f"{folder}/mentions").filter(F.col("batch") < number)
        adaptive = own.conf.get("spark.sql.adaptive.enabled")
        own.conf.set("spark.sql.adaptive.enabled", spark.conf.get("spark.sql.adaptive.enabled"))  # streams turn it off for their state; here is none
        try:
            arrived(known, batch).write.mode("overwrite").parquet(f"{folder}/mentions/batch={number}")
            new = own.read.schema(mentions).parquet(f"{folder}/mentions/batch={number}")
            deltas(known, new).write.mode("overwrite").parquet(f"{folder}/edges/batch={number}")
        finally:
            own.conf.set("spark.sql.adaptive.enabled", adaptive)

    writer = stream.select("id", "name").writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write)
    (writer.trigger(availableNow=True) if at_once else writer).start().awaitTermination()
    return folder
