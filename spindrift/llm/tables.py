"""Reading the tables, the label hold-out and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(*names: str) -> list[Column]:
    """Columns by their whole names, which may hold dots, spaces and backticks."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the documents whose labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a folder of this machine's is used if all of Spark
    runs on it; on a cluster, whose executors don't see such a folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/spindrift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a filter of keys: its table has at most a 64th as many rows.
FILTER_BITS = 1 << 25


def likely_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among `keys`, and a few others: a filter of fixed size is broadcast, so that rows that no key
    wants aren't shuffled by the join that follows. With very many keys it lets more pass, which only costs time."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 AS int))")
    words = keys.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / 64).alias("_k")).agg(F.bit_or(bit("_p")).alias("_b"))
    marked = rows.withColumn("_p", place).withColumn("_k", F.floor(F.col("_p") / 64)).join(F.broadcast(words), "_k")
    return marked.filter(F.col("_b").bitwiseAND(bit("_p")) != 0).select(*named(*rows.columns))


def spread_join(rows: DataFrame, classes: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows joined with classes, which has one row for each key and in `size` how many rows have it. Keys of more than
    a thousandth of all rows (so 1000 keys at most) are broadcast, and their rows stay where they are; the others are shuffled."""
    classes = written(classes)
    most = max(1000, (classes.agg(F.sum(size)).first()[0] or 0) // 1000)
    hot = F.broadcast(classes.filter(F.col(size) > most))
    cold = rows.join(F.broadcast(classes.filter(F.col(size) > most).select(*on)), on, "left_anti").join(classes.filter(F.col(size) <= most), on)
    return rows.join(hot, on).unionByName(cold)


def tokenizer_path(name: str) -> str:
    """A vocabulary file by name; SPINDRIFT_TOKENIZERS, if set, is the folder, else the public_tokenizers package."""
    if folder := os.environ.get("SPINDRIFT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
