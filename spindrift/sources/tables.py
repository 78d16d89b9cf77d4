"""Sources and sinks: tables with explicit schemas, transcripts, backups and merges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSCRIPT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("uuid", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("gitBranch", T.StringType()),
    T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])),
])


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a folder of this machine's is used if all of Spark runs on it;
    on a cluster, whose executors don't see such a folder, that is an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the plan, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/spindrift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, uuid, role, content, at of JSON-lines transcripts. A content of blocks is the text of its text blocks; broken lines are skipped."""
    raw = spark.read.schema(TRANSCRIPT).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    blocks = F.from_json("message.content", "array<struct<type string, text string>>")
    text = F.when(F.col("message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("message.content"))
    return raw.filter("message IS NOT NULL").select("file", "modified", "uuid", F.col("message.role").alias("role"), text.alias("content"), F.coalesce(F.try_to_timestamp("timestamp"), F.timestamp_millis(F.expr("try_cast(timestamp AS BIGINT)"))).alias("at"))


def backup(df: DataFrame, path: str, *partition: str) -> None:
    (df.write.mode("overwrite").partitionBy(*partition) if partition else df.write.mode("overwrite")).parquet(path)


def restore(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def merge_stores(stores: list[DataFrame], content: str, newest: str) -> DataFrame:
    """The union of stores with one row per content, the newest; missing columns are null."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    columns = out.columns
    best = out.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("_h")).agg(F.max_by(F.struct(*columns), F.struct(F.col(newest), F.xxhash64(*columns))).alias("_r"))
    return best.select("_r.*")
