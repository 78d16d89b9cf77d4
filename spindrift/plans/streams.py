"""Streaming queries, run over all that the events table has."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spindrift.plans.registry import query, table
from spindrift.sources.tables import shared_folder
from spindrift.streaming import graph_sync, streams


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    pattern = f"{sf_dir}/event[s].parquet"  # a pattern may name one file; a plain path of a stream must be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, sf_dir):
    got = streams.run_available(streams.window_counts(_events(spark, sf_dir), "event_type", "ts"))
    return got.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    got = streams.run_available(streams.sessions(_events(spark, sf_dir), "user_id", "ts"))
    return got.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark, sf_dir):
    stream = streams.distinct_events(_events(spark, sf_dir), ["event_id"], "ts")
    return streams.run_available(stream.select("event_id"), "append").agg(F.count("*").alias("n"))


@query()
def stream_salience(spark, sf_dir):
    """An ordered stateful fold: no SQL; the tests hold it against the same fold over the whole table."""
    return streams.run_available(streams.salience(_events(spark, sf_dir), "user_id", "event_type", "ts"), "update", ("user_id", "event_type"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 5000 || CASE WHEN l_linenumber > 3 THEN 'b' ELSE '' END AS name FROM lineitem),
    f AS (SELECT name, min(id) AS src FROM o GROUP BY name) SELECT src, id AS dst, count(*) AS weight FROM o JOIN f USING (name) WHERE id <> src GROUP BY 1, 2""")
def stream_graph_sync(spark, sf_dir):
    """Orders as records and their parts as entities, in about four batches whose order isn't that of the ids; the graph is kept by deltas."""
    folder = f"{shared_folder(spark)}/mentions-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "concat(l_partkey % 5000, CASE WHEN l_linenumber > 3 THEN 'b' ELSE '' END) AS name")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # of a batch: as many tasks read it
    rows.repartition(4 * files, F.xxhash64("id")).write.parquet(folder)
    stream = spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", files).parquet(folder)
    return graph_sync.current(spark, graph_sync.maintain(stream), "long")
