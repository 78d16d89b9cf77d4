"""Structured Streaming forms of the incremental operators. Each takes a streaming DataFrame with an event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.sources.tables import shared_folder


def distinct_events(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, key: str, time: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(key, F.col("window.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    counted = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), "n")


def fold_salience(values: list[str], state: dict[str, float], start: float = 0.5, gain: float = 0.2, decay: float = 0.85, most: int = 50) -> dict[str, float]:
    """Each mention decays all entities, then raises its own by `gain` (new ones begin at `start`), at most 1; the
    `most` strongest are kept."""
    for v in values:
        state = {k: s * decay for k, s in state.items()}
        state[v] = min(1.0, state[v] + gain) if v in state else start
        if len(state) > most:
            state = dict(sorted(state.items(), key=lambda x: (-x[1], x[0]))[:most])
    return state


def salience(stream: DataFrame, key: str, entity: str, time: str) -> DataFrame:
    """key, entity, salience after each micro-batch, with the session's entities as state."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values([time, entity])
        known = fold_salience(rows[entity].tolist(), known)
        state.update((list(known), list(known.values())))
        yield pd.DataFrame({key: [group[0]] * len(known), entity: list(known), "salience": list(known.values())})

    return stream.select(key, entity, time).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {entity} {kinds[entity]}, salience double", f"names array<{kinds[entity]}>, values array<double>", "update", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """All that the source has, run to its end; the last state of the result as a table in the shared folder.

    Each micro-batch is written to a folder of its own, over whatever an earlier try of the batch left there, so that a
    retry doesn't double rows. Of a complete result the last batch counts; of updates the last row of each key; an empty
    source gives an empty table."""
    spark: SparkSession = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
    if mode == "complete":
        return out.join(out.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    if keys:
        return out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_r")).select("_r.*")
    return out.drop("batch")
