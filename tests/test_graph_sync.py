"""An entity graph kept by deltas against the full build, after any split into batches."""

from __future__ import annotations

import random
from pathlib import Path

from spindrift.streaming import graph_sync


def rows(df):
    return sorted(map(tuple, df.collect()))


def mentions(seed: int, n: int):
    rng = random.Random(seed)
    return [(rng.randint(0, 40) if rng.random() > 0.03 else None, f"n{min(rng.randint(0, 30), 12)}" if rng.random() > 0.03 else None) for _ in range(n)]


def test_any_split_gives_the_full_build(spark, tmp_path):
    all_ = mentions(1, 260)
    schema = "id long, name string"
    want = rows(graph_sync.star(spark.createDataFrame(all_, schema)))
    for split in (1, 3, 7):
        source = str(tmp_path / f"in{split}")
        for k in range(split):
            spark.createDataFrame(all_[k::split] + all_[:5], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        folder = graph_sync.maintain(stream, str(tmp_path / f"out{split}"))
        assert rows(graph_sync.current(spark, folder, "long")) == want and len(want) > 50
        assert len(list((tmp_path / f"out{split}" / "edges").glob("batch=*"))) == split + 1


def test_more_data_and_a_batch_that_is_tried_again(spark, tmp_path):
    schema, folder, source = "id long, name string", str(tmp_path / "out"), str(tmp_path / "in")
    first, second = mentions(2, 60), mentions(3, 60)
    read = lambda: spark.readStream.schema(schema).parquet(source)
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(source)
    graph_sync.maintain(read(), folder)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(source)
    graph_sync.maintain(read(), folder)
    want = rows(graph_sync.star(spark.createDataFrame(first + second, schema)))
    assert rows(graph_sync.current(spark, folder, "long")) == want
    for commit in (tmp_path / "out" / "checkpoint" / "commits").glob("*1*"):
        commit.unlink()  # the last batch was written, but its end wasn't
    graph_sync.maintain(read(), folder)
    assert rows(graph_sync.current(spark, folder, "long")) == want


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "id long, name string").write.parquet(str(tmp_path / "in"))
    folder = graph_sync.maintain(spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert graph_sync.current(spark, folder, "long").isEmpty()


def test_a_batch_of_the_query_is_read_by_several_tasks(spark, tmp_path):
    from spindrift.plans.streams import stream_graph_sync
    from spindrift.sources.tables import shared_folder

    lines = [(i % 90, i % 13, 1 + i % 6) for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    there = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("mentions-*"))
    before, partitions = there(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = rows(stream_graph_sync(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    (folder,) = there() - before
    assert len(list(folder.glob("*.parquet"))) == 12
    own = spark.createDataFrame([(o, f"{p}{'b' if n > 3 else ''}") for o, p, n in lines], "id long, name string")
    assert got == rows(graph_sync.star(own))
