"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups edges by a vertex and hands all its neighbours to the least one; partial minima are combined
before the shuffle, and no step collects a vertex's neighbours. The number of rounds grows with the logarithm of
the longest chain. Every round is written to the shared folder, so lost executors cost one round at most; the one before is deleted.
As soon as no more than FEW edges are left, one task ends the work by union-find, without shuffles: rounds over few rows
cost the driver the records of all their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import discard, written

#: Edges that one task joins by union-find, at most.
FEW = 100_000


def _joined(batches) -> Iterator[pa.RecordBatch]:
    """vertex, component of all edges of a task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    vertices = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (vertices, [root(x) for x in vertices])], ["vertex", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, component (the least vertex that it reaches) for every vertex of an edge; loops and repeats don't matter."""
    edges = written(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v"))
    now, seen = edges.agg(F.count("*")).first(), None
    while True:
        if now[0] <= FEW:
            out = written(edges.coalesce(1).mapInArrow(_joined, "vertex long, component long"))
            discard(edges)
            return out
        # large star: every larger neighbour of a vertex goes to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: every smaller neighbour, and the vertex itself, go to the least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = nxt
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
