"""Cycles of any length in a directed graph of edges (src, dst): its strongly connected components of more than one vertex, or
of one with an edge to itself.

What can't be on a cycle goes first: chains of vertices with one successor that end in nothing, by pointer doubling (so a chain of
n takes log n rounds), then, round by round, vertices without an edge in or without one out. In what is left every vertex takes the
greatest vertex that reaches it as its colour; a component's greatest vertex has its own colour, and what reaches that backwards
within the colour is its component. Found components are taken out and the rest is coloured again. Every round is a join
and an aggregation over what is left, and is written.

Defined results: edges with a null end are none; repeated edges count once; an empty table has no cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.tables import discard, stored


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    out = stored(new)
    discard(old)
    return out


def _without_chains(edges: DataFrame) -> DataFrame:
    """The edges that aren't of a chain of sole successors that ends: such a chain has no cycle."""
    steps = stored(edges.groupBy("src").agg(F.min("dst").alias("to"), F.count("*").alias("_n")).filter("_n = 1").select("src", "to"))
    ends = stored(edges.select(F.col("dst").alias("v")).distinct().join(edges.select(F.col("src").alias("v")).distinct(), "v", "left_anti"))
    walk = stored(steps)
    # `to` doubles its distance in each round; a vertex with more successors, which has no step, stops it.
    while True:
        at_end = walk.join(ends, F.col("to") == F.col("v"), "left_semi").select("src")
        on = walk.select(F.col("src").alias("_s"), F.col("to").alias("_t"))
        moved = walk.join(on, F.col("to") == F.col("_s"), "left").select("src", F.coalesce("_t", "to").alias("next"), "to")
        moved = stored(moved)
        gone = stored(at_end)
        before, ends = ends, stored(ends.unionByName(gone.select(F.col("src").alias("v"))).distinct())
        more = ends.count() > before.count()
        walk = stored(moved.select("src", F.col("next").alias("to")).join(ends, F.col("src") == F.col("v"), "left_anti"))
        if not more:
            break
    return edges.join(ends, F.col("src") == F.col("v"), "left_anti").join(ends, F.col("dst") == F.col("v"), "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between vertices that have edges both in and out."""
    edges, n = stored(edges), None
    while True:
        left = edges.count()
        if left == n or not left:
            return edges
        n = left
        inner = edges.select(F.col("src").alias("v")).distinct().join(edges.select(F.col("dst").alias("v")).distinct(), "v", "left_semi")
        inner = stored(inner)
        edges = _replaced(edges, edges.join(inner, F.col("src") == F.col("v"), "left_semi").join(inner, F.col("dst") == F.col("v"), "left_semi"))
        discard(inner)


def _spread(state: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """state (v, value), where the greatest value of all predecessors replaces a lesser one until nothing changes; null is the least."""
    while True:
        got = edges.join(state.select(F.col("v").alias("src"), F.col(value).alias("_x")).filter("_x IS NOT NULL"), "src").groupBy(F.col("dst").alias("v")).agg(F.max("_x").alias("_x"))
        new = state.join(got, "v", "left").select("v", F.greatest(value, "_x").alias(value), (F.col("_x").isNotNull() & F.coalesce(F.col("_x") > F.col(value), F.lit(True))).alias("_new"))
        new = stored(new)
        if new.filter("_new").isEmpty():
            return new.drop("_new")
        discard(state)
        state = new.drop("_new")
        state.stored_at = new.stored_at


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its least vertex), size of every vertex on a cycle."""
    own = stored(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops = own.filter("src = dst").select(F.col("src").alias("vertex"), F.col("src").alias("root"))
    left = _trimmed(_without_chains(own.filter("src <> dst")))
    found = [loops]
    while not left.isEmpty():
        vertices = left.select(F.col("src").alias("v")).distinct()
        colour = _spread(stored(vertices.withColumn("colour", F.col("v"))), left, "colour")
        of = lambda end: colour.select(F.col("v").alias(end), F.col("colour").alias(f"{end}_colour"))
        within = stored(left.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = stored(colour.withColumn("root", F.when(F.col("v") == F.col("colour"), F.col("v"))).select("v", "root"))
        reached = _spread(roots, within, "root").filter("root IS NOT NULL")
        found.append(reached.select(F.col("v").alias("vertex"), "root"))
        gone = reached.select(F.col("v").alias("_v"))
        left = _trimmed(left.join(gone, F.col("src") == F.col("_v"), "left_anti").join(gone, F.col("dst") == F.col("_v"), "left_anti"))
    all_ = stored(reduce(DataFrame.unionByName, found).groupBy("vertex").agg(F.max("root").alias("root")))
    looped = loops.select(F.col("vertex").alias("_l"))
    sizes = all_.groupBy("root").agg(F.min("vertex").alias("component"), F.count("*").alias("size"))
    out = all_.join(sizes, "root").join(looped, F.col("vertex") == F.col("_l"), "left")
    return out.filter("size > 1 OR _l IS NOT NULL").select("vertex", "component", "size")


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The edges within components, with their component."""
    end = lambda c: members.select(F.col("vertex").alias(c), F.col("component").alias(f"_{c}"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").filter("_src = _dst").withColumnRenamed("_src", "component").drop("_dst")
