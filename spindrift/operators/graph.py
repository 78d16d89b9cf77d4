"""Bounded graph operators over edge tables (src, dst, weight). Traversals are a fixed number of joins with the
visited vertices taken out; an edge is looked up by either end through a union of two equi-joins.

Edges with a null end join nothing; ties go to the least vertex or path; without edges there are the starts alone, or no
rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.tables import discard, stored


#: Rows of baskets for each partition of pairs.
ROWS = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst"))))


def coactivation(items: DataFrame, basket: str, item: str, least: int = 1) -> DataFrame:
    """src < dst and in how many baskets both are. A basket's items are distinct; cost is the sum of its pairs.

    Rows are dealt out by basket once, and pairs by both ends, to partitions whose number grows with the rows, so that what
    a task holds doesn't."""
    least_parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least_parts, -(-items.count() // ROWS))
    own = items.select(basket, item).repartition(parts, basket).distinct()
    a, b = own.select(basket, F.col(item).alias("src")), own.select(basket, F.col(item).alias("dst"))
    pairs = a.join(b, basket).filter("src < dst").select("src", "dst").repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return pairs.filter(F.col("weight") >= least)


def bfs(edges: DataFrame, starts: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """vertex, hops: everything within `depth` hops of the starts (vertex), over edges of enough weight."""
    step = edges.filter(F.col("weight") >= least).select("src", "dst") if "weight" in edges.columns else edges.select("src", "dst")
    seen = [stored(starts.select("vertex").distinct().withColumn("hops", F.lit(0)))]
    for hop in range(1, depth + 1):  # each hop is written, so that the plan doesn't grow with the hops
        known = reduce(DataFrame.unionByName, seen).select("vertex")
        reached = step.join(seen[-1].select(F.col("vertex").alias("src")), "src").select(F.col("dst").alias("vertex")).distinct()
        seen.append(stored(reached.join(known, "vertex", "left_anti").withColumn("hops", F.lit(hop))))
    return reduce(DataFrame.unionByName, seen)


def neighborhood(edges: DataFrame, starts: DataFrame, radius: int = 2) -> DataFrame:
    """The edges among all vertices within the radius."""
    inside = bfs(both_ways(edges), starts, radius).select("vertex")
    return edges.join(inside.withColumnRenamed("vertex", "src"), "src", "left_semi").join(inside.withColumnRenamed("vertex", "dst"), "dst", "left_semi")


def simple_paths(edges: DataFrame, start, goal, hops: int, k: int) -> DataFrame:
    """The k lightest simple paths (array) of at most `hops` edges, with their weights."""
    step = edges.select("src", "dst", "weight")
    paths = step.filter(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("weight").cast("double").alias("total"), F.col("dst").alias("end"))
    found = paths.filter(F.col("end") == goal)
    for _ in range(hops - 1):
        open_ = paths.filter(F.col("end") != goal)
        paths = open_.join(step, F.col("end") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("weight")).alias("total"), F.col("dst").alias("end"))
        found = found.unionByName(paths.filter(F.col("end") == goal))
    return found.orderBy("total", F.size("path"), "path").limit(k).select("path", "total")


def boost(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float = 0.3) -> DataFrame:
    """vertex, raw, boost: over edges (src, dst, weight, count, recency) from the seeds (vertex), the sum of
    weight * log(1 + count) * recency / (hop + 1), once per edge, scaled between the least and the greatest."""
    step = both_ways(edges).filter(F.col("weight") >= least)
    reached, parts = seeds.select("vertex").distinct().withColumn("hops", F.lit(0)), None
    for hop in range(1, depth + 1):
        front = reached.filter(F.col("hops") == hop - 1).select(F.col("vertex").alias("src"))
        out = step.join(front, "src").join(reached.select(F.col("vertex").alias("dst")), "dst", "left_anti")
        scored = out.select(F.col("dst").alias("vertex"), (F.col("weight") * F.log1p(F.col("count")) * F.col("recency") / (hop + 1)).alias("raw"))
        parts = scored if parts is None else parts.unionByName(scored)
        reached = reached.unionByName(out.select(F.col("dst").alias("vertex")).distinct().withColumn("hops", F.lit(hop)))
    sums = parts.groupBy("vertex").agg(F.sum("raw").alias("raw"))
    span = sums.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return sums.crossJoin(F.broadcast(span)).select("vertex", "raw", F.when(F.col("high") == F.col("low"), 0.1).otherwise(0.1 * (F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))).alias("boost"))  # span: one row


def derive(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """src, dst, kind, confidence: two-hop conclusions. edges: src, dst, kind; rules: first, second, kind, confidence,
    which Spark broadcasts below its own size threshold."""
    a = edges.select("src", F.col("dst").alias("via"), F.col("kind").alias("first"))
    b = edges.select(F.col("src").alias("via"), "dst", F.col("kind").alias("second"))
    out = a.join(b, "via").filter("src <> dst").join(rules, ["first", "second"])
    return out.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.count("*").alias("paths"))


def mutual(edges: DataFrame) -> DataFrame:
    """Two-cycles and loops: src <= dst with edges both ways."""
    e = edges.select("src", "dst").distinct()
    return e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").filter("src <= dst")


def chain_ends(edges: DataFrame, key: str, follows: str) -> DataFrame:
    """The end of each row's chain of successors and the links to it, by pointer doubling. A round is written to the
    shared folder, so that the plan stays small; the last is the one in which no pointer moves. Chains that run in a
    circle have no end and are left out."""
    jump = stored(edges.select(F.col(key).alias("src"), F.col(follows).alias("dst"), F.lit(1).cast("long").alias("links")))
    n = jump.count()
    for _ in range(max(1, n).bit_length() + 1):
        ahead = jump.select(F.col("src").alias("dst"), F.col("dst").alias("further"), F.col("links").alias("more"))
        if jump.join(ahead.select("dst"), "dst", "left_semi").isEmpty():
            return jump
        further = jump.join(ahead, "dst", "left").select("src", F.coalesce("further", "dst").alias("dst"), (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"))
        jump, old = stored(further), jump
        discard(old)
    return jump.join(jump.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst", "links")


def temporal_cycles(edges: DataFrame, depth: int) -> DataFrame:
    """vertex, hops: vertices that a path of at most `depth` edges leads back to, along which all periods [low, high) meet
    (a null end is open). edges: src, dst, low, high."""
    later = F.least(F.col("high"), F.col("h"))  # nulls are skipped
    paths = edges.filter("src <> dst").select(F.col("src").alias("vertex"), F.col("dst").alias("at"), "low", "high")
    loops = edges.filter("src = dst").select(F.col("src").alias("vertex"), F.lit(1).alias("hops"))
    step = edges.filter("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("low").alias("l"), F.col("high").alias("h"))
    for hops in range(2, depth + 1):
        meets = (F.col("high").isNull() | (F.col("l") < F.col("high"))) & (F.col("h").isNull() | (F.col("h") > F.col("low")))
        paths = paths.join(step, "at").filter(meets).select("vertex", F.col("next").alias("at"), F.greatest("low", "l").alias("low"), later.alias("high")).distinct()
        loops = loops.unionByName(paths.filter("at = vertex").select("vertex", F.lit(hops).alias("hops")))
        paths = paths.filter("at <> vertex")
    return loops.groupBy("vertex").agg(F.min("hops").alias("hops"))


def view(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...], depth: int, least: float) -> DataFrame:
    """vertex, hops: what a view of the graph reaches from the starts, both ways: edges of its kinds and enough weight."""
    return bfs(both_ways(edges.filter(F.col("kind").isin(*kinds)).select("src", "dst", "weight")), starts, depth, least)


def provenance(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...], depth: int) -> DataFrame:
    """vertex, hops: what the starts derive from, along edges of the kinds as they point."""
    return bfs(edges.filter(F.col("kind").isin(*kinds)).select("src", "dst"), starts, depth)


def multi_hop(edges: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """vertex, score, hops: vertices around the anchors, by 1 / (1 + hops) * 1 / (1 + 0.1 w) with the weight w of the
    lightest edge that leads there in that many hops; the best score counts."""
    step = both_ways(edges.select("src", "dst", "weight"))
    seen = bfs(step, anchors, depth)
    before, here = seen.select(F.col("vertex").alias("src"), F.col("hops").alias("h")), seen.filter("hops > 0").select(F.col("vertex").alias("dst"), "hops")
    found = step.join(before, "src").join(here, "dst").filter("h + 1 = hops")
    score = F.lit(1.0) / (1 + F.col("hops")) / (1 + F.lit(0.1) * F.min("weight"))
    return found.groupBy(F.col("dst").alias("vertex"), "hops").agg(score.alias("score"))


def connectivity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean out-degree, density, vertices of over 1.5 times the mean degree, and of under half."""
    out = edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))
    degree = vertices.select("vertex").join(out, "vertex", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    by = degree.groupBy("degree").agg(F.count("*").alias("n"))  # as many rows as there are degrees
    total = by.agg(F.sum("n").alias("vertices"), F.sum(F.col("n") * F.col("degree")).alias("edges")).withColumn("mean", F.try_divide("edges", "vertices"))
    out = by.crossJoin(F.broadcast(total)).groupBy("vertices", "edges", "mean")  # total: one row
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = out.agg(some(F.col("degree") > 1.5 * F.col("mean")).alias("tight"), some(F.col("degree") < 0.5 * F.col("mean")).alias("loose"))
    return out.withColumn("density", F.try_divide(2 * F.col("edges"), F.col("vertices") * (F.col("vertices") - 1)))


def shared_neighbours(edges: DataFrame, least: int = 2) -> DataFrame:
    """a < b and how many neighbours (dst) two sources share."""
    return coactivation(edges.select(F.col("dst").alias("basket"), F.col("src").alias("item")), "basket", "item", least).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("shared"))


def bridges(edges: DataFrame) -> DataFrame:
    """vertex, paths, weight: two-edge paths through each vertex, whose ends aren't joined directly."""
    a = edges.select("src", F.col("dst").alias("vertex"), F.col("weight").alias("w1"))
    b = edges.select(F.col("src").alias("vertex"), "dst", F.col("weight").alias("w2"))
    open_ = a.join(b, "vertex").filter("src <> dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return open_.groupBy("vertex").agg(F.count("*").alias("paths"), F.sum(F.col("w1") + F.col("w2")).alias("weight"))


def strengthen(edges: DataFrame, paths: DataFrame, delta: int) -> DataFrame:
    """Edges with `delta` added for every pair of places of a path that they join; weights stay at 1 at least."""
    steps = paths.select(F.posexplode("path").alias("i", "src"), "path").select("src", F.posexplode("path").alias("j", "dst"), "i").filter("i < j")
    more = steps.groupBy("src", "dst").agg((F.count("*") * delta).alias("delta"))
    return edges.join(more, ["src", "dst"], "left").select("src", "dst", F.greatest(F.lit(1), F.col("weight") + F.coalesce("delta", F.lit(0))).alias("weight"))


def cooccurrence(mentions: DataFrame, doc: str, sentence: str, entity: str) -> DataFrame:
    """src, dst, strength: entities of one sentence are related both ways with 0.7, others of a document in order with 0.5."""
    a = mentions.select(doc, F.col(sentence).alias("_s"), F.col(entity).alias("src"))
    b = mentions.select(doc, F.col(sentence).alias("_t"), F.col(entity).alias("dst"))
    pairs = a.join(b, doc).filter("src <> dst AND _s <= _t")
    return pairs.groupBy("src", "dst").agg(F.max(F.when(F.col("_s") == F.col("_t"), 0.7).otherwise(0.5)).alias("strength"), F.count("*").alias("n"))


def capped_pairs(pairs: DataFrame, order: list, cap: int) -> DataFrame:
    """Distinct pairs (a, b, ...) taken in order, each member in at most `cap` of them: greedy by nature. In each round a
    pair is taken when it is among the first `cap` of both its members, counting those taken; pairs of full members go.
    Members are ranked on their own, so no task orders all pairs."""
    waiting, parts = stored(pairs), []
    while True:
        taken = reduce(DataFrame.unionByName, parts) if parts else None
        ends = waiting.withColumn("v", F.explode(F.array("a", "b"))).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(*order)))
        if taken is not None:
            used = taken.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("used"))
            ends = ends.join(used, "v", "left").withColumn("r", F.col("r") + F.coalesce("used", F.lit(0)))
        sure = ends.groupBy("a", "b").agg(F.max("r").alias("r")).filter(F.col("r") <= cap).select("a", "b")
        new = stored(waiting.join(sure, ["a", "b"], "left_semi"))
        if new.isEmpty():
            return taken if taken is not None else new
        parts.append(new)
        taken = reduce(DataFrame.unionByName, parts)
        full = taken.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("used")).filter(F.col("used") >= cap).select("v")
        left = waiting.join(new.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(full.withColumnRenamed("v", end), end, "left_anti")
        waiting, old = stored(left.select(*pairs.columns)), waiting
        discard(old)
