"""A balanced tree of summaries over every session's records in time, and a view of it that fits a budget.

A session's records are placed by time and key; a node is a range of places, halved until it holds one record. Levels are
built from the deepest up: the two children of a node meet in one grouping, and each level has half the rows of the
last. A node's summary is the beginning of its records' first sentences.

A view begins with the root (or any node) and replaces nodes by their children, the newest first, while the estimated tokens of all
that is shown stay within the budget; what doesn't fit once never fits later, so each node is tried once. Records are
shown with their text; that of the last one may be cut. Sessions of any length keep bounded state: the tree is read
in pages of six levels, and a session asks for the page that it needs next.

Defined results: records without a time come first; equal times go by key; null texts are empty; of rows with the same key in a
session the one of the latest time (then the greatest text) counts; rows without a session or key are in no tree; an empty
table has no nodes. A budget under that of the root shows the root alone, a record's text cut to nothing.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.tables import stored

PREVIEW = 96
#: Tokens of a node without its texts, and of a view without nodes.
NODE_TOKENS, VIEW_TOKENS = 40, 32
PAGE_LEVELS = 6


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with place (0, 1, ...) and n (their number) within each group. Rows are ordered by ranges, and the counts of the
    ranges before are added to a range's own places, so that a group of any size is spread over tasks."""
    spread = stored(rows.repartitionByRange(*(F.asc_nulls_first(c) for c in (group, *order))).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", group).orderBy(*(F.asc_nulls_first(c) for c in order))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(group, "_range").agg(F.count("*").alias("_own"))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_own").over(before), F.lit(0)), "n": F.sum("_own").over(Window.partitionBy(group))})
    counts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_before", "n")
    out = spread.withColumn("_nth", F.row_number().over(own) - 1).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("place", (F.col("_before") + F.col("_nth")).cast("long")).drop("_range", "_nth", "_before", "_g", "_r")


def descended(n: Column, place: Column, steps: Column) -> Column:
    """lo, hi, depth of the node that holds the place, that many steps below the root of n places (or its leaf, if that is nearer)."""

    def half(a: Column, _: Column) -> Column:
        mid = a["lo"] + F.floor((a["hi"] - a["lo"]) / 2)
        lower = place < mid
        below = F.struct(F.when(lower, a["lo"]).otherwise(mid).alias("lo"), F.when(lower, mid).otherwise(a["hi"]).alias("hi"), (a["depth"] + 1).alias("depth"))
        return F.when(a["hi"] - a["lo"] > 1, below).otherwise(a)

    root = F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi"), F.lit(0).alias("depth"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), root, half)


def preview(content: Column) -> Column:
    """The first sentence of at most 240 characters, else the beginning; cut at PREVIEW characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    sentence = F.regexp_extract(flat, r"^.{1,240}?(?:[.!?](?: |$)|$)", 0)
    return F.substring(F.when(sentence == "", flat).otherwise(sentence), 1, PREVIEW)


def _records(rows: DataFrame, session: str, key: str, at: Column, content: str) -> DataFrame:
    """session, key, at, content: one row for each record."""
    own = rows.select(F.col(session).alias("session"), F.col(key).alias("key"), F.struct(at.alias("at"), F.coalesce(F.col(content), F.lit("")).alias("content")).alias("x"))
    return own.filter("session IS NOT NULL AND key IS NOT NULL").groupBy("session", "key").agg(F.max("x").alias("x")).select("session", "key", "x.at", "x.content")


def tree(rows: DataFrame, session: str, key: str, at: str, content: str) -> DataFrame:
    """session, n, depth, lo, hi, node (its id), key (of a leaf), preview, start_at, end_at, text_tokens (of a leaf), shown (tokens
    without texts) and delta: what showing a node's children costs more than showing it, without texts; null of a leaf."""
    own = placed(_records(rows, session, key, F.col(at), content), "session", "at", "key")
    leaf = descended(F.col("n"), F.col("place"), F.length(F.bin("n")))
    name = F.sha2(F.concat_ws("\x1f", F.lit("record"), F.col("session").cast("string"), F.col("key").cast("string"), F.coalesce(F.col("at").cast("string"), F.lit("")), "content"), 256)
    leaves = own.withColumn("_leaf", leaf).select(
        "session", "n", "_leaf.depth", "_leaf.lo", "_leaf.hi", name.alias("node"), "key", preview(F.col("content")).alias("preview"), F.col("at").alias("start_at"), F.col("at").alias("end_at"),
        F.ceil(F.length("content") / 4).cast("long").alias("text_tokens"),
    )
    leaves = stored(leaves.withColumn("shown", NODE_TOKENS + F.ceil(F.length("preview") / 4)).withColumn("delta", F.lit(None).cast("long")))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels = [leaves.filter(F.col("depth") == deepest)]
    for depth in range(deepest, 0, -1):
        parent = descended(F.col("n"), F.col("lo"), F.lit(depth - 1))
        pairs = levels[-1].withColumn("_p", parent).groupBy("session", "n", F.col("_p.lo").alias("lo"), F.col("_p.hi").alias("hi"))
        side = lambda f, c: f(c, "lo")
        joined = F.concat_ws(" | ", side(F.min_by, "preview"), side(F.max_by, "preview"))
        above = pairs.agg(
            F.sha2(F.concat_ws("\x1f", F.lit("summary"), side(F.min_by, "node"), side(F.max_by, "node")), 256).alias("node"), F.substring(joined, 1, PREVIEW).alias("preview"),
            side(F.min_by, "start_at").alias("start_at"), side(F.max_by, "end_at").alias("end_at"), F.sum("shown").alias("_children"),
        )
        above = above.withColumn("shown", NODE_TOKENS + F.ceil(F.length("preview") / 4)).withColumn("delta", F.col("_children") - F.col("shown"))
        own_leaves = leaves.filter(F.col("depth") == depth - 1)
        up = above.select("session", "n", F.lit(depth - 1).alias("depth"), "lo", "hi", "node", F.lit(None).cast(leaves.schema["key"].dataType).alias("key"), "preview", "start_at", "end_at", F.lit(0).cast("long").alias("text_tokens"), "shown", "delta")
        levels.append(stored(up.unionByName(own_leaves.select(up.columns))))
    return reduce(DataFrame.unionByName, levels)


NODE = "struct<depth: int, lo: bigint, hi: bigint, delta: bigint, text: bigint>"
STATE = "left bigint, stack array<struct<depth: int, lo: bigint, hi: bigint>>, known array<" + NODE + ">, cover array<struct<lo: bigint, hi: bigint, cut: bigint>>, page_depth int, page_lo bigint"


def _advance(left: int, stack: list, known: list, cover: list, page: list):
    """Expand nodes, the newest first, as long as those that are looked at are known. The state, and the page it stops at."""
    at = {(x["lo"], x["hi"]): x for x in (*(known or ()), *(page or ()))}
    stack, cover = list(stack), list(cover)
    while stack:
        top = stack[-1]
        own = at.get((top["lo"], top["hi"]))
        mid = top["lo"] + (top["hi"] - top["lo"]) // 2
        parts = [(top["lo"], mid), (mid, top["hi"])] if own and own["delta"] is not None else []
        leaves = [p for p in parts if p[1] - p[0] == 1]
        missing = next((p for p in leaves if p not in at), None)
        if own is None or missing:  # in a page of its own, whose first node it is
            return left, stack, list(at.values()), cover, {"depth": top["depth"] + 1, "lo": missing[0]} if missing else top
        stack.pop()
        del at[top["lo"], top["hi"]]
        texts = sum(at[p]["text"] for p in leaves)
        spare = at[leaves[0]]["text"] if leaves else 0  # the older text may be cut
        if parts and own["delta"] + texts - spare <= left:
            cut = max(0, own["delta"] + texts - left)
            left -= own["delta"] + texts - cut
            for p in leaves:
                cover.append({"lo": p[0], "hi": p[1], "cut": cut if p == leaves[0] else 0})
                del at[p]
            stack += [{"depth": top["depth"] + 1, "lo": a, "hi": b} for a, b in parts if b - a > 1]
        else:
            cover.append({"lo": top["lo"], "hi": top["hi"], "cut": 0})
            at = {k: x for k, x in at.items() if not (top["lo"] <= k[0] and k[1] <= top["hi"])}
    return left, [], [], cover, None


def view(nodes: DataFrame, budget: int, roots: DataFrame | None = None) -> DataFrame:
    """session, lo, hi, cut of the nodes that are shown: cut is how many tokens of a record's text don't fit.

    nodes: a tree; roots: session and node of where each session's view begins (at most one a session); None: at its root."""
    begin = nodes.filter("depth = 0") if roots is None else nodes.join(roots.select("session", "node"), ["session", "node"])
    page_of = lambda depth, lo: descended(F.col("n"), lo, (depth - depth % PAGE_LEVELS).cast("int"))
    paged = nodes.withColumn("_page", page_of(F.col("depth"), F.col("lo")))
    item = F.struct("depth", "lo", "hi", "delta", F.col("text_tokens").alias("text"))
    pages = stored(paged.groupBy("session", F.col("_page.depth").alias("page_depth"), F.col("_page.lo").alias("page_lo")).agg(F.collect_list(item).alias("page")))
    lone = F.col("hi") - F.col("lo") == 1
    own_text = F.when(lone, F.col("text_tokens")).otherwise(0)
    left = F.lit(budget - VIEW_TOKENS) - F.col("shown")
    stack = F.when(lone, F.array().cast("array<struct<depth: int, lo: bigint, hi: bigint>>")).otherwise(F.array(F.struct("depth", "lo", "hi")))
    cover = F.when(lone, F.array(F.struct("lo", "hi", F.greatest(F.lit(0).cast("long"), own_text - F.greatest(left, F.lit(0))).alias("cut")))).otherwise(F.array().cast("array<struct<lo: bigint, hi: bigint, cut: bigint>>"))
    first = begin.withColumn("_page", page_of(F.col("depth"), F.col("lo")))
    state = stored(first.select("session", left.cast("bigint").alias("left"), stack.alias("stack"), F.array().cast(f"array<{NODE}>").alias("known"), cover.alias("cover"), F.col("_page.depth").alias("page_depth"), F.col("_page.lo").alias("page_lo")))
    schema = f"session {nodes.schema['session'].dataType.simpleString()}, {STATE}"
    kinds = state.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            out = []
            for r in b.to_pylist():
                left, stack, known, cover, want = _advance(r["left"], r["stack"], r["known"], r["cover"], r["page"])
                out.append({"session": r["session"], "left": left, "stack": stack, "known": known, "cover": cover, "page_depth": want and want["depth"], "page_lo": want and want["lo"]})
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(kinds))

    done = [state.filter(F.size("stack") == 0)]
    state = state.filter(F.size("stack") > 0)
    while not state.isEmpty():
        step = stored(state.join(pages, ["session", "page_depth", "page_lo"], "left").mapInArrow(run, schema))
        done.append(step.filter("page_lo IS NULL"))
        state = step.filter("page_lo IS NOT NULL")
    found = reduce(DataFrame.unionByName, [d.select("session", F.explode("cover").alias("c")) for d in done])
    return found.select("session", "c.lo", "c.hi", "c.cut")


def shown(nodes: DataFrame, rows: DataFrame, session: str, key: str, at: str, content: str, budget: int, roots: DataFrame | None = None) -> DataFrame:
    """session, lo, hi, sources, preview, start_at, end_at, and of a record key, text and truncated: a view with its texts."""
    items = nodes.join(view(nodes, budget, roots), ["session", "lo", "hi"])
    texts = _records(rows, session, key, F.col(at), content).select("session", "key", F.col("content").alias("text"))
    kept = F.substring("text", F.lit(1), ((F.ceil(F.length("text") / 4) - F.col("cut")) * 4).cast("int"))
    whole = items.join(texts, ["session", "key"], "left").withColumn("text", F.when(F.col("cut") > 0, kept).otherwise(F.col("text")))
    return whole.select("session", "lo", "hi", (F.col("hi") - F.col("lo")).alias("sources"), "preview", "start_at", "end_at", "key", "text", (F.col("cut") > 0).alias("truncated"))
