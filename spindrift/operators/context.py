"""Fitting records into budgets: packing, chunks, compression, summaries and line differences.

Rows are taken in a stated order whose ties go to the least key; a null text is as long as none; an empty table gives no
rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text


def fit_budget(rows: DataFrame, group: str, key: str, size: str, order: str, pinned: str, budget: int) -> DataFrame:
    """group, key, place: pinned rows first (they may exceed the budget), then by descending order the rows that still fit;
    a row that doesn't fit is skipped and the next one tried. That isn't a running sum, but it is a fold: sizes are
    folded in order inside the JVM, group by group."""
    items = F.array_sort(F.collect_list(F.struct((~F.col(pinned)).alias("p"), (-F.col(order)).alias("o"), F.col(key).alias("k"), F.col(size).cast("long").alias("s"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>").alias("keys"))

    def step(state, x):
        fits = (~x["p"]) | (state["used"] + x["s"] <= budget)
        return F.struct(F.when(fits, state["used"] + x["s"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["keys"], F.array(x["k"]))).otherwise(state["keys"]).alias("keys"))

    packed = rows.groupBy(group).agg(F.aggregate(items, start, step)["keys"].alias("keys"))
    return packed.select(group, F.posexplode("keys").alias("place", key)).select(group, key, (F.col("place") + 1).alias("place"))


def section_windows(rows: DataFrame, section: str, size: str, order: list[Column], shares: dict[str, float], total: int) -> DataFrame:
    """Rows of each section as long as the running size stays within the section's share of the budget."""
    limit = F.lit(0.0)
    for name, share in shares.items():
        limit = F.when(F.col(section) == name, F.lit(share * total)).otherwise(limit)
    running = F.sum(size).over(Window.partitionBy(section).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).filter(F.col("used") <= limit)


def chunks(rows: DataFrame, session: str, kind: Column, order: list[str], caps: dict[str, int], content: str, most: int = 500) -> DataFrame:
    """The first rows of each kind in a session, up to the kind's cap, with their heads."""
    cap = F.lit(0)
    for name, n in caps.items():
        cap = F.when(F.col("chunk") == name, n).otherwise(cap)
    own = rows.withColumn("chunk", kind)
    nth = F.row_number().over(Window.partitionBy(session, "chunk").orderBy(*order))
    return own.withColumn("nth", nth).filter(F.col("nth") <= cap).withColumn("head", F.substring(content, 1, most))


def compress(content: Column) -> Column:
    """By length: up to 100 characters unchanged, to 500, to 2000 and beyond the first 80, 60 and 40 of every line."""
    n = F.length(content)
    heads = lambda k: F.array_join(F.transform(F.split(content, "\n"), lambda x: F.substring(x, 1, k)), "\n")
    return F.when(n <= 100, content).when(n <= 500, F.substring(heads(80), 1, 300)).when(n <= 2000, F.substring(heads(60), 1, 300)).otherwise(F.substring(heads(40), 1, 150))


def rolling(rows: DataFrame, session: str, order: str, content: str, last: int, head: int = 60) -> DataFrame:
    """With every row the heads of the session's last rows up to it."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-(last - 1), 0)
    return rows.withColumn("summary", F.array_join(F.collect_list(F.substring(content, 1, head)).over(w), " | "))


def fixed_chunks(rows: DataFrame, session: str, order: str, content: str, size: int, head: int = 60) -> DataFrame:
    """session, chunk, summary: consecutive rows in chunks of a fixed size."""
    nth = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    own = rows.withColumn("chunk", F.floor(nth / size)).select(session, "chunk", F.struct(F.col(order).alias("o"), F.substring(content, 1, head).alias("h")).alias("x"))
    return own.groupBy(session, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), " | ").alias("summary"))


def line_difference(before: Column, after: Column) -> tuple[Column, Column]:
    """Lines of `after` that aren't in `before`, and the reverse, in order and with repeats."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    return F.filter(b, lambda x: ~F.array_contains(a, x)), F.filter(a, lambda x: ~F.array_contains(b, x))


def pack_response(rows: DataFrame, query: str, key: str, content: str, score: str, floor: float, budget: int) -> DataFrame:
    """query, key, content, status: rows over the floor by descending score until the budget of estimated tokens is met;
    the row that would exceed it is cut at a word. status: ok, partial (something is missing) or none."""
    size = text.tokens(F.col(content), 3)
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    good = rows.withColumn("_ok", F.col(score) >= floor)
    used = good.filter("_ok").withColumn("_n", size).withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("_before")
    cut = F.regexp_replace(F.substring(content, F.lit(1), (left * 3).cast("int")), r"\s+\S*$", "")
    some = used.filter(left > 0).withColumn("_cut", F.col("_n") > left).withColumn(content, F.when(F.col("_cut"), cut).otherwise(F.col(content)))
    totals = good.groupBy(query).agg(F.sum(F.when(F.col("_ok"), size)).alias("_all"))
    status = F.when(F.col("_all").isNull(), "none").when(F.col("_all") > budget, "partial").otherwise("ok")
    return totals.join(some.select(query, key, content), query, "left").select(query, key, content, status.alias("status"))
