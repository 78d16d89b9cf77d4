"""Validity, supersession and access over time-stamped records and edges. Every operator takes its reference time.

Null keys are a group of their own in folds and versions and join nothing elsewhere; null times come first; ties in time go by what
follows it in the order that is given; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import predicates as P
from spindrift.sources.tables import stored


def effective_end(rows: DataFrame, key: str = "id", created: str = "created_s") -> DataFrame:
    """rows with the successor's id and the time at which it took over: a left self join on the key."""
    nxt = rows.select(F.col(key).alias("_next"), F.col(created).alias("ended_s"))
    return rows.withColumn("successor", F.coalesce("superseded_by", "merged_into")).join(nxt, F.col("successor") == F.col("_next"), "left").drop("_next")


def without_superseded(rows: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Rows that no present row supersedes. edges: old, new."""
    present = edges.join(rows.select(F.col(key).alias("new")), "new", "left_semi").select(F.col("old").alias(key))
    return rows.join(present, key, "left_anti")


def readable(rows: DataFrame, user: int, team: int, shares: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """Row-level access before any limit: the owner's, the team's, shared or granted rows, without those denied.

    shares: id, team; rules: id, subject, permission. Only semi- and anti-joins on the key."""
    shared = shares.filter(F.col("team") == team).select(key)
    granted = rules.filter((F.col("subject") == user) & F.col("permission").isin("read", "write")).select(key)
    denied = rules.filter((F.col("subject") == user) & (F.col("permission") == "none")).select(key)
    own = rows.filter((F.col("owner") == user) | (F.col("team") == team))
    other = rows.filter((F.col("owner") != user) & (F.col("team") != team)).join(shared.unionByName(granted).distinct(), key, "left_semi")
    return own.unionByName(other).join(denied, key, "left_anti")


def first_rule(rows: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """The permission of the first matching rule (by priority); rows without a rule are private."""
    first = rules.groupBy(key).agg(F.min_by("permission", "priority").alias("permission"))
    return rows.join(first, key, "left").withColumn("permission", F.coalesce("permission", F.lit("private")))


def versions(changes: DataFrame, key: list[str], at: str) -> DataFrame:
    """Recorded intervals of successive versions: each is closed by the next one of its key."""
    order = Window.partitionBy(*key).orderBy(at)
    return changes.withColumn("recorded_to", F.lead(at).over(order)).withColumn("version", F.row_number().over(order))


def as_of_each(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Latest value before each left row's time: both sides are merged by key and time, so cost is one sort by key."""
    a = left.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(key, F.col(since).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    order = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).filter("_side = 1")
    return both.select("_row.*", F.col("_last").alias(value))


def interval_conflicts(rows: DataFrame, key: str, subject: str, start: str, end: str) -> DataFrame:
    """Pairs of a subject's rows whose half-open intervals overlap; start and end aren't null.

    A running maximum of the ends finds the rows that overlap anything earlier; only those are joined to their subject."""
    w = Window.partitionBy(subject).orderBy(start, key).rowsBetween(Window.unboundedPreceding, -1)
    touched = rows.withColumn("_m", F.max(end).over(w)).filter(F.col("_m") > F.col(start))
    a = rows.select(subject, F.col(key).alias("a"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = touched.select(subject, F.col(key).alias("b"), F.col(start).alias("_t"))
    return a.join(b, subject).filter((F.struct("_s", "a") < F.struct("_t", "b")) & (F.col("_e") > F.col("_t"))).select(subject, "a", "b")


def fold_clamped(events: DataFrame, key: str, order: list[str], delta: str, start: float, low: float, high: float) -> DataFrame:
    """A running value clamped at every step. The clamp makes it a fold rather than a sum, but what several steps do together is again
    one addition and one clamp. So rows are dealt by ranges of key and order, each range of a key is folded into
    (add, low, high) inside the JVM, and those are folded in the order of the ranges: a hot key is many tasks."""

    def clamped(x, f):
        return F.least(F.greatest(x, f["low"]), f["high"])

    def then(s, f):
        return F.struct((s["add"] + f["add"]).alias("add"), clamped(s["low"] + f["add"], f).alias("low"), clamped(s["high"] + f["add"], f).alias("high"))

    def folded(steps):
        none = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
        return F.aggregate(F.transform(F.array_sort(steps), lambda x: x["f"]), none, then)

    step = F.struct(F.coalesce(F.col(delta).cast("double"), F.lit(0.0)).alias("add"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    rows = stored(events.select(key, *order, step.alias("f")).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    parts = rows.groupBy(key, "_range").agg(folded(F.collect_list(F.struct(*order, "f"))).alias("f"), F.count("*").alias("_n"))
    whole = parts.groupBy(key).agg(folded(F.collect_list(F.struct("_range", "f"))).alias("f"), F.sum("_n").alias("events"))
    return whole.select(key, clamped(F.lit(float(start)) + F.col("f.add"), F.col("f")).alias("value"), "events")


def reinforce(events: DataFrame, key: str, at: str, kind: str, cooldown: float = 3600, gain: float = 0.1, cap: float = 0.15, fade: float = 0.85, loss: float = 0.3) -> DataFrame:
    """key, confidence, stability: an ordered fold per key. Support within the cooldown of the last one counts nothing;
    the n-th support gains gain * fade^n up to the cap in all; a contradiction costs loss; each support adds stability."""

    def fold(pdf):
        pdf = pdf.sort_values([at, kind])
        confidence, gained, n, stability, last = 0.5, 0.0, 0, 0.0, None
        for t, k in zip(pdf[at].astype("int64") / 1e9 if str(pdf[at].dtype).startswith("datetime") else pdf[at], pdf[kind]):
            if k == "contradict":
                confidence = max(0.0, confidence - loss)
            elif last is None or t - last >= cooldown:
                step = min(gain * fade**n, cap - gained)
                confidence, gained, n, stability, last = min(1.0, confidence + step), gained + step, n + 1, min(1.0, stability + 0.05), t
        out = pdf.head(1)[[key]].copy()
        out["confidence"], out["stability"] = confidence, stability
        return out

    return events.select(key, at, kind).groupBy(key).applyInPandas(fold, f"{key} {events.schema[key].dataType.simpleString()}, confidence double, stability double")
