"""Recall for a whole table of queries at once: legs, fusion, boosts, gate and verdict in one plan, and what widens it.

Queries are a table (query, ...), joined by word or by the keys of results; nothing is looped over on the driver. Ranks
are row numbers within a query, which Spark limits before its shuffle. Null texts hold no words and match nothing; a
query without results gives no rows; ties go to the least id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import scoring, text, topics, vectors
from spindrift.operators import search
from spindrift.sources.tables import stored

# Synonyms that widen a query, three for each word.
SYNONYMS = {
    "fix": ("resolve", "patch", "repair"), "bug": ("issue", "error", "problem"), "debug": ("troubleshoot", "diagnose", "investigate"),
    "test": ("verify", "validate", "check"), "testing": ("verification", "validation", "quality assurance"),
    "implement": ("build", "create", "develop"), "build": ("implement", "construct", "assemble"), "create": ("implement", "generate", "produce"),
    "refactor": ("restructure", "reorganize", "clean"), "restructure": ("refactor", "reorganize", "rebuild"),
    "document": ("describe", "annotate", "record"), "documentation": ("description", "annotation", "records"),
    "optimize": ("improve", "enhance", "speed up"), "performance": ("speed", "efficiency", "optimization"),
    "design": ("architect", "plan", "structure"), "architecture": ("structure", "design", "framework"),
    "update": ("modify", "change", "revise"), "modify": ("update", "change", "alter"),
    "delete": ("remove", "eliminate", "purge"), "remove": ("delete", "eliminate", "strip"),
    "fetch": ("retrieve", "get", "load"), "retrieve": ("fetch", "get", "obtain"), "store": ("save", "persist", "cache"), "save": ("store", "persist", "write"),
}


def terms(content: Column, least: int = 3) -> Column:
    """Distinct words of at least `least` characters that aren't stopwords."""
    return F.array_distinct(F.filter(text.words(F.coalesce(content, F.lit(""))), lambda w: (F.length(w) >= least) & ~w.isin(*sorted(text.STOPWORDS))))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """Each query's first k rows, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def lexical_leg(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, id, lexical, rank: the rows (id, content) that hold the largest share of a query's terms (query, content).
    Words of rows are made distinct and kept only if some query has them, before anything is counted."""
    asked = queries.select("query", F.explode(terms(F.col("content"))).alias("w"), F.size(terms(F.col("content"))).alias("n"))
    held = rows.select("id", F.explode(terms(F.col("content"))).alias("w"))
    hits = held.join(asked, "w").groupBy("query", "id", "n").agg(F.count("*").alias("hits"))
    return top(hits, k, F.desc("hits"), F.asc("id")).select("query", "id", (F.col("hits") / F.col("n")).alias("lexical"), "rank")


def fused(legs: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """query, id, fused (relative to the query's best), place: reciprocal rank fusion within each query."""
    sums = reduce(DataFrame.unionByName, (x.select("query", "id", "rank") for x in legs)).groupBy("query", "id").agg(F.sum(1 / (constant + F.col("rank"))).alias("rrf"))
    kept = top(sums, k, F.desc(vectors.bucket(F.col("rrf"))), F.asc("id"))
    return kept.select("query", "id", (F.col("rrf") / F.max("rrf").over(Window.partitionBy("query"))).alias("fused"), F.col("rank").alias("place"))


def recall(queries: DataFrame, rows: DataFrame, vector_leg: DataFrame, at_s: int, k: int = 10, pool: int = 20, floor: float = 0.1) -> DataFrame:
    """query, id, place, final, confidence, tier, verdict, aligned, unstated. queries: query, content; rows: id, content, created_s,
    next_id (the successor, or null), level, conflict; vector_leg: query, id, semantic, rank.

    Legs are fused; recency is added and a superseded row loses 0.5, and goes if its successor is among the query's
    results; queries whose best cosine is under `floor` give nothing; confidence is calibrated from the legs and from
    whether a result's topic is the query's, which never changes the order."""
    vector_leg, lexical = stored(vector_leg), stored(lexical_leg(queries, rows, pool))  # short, and read several times
    found = fused([vector_leg, lexical], pool).join(vector_leg.select("query", "id", "semantic"), ["query", "id"], "left")
    found = found.join(lexical.select("query", "id", "lexical", F.col("rank").alias("lexical_rank")), ["query", "id"], "left").join(rows.drop("content"), "id")
    beaten = found.filter("next_id IS NOT NULL").select("query", "id", F.col("next_id").alias("other")).join(found.select("query", F.col("id").alias("other")), ["query", "other"], "left_semi")
    found = found.join(beaten.select("query", "id"), ["query", "id"], "left_anti")
    boost = scoring.recency_boost((at_s - F.col("created_s")) / 3600) + F.when(F.col("next_id").isNotNull(), -0.5).otherwise(0.0)
    found = found.withColumn("final", scoring.clamp(F.col("fused") + boost))
    found = top(found, k, F.desc(vectors.bucket(F.col("final"))), F.asc("place"))
    near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("semantic"), "id"))
    query = Window.partitionBy("query")
    found = found.withColumn("r", near).withColumns({"n": F.count("*").over(query), "best": F.max("semantic").over(query), "second": F.max(F.when(F.col("r") == 2, F.col("semantic"))).over(query)})
    fresh = F.pow(F.lit(2.0), -((at_s - F.col("created_s")) / 86400) / 365)
    found = topical(queries, stored(found.filter(F.coalesce(F.col("best") >= floor, F.lit(False)))), rows)
    found = found.join(lexical.select("query").distinct().withColumn("multi", F.lit(True)), "query", "left")
    topic = scoring.topical_factor(F.col("aligned"), F.col("absent"), F.col("unstated"))
    confidence = scoring.recall_confidence(F.col("semantic"), F.col("lexical_rank"), F.col("lexical"), F.lit(0.0), F.col("best") - F.col("second"), F.col("n"), F.col("best"), fresh, F.col("level"), F.col("conflict"), F.col("multi"), topic)
    found = found.withColumn("confidence", confidence).withColumn("sure", F.max("confidence").over(query))
    verdict = F.when(F.col("sure") < 0.6, "none").when(F.col("sure") >= 0.9, "confident").otherwise("qualified")
    return found.select("query", "id", F.col("rank").alias("place"), "final", "confidence", scoring.confidence_tier(F.col("confidence")).alias("tier"), verdict.alias("verdict"), "aligned", "unstated")


def expanded(queries: DataFrame, most: int = 3) -> DataFrame:
    """query, n, content: each query itself (0) and up to `most` variants with one word replaced by a synonym, the first
    synonym of each of its words before any second. The list of synonyms is fixed and short."""
    spark = queries.sparkSession
    known = spark.createDataFrame([(w, i, s) for w, all_ in SYNONYMS.items() for i, s in enumerate(all_)], "w string, turn int, synonym string")
    asked = queries.select("query", "content", F.posexplode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("at", "w")).join(F.broadcast(known), "w")
    swapped = F.regexp_replace("content", F.concat(F.lit(text.ascii_bounds(r"(?i)\b")), F.col("w"), F.lit(text.ascii_bounds(r"\b"))), F.col("synonym"))
    made = asked.select("query", "turn", "at", swapped.alias("content"), F.col("content").alias("own")).filter("content <> own")
    first = made.groupBy("query", "content").agg(F.min(F.struct("turn", "at")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("o.turn", "o.at"))
    return queries.select("query", F.lit(0).alias("n"), "content").unionByName(first.withColumn("n", rank).filter(F.col("n") <= most).select("query", "n", "content"))


def merged_hits(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """query, id, score: the union of searches (query, id, score), each with its factor, with the best score of a row."""
    scaled = (rows.select("query", "id", (F.col("score") * factor).alias("score")) for rows, factor in parts)
    return reduce(DataFrame.unionByName, scaled).groupBy("query", "id").agg(F.max("score").alias("score"))


def associated(results: DataFrame, edges: DataFrame, seeds: int = 3, each: int = 5) -> DataFrame:
    """query, id, via, weight: the heaviest neighbours of a query's first results (query, id, rank) that aren't results."""
    step = edges.select(F.col("src").alias("via"), F.col("dst").alias("id"), "weight")
    step = step.unionByName(edges.select(F.col("dst").alias("via"), F.col("src").alias("id"), "weight"))
    near = results.filter(F.col("rank") <= seeds).select("query", F.col("id").alias("via")).join(step, "via").join(results.select("query", "id"), ["query", "id"], "left_anti")
    order = Window.partitionBy("query", "via").orderBy(F.desc("weight"), "id")
    return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("query", "id", "via", "weight")


def evidence(results: DataFrame, rows: DataFrame, edges: DataFrame, age_days: Column) -> DataFrame:
    """query, id, level, supports, conflicts, retention of results: edges (src, dst, kind) at either end are counted."""
    ends = edges.select(F.col("src").alias("id"), "kind").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("id"), "kind"))
    ends = ends.join(results.select("id").distinct(), "id", "left_semi").groupBy("id")
    counted = ends.agg(F.count_if(F.col("kind") == "supports").alias("supports"), F.count_if(F.col("kind") == "contradicts").alias("conflicts"))
    own = rows.select("id", "level", scoring.retention(age_days, F.col("kind")).alias("retention"))
    out = results.join(own, "id").join(counted, "id", "left")
    return out.select("query", "id", "level", F.coalesce("supports", F.lit(0)).alias("supports"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "retention")


def topical(queries: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """found (query, id, ...) with aligned (0, 0.7, 1 or null), absent (all of a query's known alignments are 0) and unstated:
    the query asks for a known attribute, and none of its results about its entity (of all, if it has none) states it."""
    read = queries.select("query", topics.asked(F.col("content")).alias("_q")).filter("_q.entity IS NOT NULL OR _q.attribute IS NOT NULL")
    texts = rows.select("id", F.col("content").alias("_text")).join(found.select("id").distinct(), "id")
    own = found.join(read, "query", "left").join(texts, "id", "left").withColumn("_m", topics.stated(F.col("_text")))
    q, m, query = F.col("_q"), F.col("_m"), Window.partitionBy("query")
    said = F.coalesce(F.trim("_text") != "", F.lit(False))
    about = F.coalesce(F.when(q["entity"].isNull(), said).otherwise(topics.same_entity(q["entity"], m["entity"])), F.lit(False))
    own = own.withColumn("_about", q["attribute"].isin(*topics.ATTRIBUTES) & about)
    own = own.withColumn("_states", F.col("_about") & topics.carries(F.col("_text"), q["attribute"])).withColumn("aligned", topics.alignment(q, m, F.col("_text")))
    own = own.withColumn("absent", F.coalesce(F.max("aligned").over(query) == 0, F.lit(False)))
    own = own.withColumn("unstated", F.coalesce(F.col("_about"), F.lit(False)) & ~F.coalesce(F.max("_states").over(query), F.lit(False)))
    return own.drop("_q", "_m", "_text", "_about", "_states")


def serving(semantic: Column, importance: Column, recency: Column, relevance: float, recency_weight: float, importance_weight: float) -> Column:
    """What serving weights add to a score: nothing at the neutral weights 3, 0.5 and 0."""
    return F.coalesce(semantic, F.lit(0.0)) * (relevance / 3 - 1) + F.coalesce(recency, F.lit(0.0)) * (recency_weight / 0.5 - 1) + F.coalesce(importance, F.lit(0.0)) * importance_weight


def beliefs(rows: DataFrame, asked: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """query, id, score, rank: the k best of each query's beliefs (rows: key, vector, confidence): the cosine counts half to
    whole with confidence. asked: the table with the queries' vectors. Tasks keep k of their rows a query, so nothing near
    queries x rows is written."""
    scaled = rows.withColumn("_weight", 0.5 + 0.5 * scoring.clamp(F.coalesce("confidence", F.lit(0.5))))
    return search.vector_leg(scaled, queries, k, key, vector, "_weight", asked=asked).withColumnRenamed("semantic", "score")


def contains_search(rows: DataFrame, phrase: str, *columns: str) -> DataFrame:
    """Rows whose columns hold a phrase, whatever its case."""
    return rows.filter(reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(phrase.lower()), F.lit(False)) for c in columns)))


def index_search(rows: DataFrame, words: list[str], k: int) -> DataFrame:
    """The k best index rows (id, preview, key_terms, importance): 10 for each word in the preview and 15 for each that a
    key term holds. All rows are scored before the limit."""
    hit = lambda w: 10 * F.coalesce(F.lower("preview").contains(w).cast("int"), F.lit(0)) + 15 * F.coalesce(F.exists("key_terms", lambda t: F.lower(t).contains(w)).cast("int"), F.lit(0))
    score = reduce(lambda a, b: a + b, map(hit, words), F.coalesce("importance", F.lit(50)))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def with_fallback(queries: DataFrame, results: DataFrame, rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """query, id, fallback: results, and for queries without any the first k rows in a fixed order (a list of k rows, so
    that the product with the queries is bounded)."""
    none = queries.select("query").join(results.select("query"), "query", "left_anti")
    newest = rows.orderBy(*order).limit(k).select("id")
    return results.select("query", "id", F.lit(False).alias("fallback")).unionByName(none.crossJoin(F.broadcast(newest)).withColumn("fallback", F.lit(True)))


def context_prefix(kind: Column, project: Column, topics: Column, most: int = 120) -> Column:
    """[kind] from [project] about up to three topics, cut to `most` characters."""
    about = F.when(F.size(topics) > 0, F.array_join(F.slice(topics, 1, 3), ", ")).otherwise("general")
    out = F.concat(F.lit("["), F.coalesce(kind, F.lit("memory")), F.lit("] from "), F.coalesce(project, F.lit("unknown")), F.lit(" about "), about)
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def useful_score(correct: Column, grounded: Column, stale: Column, abstain: Column) -> Column:
    """1 for a right answer, 0.5 if grounded, -2 if stale; where no answer was due, 0.5 for none and -0.5 for one."""
    points = lambda c, n: F.when(c, n).otherwise(0.0)
    return points(correct, 1.0) + points(grounded, 0.5) - points(stale, 2.0) + F.when(abstain, F.when(correct, -0.5).otherwise(0.5)).otherwise(0.0)
