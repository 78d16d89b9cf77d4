"""Search over records: vector and lexical legs, rank fusion, itemised boosts and final ranking. DataFrame in, DataFrame out.

Rows are ordered by millionths of a score, then content, then id, so equal scores rank alike on every run. A top-k
without a key is an ordered limit (each task keeps k rows); with a key it is a row number, which Spark also limits
before its shuffle. Null texts hold no words and no terms; rows without a vector, or with one of another dimension, are
skipped; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import scoring, text, vectors
from spindrift.sources.tables import stored


def vector_top_k(rows: DataFrame, vector: str, query: list[float], k: int, *ties: str) -> DataFrame:
    """The k rows most similar to a fixed vector; rows of another dimension are skipped."""
    if not query:
        return rows.withColumn("similarity", F.lit(None).cast("double")).limit(0)
    scored = rows.filter(F.size(vector) == len(query)).withColumn("similarity", vectors.cosine_constant(F.col(vector), query))
    return scored.orderBy(F.desc(vectors.bucket(F.col("similarity"))), *ties).limit(k)


def newest(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def budgeted_window(rows: DataFrame, own: Column, order: list[Column], window: int) -> DataFrame:
    """The newest `window` rows of the project and max(10, window / 4) of the others."""
    return newest(rows.filter(own), window, *order).unionByName(newest(rows.filter(~own), max(10, window // 4), *order))


#: Queries whose vectors are held at once, by the driver and by each task.
QUERY_BLOCK = 4096


def vector_leg(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", weight: str | None = None, block: int = QUERY_BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """query, id, semantic, rank: the k nearest rows to each query (query), whose vector is that of its key in `asked` (or rows).

    Queries may be any number: they are dealt to blocks of about `block` by hash, and each block is one pass over the rows, in
    which only its vectors are held; beyond one block, each block's result is written before the next is read."""
    asked = (rows if asked is None else asked).join(queries.select(F.col("query").alias(key)).distinct(), key, "left_semi").select(key, vector)
    blocks = -(-queries.count() // block)
    if blocks > 1:
        asked = stored(asked.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))))
    found = []
    for i in range(max(1, blocks)):
        own = asked.filter(F.col("_block") == i) if blocks > 1 else asked
        part = batch_top_k(rows, key, vector, [(r[0], [float(x) for x in r[1]]) for r in own.select(key, vector).toLocalIterator()], k, weight=weight)
        found.append(stored(part) if blocks > 1 else part)
    out = reduce(DataFrame.unionByName, found)
    return out.select("query", F.col("key").alias("id"), F.col("similarity").alias("semantic"), F.col("rank").cast("long").alias("rank"))


def batch_top_k(rows: DataFrame, key: str, vector: str, queries: list[tuple[int, list[float]]], k: int, block: int = 4096, weight: str | None = None) -> DataFrame:
    """query, key, similarity: each query's k most similar rows. Queries are a stated, bounded list; each task makes one
    matrix product per block of rows, keeps k rows a query, and the partial lists are merged by a row number. weight: a column
    of rows that multiplies the cosine, which is then cut to between 0 and 1; the product is what counts as similarity."""
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                v = np.array(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                own = np.array(part.column(0))
                sims = matrix @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                if weight:
                    sims = np.clip(sims, 0.0, 1.0) * np.array(part.column(2), np.float64)
                for q in range(len(ids)):
                    order = np.lexsort((own, -np.floor(sims[q] * 1e6 + 0.5)))[: k + 1]
                    merged = best[q] + [(float(sims[q, i]), int(own[i])) for i in order]
                    best[q] = sorted(merged, key=lambda x: (-np.floor(x[0] * 1e6 + 0.5), x[1]))[: k + 1]
        flat = [(int(ids[q]), i, s) for q in range(len(ids)) for s, i in best[q] if i != ids[q]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["query", "key", "similarity"])

    own = rows.filter(F.col(key).isNotNull() & (F.size(vector) == matrix.shape[1]))
    own = own.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"), *([F.col(weight).cast("double")] if weight else []))
    found = own.mapInArrow(run, "query long, key long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(vectors.bucket(F.col("similarity"))), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def batch_at_least(rows: DataFrame, key: str, vector: str, queries: list[tuple[int, list[float]]], least: float, block: int = 4096) -> DataFrame:
    """query, key, similarity: every row at or above a similarity to each query, itself aside. Queries are a stated,
    bounded list; each task makes one matrix product per block of rows and writes what it finds in each."""
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                v = np.array(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                own = np.array(part.column(0))
                sims = matrix @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                q, i = np.nonzero((sims >= least) & (ids[:, None] != own[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[i], pa.int64()), pa.array(sims[q, i])], ["query", "key", "similarity"])

    own = rows.filter(F.col(key).isNotNull() & (F.size(vector) == matrix.shape[1])).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return own.mapInArrow(run, "query long, key long, similarity double")


def lexical_top_k(rows: DataFrame, content: str, terms: list[str], k: int, *ties: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Share of the terms found; rows with an excluded term go, and rows without any term."""
    scored = rows.withColumn("score", text.matched_share(F.col(content), terms)).filter("score > 0")
    for t in exclude:
        scored = scored.filter(~F.lower(content).contains(t))
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def bm25(rows: DataFrame, key: str, content: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, bm25 of rows with a term. Texts are cut into words once; the lengths and counts, a small row for each text, are
    written, and totals and scores are read from there. Null texts have no words."""
    cut = F.split(F.lower(F.coalesce(content, F.lit(""))), "[^a-z0-9_]+")
    own = rows.select(key, cut.alias("_w"))
    empty = F.size("_w") - F.size(F.array_remove("_w", ""))
    tf = stored(own.select(key, (F.size("_w") - empty).alias("n"), *((F.size("_w") - F.size(F.array_remove("_w", t))).alias(f"tf{i}") for i, t in enumerate(terms))))
    totals = tf.agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        count, df = F.col(f"tf{i}"), F.col(f"df{i}")
        return F.log(1 + (F.col("rows") - df + 0.5) / (df + 0.5)) * count * (k1 + 1) / (count + k1 * (1 - b + b * F.col("n") / F.col("mean")))

    hit = reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    return tf.filter(hit).crossJoin(F.broadcast(totals)).select(key, reduce(lambda x, y: x + y, map(part, range(len(terms)))).alias("bm25"))  # totals: one row


def fuse(legs: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs (key, rank): sum of 1 / (60 + rank), divided by the best sum."""
    sums = reduce(DataFrame.unionByName, (x.select(key, "rank") for x in legs)).groupBy(key).agg(F.sum(1 / (constant + F.col("rank"))).alias("rrf"))
    top = sums.orderBy(F.desc(vectors.bucket(F.col("rrf"))), key).limit(k)
    return top.withColumn("fused", F.col("rrf") / F.max("rrf").over(Window.partitionBy(F.lit(1))))  # of at most k rows


def ranked(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows with their rank."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of at most k rows


def boosted(rows: DataFrame, semantic: str, boosts: dict[str, Column]) -> DataFrame:
    """boosts (map of the itemised deltas), composite (their sum with the score) and final (composite within 0 and 1)."""
    items = F.create_map(*(x for name, c in boosts.items() for x in (F.lit(name), c.cast("double"))))
    out = rows.withColumn("boosts", items)
    out = out.withColumn("composite", F.col(semantic) + F.aggregate(F.map_values("boosts"), F.lit(0.0), lambda s, x: s + x))
    return out.withColumn("final", scoring.clamp(F.col("composite")))


def final_order(content: str = "content", key: str = "id") -> list[Column]:
    return [F.desc(vectors.bucket(F.col("final"))), F.desc(vectors.bucket(F.col("composite"))), F.asc(content), F.asc(key)]


def max_by_key(rows: DataFrame, key: str, score: str) -> DataFrame:
    """One row per key, that of the best score."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score)))
    return rows.withColumn("_n", best).filter("_n = 1").drop("_n")


def shadow_overlap(rows: DataFrame, key: str, a: str, b: str, k: int = 5) -> DataFrame:
    """How many of the k best by one score are among the k best by the other."""
    one, two = (rows.orderBy(F.desc(c), key).limit(k).select(key) for c in (a, b))
    return one.join(two, key).agg(F.count("*").alias("common"), (F.count("*") / k).alias("share"))


def mmr(rows: DataFrame, group: str, key: str, vector: str, score: str, k: int, trade: float = 0.7, pool: int = 50) -> DataFrame:
    """Maximal marginal relevance per group: repeatedly the row with the best trade * score - (1 - trade) * likeness to
    those chosen. A group's pool of rows is bounded before it meets Python; the choice itself is sequential."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    bounded = rows.select(group, key, vector, score).withColumn("_n", best).filter(F.col("_n") <= pool)

    def choose(pdf):
        pdf = pdf.sort_values("_n")
        v = np.stack([np.asarray(x, np.float64) for x in pdf[vector]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        rel, left, picked, near = pdf[score].to_numpy(), list(range(len(pdf))), [], np.full(len(pdf), -np.inf)
        while left and len(picked) < k:
            value = [trade * rel[i] - (1 - trade) * (near[i] if picked else 0.0) for i in left]
            i = left.pop(int(np.argmax(value)))
            picked.append(i)
            near = np.maximum(near, v @ v[i])
        out = pdf.iloc[picked][[group, key]].copy()
        out["place"] = range(1, len(picked) + 1)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return bounded.groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, {key} {kinds[key]}, place long")
