"""An audit of how five filters of documents act on each other, in every order, for each part of the corpus.

The filters, by their letters; a text fails
  A with under 200 words, B if under half of its words are different ones, C if over 2 % of its code points are
  A to Z, D if it holds one of # $ % & * |, E if a document with a smaller doc_id has the same text.

A to D are expressions over the text. E is an RDD that is routed by fingerprint: a task keeps chains of texts by their
xxhash, each with its whole text and the least id so far, and passes every row that isn't the least on at once, without
its text. What is left of a text (one row a task, so that a hot group is as many rows as there are tasks) goes to the
partition of its fingerprint, where chains are kept again. Texts of equal hash are told apart by comparison. The number of
partitions follows the bytes of the texts, and a task's first chains are given away whenever they hold HELD_BYTES.

A row's failures are a mask of five bits. combineByKey merges the vectors of counts by mask of each part, and the 600
rows of a part follow from its vector: a filter removes the masks that hold its bit and no bit of an earlier filter.

Defined results: a null text is empty, a null source is the part ''; a null doc_id is neither smaller nor greater than
another, so its row never fails E and has no labels; repeated rows count each, and don't fail E by each other; a
document with several label rows is good (toxic) if one of them says so; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
MASKS = 1 << len(FILTERS)
SAME = 1 << FILTERS.index("E")
#: Characters of the texts that a task's first chains hold at most.
HELD_BYTES = 1 << 25
#: Bytes of the texts that a partition of fingerprints is meant for.
PARTITION_BYTES = 1 << 25
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: str, words: str) -> Column:
    """The bits of A to D, which depend on the text alone; words: the column of its words."""
    n = F.size(words)
    fails = (
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text),
        F.col(text).rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def _absorb(chains: dict, key: int, text: str, doc_id: int, rows: dict) -> tuple[int, dict] | None:
    """Put a document's rows into its text's chain; gives the id and rows that are now known not to be the least."""
    chain = chains.setdefault(key, [])
    link = next((x for x in chain if x[0] == text), None)
    if link is None:
        chain.append([text, doc_id, rows])
    elif doc_id > link[1]:
        return doc_id, rows
    elif doc_id < link[1]:
        more = link[1], link[2]
        link[1:] = doc_id, rows
        return more
    else:
        for k, c in rows.items():
            link[2][k] = link[2].get(k, 0) + c
    return None


def _first(held_bytes: int):
    """(key, (doc_id, text, rows)) of a task's rows: the least of each text, and without the text what isn't."""

    def run(items):
        chains, held = {}, 0
        for key, doc_id, text, part, mask in items:
            more = _absorb(chains, key, text, doc_id, {(part, mask): 1})
            if more:
                yield more[0], (more[0], None, more[1])
            else:
                held += len(text) + 200
            if held > held_bytes:
                yield from ((k, (link[1], link[0], link[2])) for k, chain in chains.items() for link in chain)
                chains, held = {}, 0
        yield from ((k, (link[1], link[0], link[2])) for k, chain in chains.items() for link in chain)

    return run


def _settled(items):
    """(doc_id, part, mask, copies) of all documents of a partition of fingerprints."""
    chains: dict = {}
    for key, (doc_id, text, rows) in items:
        more = (doc_id, rows) if text is None else _absorb(chains, key, text, doc_id, rows)
        if more:
            yield from ((more[0], part, mask | SAME, c) for (part, mask), c in more[1].items())
    yield from ((link[1], part, mask, c) for chain in chains.values() for link in chain for (part, mask), c in link[2].items())


def masks(docs: DataFrame, key_bits: int = 64, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, part, mask, copies of every document. key_bits: shortens the fingerprints, for tests of collisions."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_BYTES + 1)
    own = own.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("mask", own_failures("text", "words"))
    key = F.xxhash64("text") if key_bits == 64 else F.xxhash64("text") % (1 << key_bits)
    rows = own.filter("doc_id IS NOT NULL").select(key.alias("key"), "doc_id", "text", "part", "mask").rdd
    routed = rows.mapPartitions(_first(held_bytes)).partitionBy(partitions, lambda k: k).mapPartitions(_settled)
    nameless = own.filter("doc_id IS NULL").select("doc_id", "part", "mask", F.lit(1).cast("long").alias("copies"))
    return spark.createDataFrame(routed, "doc_id long, part string, mask int, copies long", verifySchema=False).unionByName(nameless)


def _plan() -> list[tuple[str, int, np.ndarray]]:
    """order, step and the masks (as a matrix of 0, 1 and shares: rows of COUNTS, without labels) of each result row."""
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            fails = np.array([m & bit > 0 for m in range(MASKS)])
            gone = np.array([m & before > 0 for m in range(MASKS)])
            only = np.array([m == bit for m in range(MASKS)])
            share = np.array([len(ORDERS) // max(1, m.bit_count()) for m in range(MASKS)])
            out.append((order, step, np.array([~gone & ~fails, fails & ~gone, fails & gone, only, fails * share], np.int64)))
            before |= bit
    return out


def _report(items):
    """The 600 rows of each part from its vector of counts: of all rows, good ones and toxic ones by mask."""
    plan = _plan()
    for part, vector in items:
        n, good, toxic = np.array(vector, np.int64).reshape(3, MASKS)
        for order, step, takes in plan:
            kept, removed, redundant, unique, shapley = (takes @ n).tolist()
            yield part, order, step, kept, removed, redundant, unique, int(takes[1] @ good), int(takes[1] @ toxic), shapley


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the COUNTS, for every part, each of the 120 orders and its five steps."""
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(*(F.max((F.col(c) == 1).cast("long")).alias(k) for c, k in (("quality", "good"), ("toxic", "bad"))))
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("copies").alias("n"))
    rows = rows.join(known, F.col("doc_id") == F.col("of"), "left")
    sums = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "bad")))

    def seed(one: tuple) -> list[int]:
        return merged([0] * 3 * MASKS, one)

    def merged(vector: list[int], one: tuple) -> list[int]:
        for k in range(3):
            vector[k * MASKS + one[0]] += one[k + 1]
        return vector

    vectors = sums.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(seed, merged, lambda a, b: [x + y for x, y in zip(a, b)])
    schema = ", ".join(["part string", "filter_order string", "step int", *(f"{c} long" for c in COUNTS)])
    return spark.createDataFrame(vectors.mapPartitions(_report), schema, verifySchema=False)
