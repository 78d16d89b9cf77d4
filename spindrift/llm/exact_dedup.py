"""Exact deduplication by composable polynomial fingerprints.

Every text is cut into chunks; a chunk's fingerprint is a pair of polynomial hashes modulo two primes.
Fingerprints compose: H(AB) = H(A) * r^len(B) + H(B). So the chunks of a text of more than one are dealt to all
tasks, hashed there and shifted by the length of what follows them; their sums are the text's fingerprint. Rows of
equal fingerprint and length are then compared with their representative
(the row of the largest doc_id) chunk by chunk, so that a hash collision can never drop a text.

Defined results: a null text counts as the empty text; repeated rows (same doc_id and text) give a row each, all of
which count in group_size; a null doc_id is smaller than any other; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import spread_join, written

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
RADIX = (1103515245, 1664525013)
KEY = ("h1", "h2", "n_bytes")
#: Rows of a group that one slice of the comparison takes.
SLICE_ROWS = 256

_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int) -> np.ndarray:
    """r^(CHUNK-1) .. r^0 modulo the k-th prime."""
    if k not in _POWERS:
        out, x = np.empty(CHUNK, np.uint64), 1
        for i in range(CHUNK - 1, -1, -1):
            out[i], x = x, x * RADIX[k] % PRIMES[k]
        _POWERS[k] = out
    return _POWERS[k]


def chunk_fingerprint(chunk: bytes) -> tuple[int, int, int]:
    """Of at most CHUNK bytes: the two hashes and the length."""
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return *(int(b @ _powers(k)[CHUNK - len(b) :]) % PRIMES[k] for k in (0, 1)), len(b)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of a text from those of its two parts."""
    return *((a[k] * pow(RADIX[k], b[2], PRIMES[k]) + b[k]) % PRIMES[k] for k in (0, 1)), a[2] + b[2]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    return reduce(combine, (chunk_fingerprint(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)), (0, 0, 0))


def shifted(chunk: bytes, after: int) -> tuple[int, int]:
    """A chunk's share of the hashes of a text that goes on for `after` bytes."""
    h1, h2, _ = chunk_fingerprint(chunk)
    return tuple(h * pow(RADIX[k], after, PRIMES[k]) % PRIMES[k] for k, h in enumerate((h1, h2)))


def _chunks(body: str):
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(body) - 1, F.lit(0)) / CHUNK).cast("int")), lambda i: F.substring(F.col(body), i * CHUNK + 1, F.lit(CHUNK)))


def _of_parts(long_: DataFrame) -> DataFrame:
    """doc_id, text_sha256, h1, h2, n_bytes of texts (doc_id, body, text_sha256) of several chunks, each chunk hashed by itself."""
    parts = long_.select("doc_id", "text_sha256", F.octet_length("body").cast("long").alias("n_bytes"), F.posexplode(_chunks("body")).alias("part", "chunk"))
    parts = parts.groupBy("doc_id", "text_sha256", "n_bytes", "part").agg(F.first("chunk").alias("chunk"))  # of repeated rows once

    def run(batches):
        for b in batches:
            n, part, chunk = (b.column(c).to_pylist() for c in ("n_bytes", "part", "chunk"))
            got = [shifted(c, max(0, total - (i + 1) * CHUNK)) for total, i, c in zip(n, part, chunk)]
            columns = [*(b.column(c) for c in ("doc_id", "text_sha256", "n_bytes")), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "n_bytes", "h1", "h2"])

    found = parts.mapInArrow(run, "doc_id long, text_sha256 string, n_bytes long, h1 long, h2 long")
    sums = (F.pmod(F.sum(f"h{k + 1}"), F.lit(PRIMES[k])).alias(f"h{k + 1}") for k in (0, 1))
    return found.groupBy("doc_id", "text_sha256", "n_bytes").agg(*sums)


def fingerprints(docs: DataFrame, modulus: int | None = None) -> DataFrame:
    """doc_id, h1, h2, n_bytes, text_sha256 of every row. modulus: weakens the hashes, for tests of collisions."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.array([fingerprint(t or b"") for t in texts], np.int64).reshape(-1, 3)
            sha = [hashlib.sha256(t or b"").hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fp[:, i]) for i in range(3)), pa.array(sha)], ["doc_id", "h1", "h2", "n_bytes", "text_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    short = own.filter(F.octet_length("body") <= CHUNK).mapInArrow(run, "doc_id long, h1 long, h2 long, n_bytes long, text_sha256 string")
    long_ = own.filter(F.octet_length("body") > CHUNK).withColumn("text_sha256", F.sha2("body", 256))
    whole = _of_parts(long_).select(F.col("doc_id").alias("of"), F.col("text_sha256").alias("sha"), *KEY)
    rows = long_.select("doc_id", "text_sha256").join(whole, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_sha256") == F.col("sha")))
    out = short.unionByName(rows.select("doc_id", *KEY, "text_sha256"))
    return out.withColumns({k: F.col(k) % modulus for k in KEY[:2]}) if modulus else out


def _compare(members: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, same: whether the member's text is its representative's, chunk by chunk.

    A group's representative is copied once for every SLICE_ROWS members, so no task gets a whole hot group.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    texts = texts.join(members.withColumnRenamed("doc_id", "member"), F.col("doc_id").eqNullSafe(F.col("member")) & (texts.text_sha256 == members.text_sha256)).select("doc_id", texts.text_sha256, *KEY, "rep", "rows", "body")
    texts = written(texts)  # members only: read as such and as representatives
    slices = F.ceil(F.col("rows") / SLICE_ROWS).cast("int")
    chunks = _chunks("body")
    ours = texts.select("doc_id", "text_sha256", *KEY, F.pmod(F.xxhash64("doc_id", "text_sha256"), slices).cast("int").alias("slice"), F.posexplode(chunks).alias("part", "chunk"))
    reps = texts.filter(F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_sha256") == F.col("rep.sha"))).dropDuplicates(list(KEY))
    reps = reps.select(*KEY, F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), chunks.alias("all")).select(*KEY, "slice", F.posexplode("all").alias("part", "theirs"))
    both = ours.join(reps, [*KEY, "slice", "part"], "left")
    return both.groupBy("doc_id", "text_sha256", *KEY).agg(F.min(F.coalesce(F.col("chunk") == F.col("theirs"), F.lit(False))).alias("same"))


def exact_duplicates(docs: DataFrame, modulus: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    every = written(fingerprints(docs, modulus))
    rows = written(every.groupBy("doc_id", "text_sha256", *KEY).agg(F.count("*").alias("copies")))
    levels, pending, level = [], rows, 0
    while True:
        groups = pending.groupBy(*KEY).agg(F.count("*").alias("rows"), F.max(F.struct("doc_id", F.col("text_sha256").alias("sha"))).alias("rep"))
        many = spread_join(pending, groups.filter("rows > 1"), list(KEY), "rows").select("doc_id", "text_sha256", *KEY, "rows", "rep")
        compared = written(_compare(many, docs))
        differ = compared.filter("not same").select("doc_id", "text_sha256", *KEY)
        if differ.isEmpty():
            break
        level += 1  # a collision: the rows that differ from their representative are a group of their own
        levels.append(differ.withColumn("level", F.lit(level)))
        pending = differ
    deepest = reduce(DataFrame.unionByName, levels).groupBy("doc_id", "text_sha256").agg(F.max("level").alias("level")) if levels else None

    def placed(df: DataFrame) -> DataFrame:
        if deepest is None:
            return df.withColumn("level", F.lit(0))
        other = deepest.select(F.col("doc_id").alias("other"), F.col("text_sha256").alias("sha"), "level")
        return df.join(other, F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("text_sha256") == F.col("sha")), "left").drop("other", "sha").fillna({"level": 0})

    sizes = placed(rows).groupBy(*KEY, "level").agg(F.sum("copies").alias("group_size"), F.max("doc_id").alias("keep_id"))
    out = spread_join(placed(every), sizes, [*KEY, "level"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
