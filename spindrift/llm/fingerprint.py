"""Improbable-feature digests of documents.

Features are windows of 64 bytes. A window's rarity comes from its entropy: the rarer that entropy is among all
windows of the corpus, the more improbable the feature. In every run of 64 neighbouring windows the rarest one
(the leftmost of ties) gets a point; windows with enough points, and the rarest window of a text, are its features.
They go into a chain of Bloom filters of 2048 bits, 160 features to a filter. Two digests are compared filter by
filter: the share of common bits beyond what chance gives, the best partner for each filter of the shorter chain.

Defined results: a null or empty text has an empty digest; a text of under 64 bytes has one feature, itself; the
likeness of equal digests is 1 and of an empty one to another 0; a null doc_id comes first; of several rows of a
doc_id the next document is the next row in the order of the text's hash (xxhash64) and the text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
RUN = 64
POINTS = 16
BINS = 1024
#: Bins of too little entropy to identify anything, such as a window of one repeated byte: they rank last.
POOR = 100
BITS = 2048
PER_FILTER = 160
HASHES = 5
BLOCK_BYTES = 1 << 18

_F = np.zeros(WINDOW + 2, np.int64)
_F[1:] = np.round(np.arange(1, WINDOW + 2) * np.log2(np.arange(1, WINDOW + 2)) * 65536)
_STEP = _F[1:] - _F[:-1]
_WORD = np.random.Generator(np.random.PCG64(20_240_612)).integers(1, 1 << 63, WINDOW // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_bins(x: np.ndarray) -> np.ndarray:
    """For every window of 64 bytes of x its entropy, from 0 to BINS - 1, by sliding counts."""
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the 63 that follow, that precede
    same = np.empty(n, bool)
    for k in range(1, WINDOW):
        eq = np.equal(x[:-k], x[k:], out=same[: n - k]).view(np.uint8)
        after[:-k] += eq
        before[k:] += eq
    change = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _F[np.bincount(x[:WINDOW], minlength=256)].sum()
    np.cumsum(change, out=total[1:])
    total[1:] += total[0]
    return (BINS - 1) - total * (BINS - 1) // _F[WINDOW]


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy bin: 0 for the least frequent; poor bins come last."""
    order = np.lexsort((np.arange(BINS), counts, np.arange(BINS) < POOR))
    out = np.empty(BINS, np.uint32)
    out[order] = np.arange(BINS, dtype=np.uint32)
    return out


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters, (filters, BITS) booleans. All texts are handled as one array."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    x = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    n_windows = np.maximum(0, size - WINDOW + 1)
    key = (rank[entropy_bins(x)].astype(np.uint64) << np.uint64(32)) | np.arange(len(x) - WINDOW + 1, dtype=np.uint64)
    low, k = key, 1
    while k < RUN and len(low) > k:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    chosen = [np.zeros(0, np.int64)]
    runs = np.maximum(0, n_windows - RUN + 1)
    if runs.any():
        mine = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        points = np.bincount((low[mine] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        chosen.append(np.flatnonzero(points >= POINTS))
    full = np.flatnonzero(n_windows)
    if len(full):  # each text's rarest window
        bounds = np.stack([first[full], first[full] + n_windows[full]], 1).ravel()
        chosen.append((np.minimum.reduceat(np.append(key, key[-1:]), bounds)[::2] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    at = np.unique(np.concatenate(chosen))
    windows = x[at[:, None] + np.arange(WINDOW)]
    owner = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    if len(short):
        windows = np.concatenate([windows, np.array([np.frombuffer(texts[i].ljust(WINDOW, b"\0"), np.uint8) for i in short])])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        windows, owner = windows[order], owner[order]
    words = np.ascontiguousarray(windows).view(np.uint64)
    h = words * _WORD
    h = ((h ^ (h >> np.uint64(29))) * _WORD[::-1]).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(31)
    count = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    filters = -(-count // PER_FILTER)
    base = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for j in range(HASHES):
        bits[base[owner] + nth // PER_FILTER, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [bits[b : b + f] for b, f in zip(base, filters)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains of filters: 0 for what chance gives, 1 for equal ones."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), a.sum()) > (len(b), b.sum()):
        a, b = b, a
    na, nb = a.sum(1).astype(np.float64), b.sum(1).astype(np.float64)
    common = a.astype(np.float32) @ b.astype(np.float32).T
    chance, most = np.outer(na, nb) / BITS, np.minimum.outer(na, nb)
    best = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((best * na).sum() / na.sum())


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many characters of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of the corpus have each entropy: one row of at most BINS counts for each task."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for part in _parts([t for t in b.column(0).to_pylist() if t and len(t) >= WINDOW]):
                bins = entropy_bins(np.frombuffer(b"".join(part), np.uint8))
                size = np.array([len(t) for t in part])
                inside = np.ones(len(bins), bool)
                cut = np.cumsum(size)[:-1]
                inside[(cut[:, None] - np.arange(1, WINDOW)).ravel()] = False
                total += np.bincount(bins[inside], minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in docs.select(F.col("text").cast("binary")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def _parts(texts: list):
    """Lists of texts (or of anything with a length) in blocks of bounded size."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BLOCK_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


#: Ranges of documents: so many for each partition that is read, and at most; rows sampled to cut each range.
RANGES = 4
MOST_RANGES = 50_000
SAMPLES = 20


def places(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """2 * r for rows of range r, and 2 * r + 1 if the row is the first of its range. bounds: (ranges, 2) sorted pairs of
    id and hash with which the ranges begin; no row is before the first."""
    low, high = np.searchsorted(bounds[:, 0], ids), np.searchsorted(bounds[:, 0], ids, "right")
    place = high.astype(np.int64)
    for i in np.flatnonzero(high > low):  # the id of a bound: its hashes decide
        place[i] = low[i] + np.searchsorted(bounds[low[i] : high[i], 1], hashes[i], "right")
    place = np.maximum(place - 1, 0)
    first = (bounds[place, 0] == ids) & (bounds[place, 1] == hashes)
    return 2 * place + first


def _bounds(own: DataFrame) -> np.ndarray:
    """The pairs of id and hash with which the ranges begin, from a sample of a bounded number of rows."""
    least = own.agg(F.min(F.struct("_o", "_h"))).first()[0]
    if least is None:
        return np.zeros((0, 2), np.int64)
    n = min(MOST_RANGES, max(1, RANGES * own.rdd.getNumPartitions()))
    some = own.select("_o", "_h").orderBy(F.xxhash64("_o", "_h")).limit(SAMPLES * n).toArrow()
    rows = np.stack([some.column(c).to_numpy() for c in ("_o", "_h")], 1)
    rows = np.unique(rows[np.lexsort((rows[:, 1], rows[:, 0]))], axis=0)
    cuts = rows[[len(rows) * i // n for i in range(1, n)]]
    return np.unique(np.concatenate([[list(least)], cuts]), axis=0)


def _ranges(docs: DataFrame) -> DataFrame:
    """part, last, doc_id, text: documents by ranges of doc_id and of a hash of the text; each range also gets the next
    one's first documents, marked last, so that every document meets its follower without a global sort. The first range
    follows the last."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("_o"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    bounds = _bounds(own)
    if not len(bounds):
        return own.select(F.lit(0).alias("part"), F.lit(False).alias("last"), "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(places(shared.value, ids.to_numpy(), hashes.to_numpy()))

    part, before = F.col("_p") / 2, (F.floor(F.col("_p") / 2) + len(bounds) - 1) % len(bounds)
    one = lambda p, last: F.struct(p.cast("int").alias("part"), F.lit(last).alias("last"))
    both = F.when(F.col("_p") % 2 == 1, F.array(one(part, False), one(before, True))).otherwise(F.array(one(part, False)))
    spread = own.withColumn("_p", place("_o", "_h")).select(F.inline(both), "doc_id", "text", "_o", "_h")
    spread = spread.repartitionById(len(bounds), "part").sortWithinPartitions("part", "last", "_o", "_h", "text")
    return spread.select("part", "last", "doc_id", "text")


def near_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(entropy_counts(docs)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(pairs):
        """pairs: (doc_id, text, following)."""
        at: dict[str, int] = {}  # a follower is mostly the next pair's text: each text once
        places = [[at.setdefault(x, len(at)) for x in (t, edited(t, f), f)] for _, t, f in pairs]
        bodies = [x.encode() for x in at]
        chain = digests(bodies, shared.value)
        rows = []
        for (doc, text, _), (own, other, following) in zip(pairs, places):
            rows.append((doc, len(text), hashlib.sha256(bodies[other]).hexdigest(), encode(chain[own]), encode(chain[other]), likeness(chain[own], chain[other]), likeness(chain[own], chain[following])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        waiting, pairs, size = None, [], 0
        for b in batches:
            for part, last, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                if waiting and waiting[0] == part:
                    pairs.append((waiting[1], waiting[2], text))
                    size += len(waiting[2]) * 2 + len(text)
                waiting = None if last else (part, doc, text)
                if size > BLOCK_BYTES:
                    yield compare(pairs)
                    pairs, size = [], 0
        if pairs:
            yield compare(pairs)

    return _ranges(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
