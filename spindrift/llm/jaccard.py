"""Exact n-gram Jaccard join of whole documents, and its connected components.

Two documents link when the Jaccard similarity of their shingle sets is at least 3/4. Equal sets are one vertex.

1. A pass over the texts gives each document its set's size, signature and min-hash keys, and the tokens that are
   frequent within a bounded number of tokens, a portion. Their totals give the hot tokens: those of HOT documents at
   least, and of as many as there are portions. So there are at most PORTION hot tokens at any input size.
2. Families first: the sets of a key are compared exactly with one of them, a star and not pairs. What links is one
   component from here on, so that no later step makes pairs within a family.
3. A second pass sends, for each distinct set, a prefix of its tokens (hot ones last, else by hash) to the buckets
   of a hash range. Two similar sets of sizes m and n with an overlap of at least 3 (m + n) / 7 share a known number
   of tokens within their prefixes. Tokens that one set alone has are dropped; sets with too few tokens left for any
   partner are dropped; the tokens of the others go back to the buckets, as those of their components. There, shared
   tokens are counted per pair of components in short lists; the members of a long list are chained by size. Pairs
   that reach their number and the chains make candidate groups: a similar pair is never in two groups.
4. Each group's texts are joined exactly by T-occurrence search (DivideSkip), whose lists hold components. A group
   beyond GROUP documents is cut into blocks, large components into blocks of their own, which never meet each other.
5. The links found, reduced to a forest per task, give the components.

Only hashes, sizes and links move between tasks, and the texts of families and candidate groups. A list gives at most
LIST / 2 pairs for each posting. Sets are compared as sets of 52-bit hashes.

Defined results: a null, empty or wordless text has n_shingles 0 and is its own component; repeated rows give
repeated rows; a row without a doc_id links with nothing and has a null component; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import shingles as S
from spindrift.llm.components import components
from spindrift.llm.memory import release
from spindrift.llm.tables import discard, likely_in, spread_join, written

WIDTH = 5
#: Tokens of a portion, which a task counts before it reports the frequent ones; postings that it sends at once.
PORTION = 4_000_000
FLUSH = 2_000_000
#: Postings of a bucket.
BUCKET = 2_000_000
HOT = 64
#: Lists of tokens that aren't hot are joined pair by pair in a bucket up to this length; longer ones are chained too.
LIST = 256
#: Documents and tokens of a block of a candidate group, and members that are compared with one copy of a family's centre.
GROUP = 3000
GROUP_TOKENS = 1_500_000
SLICE = 256
#: Min-hash keys of a set; each is made of two hashes.
KEYS = 3


def prefix(n: np.ndarray | int):
    """Length of the prefix of a set of size n: one more than may differ, and a tenth of the set besides."""
    return np.minimum(n, n - (3 * n + 3) // 4 + 1 + n // 10)


def shared_within_prefix(m, n):
    """How many tokens two sets of sizes m and n with Jaccard similarity 3/4 or more share within their prefixes, at least."""
    overlap = -(-3 * (m + n) // 7)
    return np.minimum(prefix(m) - m, prefix(n) - n) + overlap


def shared_with_any(n):
    """A lower bound of shared_within_prefix for a set of size n or more and any partner: the overlap is at least 0.75 of
    the larger set, whose prefix leaves out 0.65 of it and 0.65 at most."""
    return np.maximum(1, np.ceil((10 * np.asarray(n, np.int64) - 65) / 100).astype(np.int64))


def signature(tokens: np.ndarray) -> int:
    """64 bits of a set; never 0."""
    h = S.mix(tokens * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(tokens)))
    return int(np.add.reduce(S.mix(h ^ np.uint64(0xA0761D6478BD642F))).view(np.int64)) or 1


_SALT = S.mix(np.arange(1, 2 * KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def min_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, KEYS) min-hash keys of sets end to end; those of empty sets mean nothing."""
    out = np.zeros((len(bounds) - 1, KEYS), np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        lows = [np.minimum.reduceat((values ^ s) * np.uint64(0xD6E8FEB86659FD93), bounds[some]) for s in _SALT]
        for k in range(KEYS):
            out[some, k] = S.mix(lows[2 * k] * np.uint64(3) + S.mix(lows[2 * k + 1])).view(np.int64)
    return out


def _sets(batches, text: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, last row, tokens, bounds) of blocks of rows."""
    for b in batches:
        texts = b.column(text).to_pylist()
        for first, last in S.blocks(texts):
            yield b, first, last, *S.shingle_sets(texts[first:last], WIDTH)


def _survey(docs: DataFrame) -> DataFrame:
    """kind 0: a document's id, signature, size and keys; kind 1: a token and in how many distinct sets of a portion it is."""

    def run(batches):
        tokens, known, size = [], set(), 0
        held: list[tuple] = []

        def frequent():
            t, n = np.unique(np.concatenate(tokens or [np.zeros(0, np.uint64)]), return_counts=True)
            t, n = t[n > 2].astype(np.int64), n[n > 2]
            return rows(1, t, np.zeros(len(t), np.int64), n, None)

        def rows(kind, a, b, c, keys):
            keys = pa.nulls(len(c), pa.list_(pa.int64())) if keys is None else pa.array(keys, pa.list_(pa.int64()))
            columns = [pa.array(np.full(len(c), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (a, b, c)), keys]
            return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "c", "keys"])

        for batch, first, last, values, bounds in _sets(batches, 1):
            keys = min_keys(values, bounds)
            for i, doc in enumerate(batch.column(0)[first:last].to_pylist()):
                s = values[bounds[i] : bounds[i + 1]]
                sig = signature(s) if len(s) else 0
                held.append((doc, sig, len(s), keys[i]))
                if len(s) and sig not in known:
                    known.add(sig)
                    tokens.append(s)
                    size += len(s)
                if size > PORTION:
                    yield frequent()
                    tokens, known, size = [], set(), 0
                    release()
            if len(held) >= 5000:
                yield rows(0, *zip(*held))
                held = []
        if held:
            yield rows(0, *zip(*held))
        yield frequent()
        yield rows(2, [0], [0], [1], None)
        del tokens
        release()

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "kind int, a long, b long, c long, keys array<long>")


def _stars(docs: DataFrame, vertices: DataFrame, partitions: int) -> DataFrame:
    """a, b: links between the sets of a min-hash key and the one of the least document, each compared exactly."""
    keyed = vertices.select("sig", "doc_id", "n", F.posexplode("keys").alias("j", "key"))
    groups = keyed.groupBy("j", "key").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "sig", "n")).alias("centre")).filter("members > 1")
    near = spread_join(keyed, groups, ["j", "key"], "members").filter("sig <> centre.sig AND 4 * least(n, centre.n) >= 3 * greatest(n, centre.n)")
    edges = written(near.select("sig", "doc_id", "centre").distinct())
    slices = edges.groupBy("centre").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    where = F.struct(F.col("centre.sig").alias("centre"), F.pmod(F.xxhash64("sig"), "slices").cast("int").alias("slice"), F.lit(1).alias("member"))
    members = spread_join(edges, slices.withColumn("rows", F.col("slices") * SLICE), ["centre"], "rows").select("doc_id", "sig", where.alias("at"))
    centres = slices.select("centre.doc_id", "centre.sig", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    centres = centres.select("doc_id", "sig", F.struct(F.col("sig").alias("centre"), "slice", F.lit(0).alias("member")).alias("at"))
    wanted = written(members.unionByName(centres))  # its size is known when the join with the texts is planned
    texts = _texts(docs, wanted).select("at.*", "sig", "text")
    texts = texts.repartition(partitions, "centre", "slice").sortWithinPartitions("centre", "slice", "member", "sig")

    def run(batches):
        at, centre, block, size = None, None, [], 0

        def compare():
            values, bounds = S.shingle_sets([t for _, t in block], WIDTH)
            found = []
            for i, (sig, _) in enumerate(block):
                s = values[bounds[i] : bounds[i + 1]]
                common = np.count_nonzero(centre[np.minimum(np.searchsorted(centre, s), len(centre) - 1)] == s)
                if signature(s) == sig and similar(len(s), len(centre), common):
                    found.append(sig)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

        for batch in batches:
            for c, i, member, sig, text in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, i) != at or size > S.BYTES_PER_BLOCK:
                    if block:
                        yield compare()
                    block, size = [], 0
                if (c, i) != at:
                    at, centre = (c, i), None
                if member and centre is not None:
                    block.append((sig, text))
                    size += len(text)
                elif not member and centre is None:
                    s = S.shingle_sets([text], WIDTH)[0]
                    centre = s if signature(s) == sig else None
        if block:
            yield compare()
        release()

    return texts.mapInArrow(run, "a long, b long")


def _families(kept: DataFrame) -> DataFrame:
    """sig, family: sets under the name of a set that they link with, or that it links with; links join all of a family.
    It need not be all that links join: it is what makes no pairs."""
    own = kept.select(F.col("b").alias("sig"), F.col("a").alias("family")).unionByName(kept.select(F.col("a").alias("sig"), F.col("a").alias("family")))
    first = written(own.groupBy("sig").agg(F.min("family").alias("family")))
    further = first.select(F.col("sig").alias("family"), F.col("family").alias("next")).filter("family <> next")
    return first.join(further, "family", "left").select("sig", F.coalesce("next", "family").alias("family"))


def similar(m, n, common):
    return 7 * common >= 3 * (m + n)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (doc_id, sig, ...) with the texts of their documents; a document of several texts gives each."""
    return likely_in(docs.select("doc_id", F.col("text").cast("binary").alias("text")), wanted, "doc_id").join(wanted, "doc_id")


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which a shuffle compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).view(kind).ravel()


_POSTINGS = "bucket int, token binary, at binary, sig binary, size binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("token", "at", "sig", "size"))])


def _range_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the mixed hash: prefixes hold low hashes mostly."""
    return ((S.mix(h) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _set_range(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _packed(bucket: np.ndarray, token: np.ndarray, owner: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings by bucket: sorted tokens as differences, owners as places in a small dictionary of (sig, size)."""
    order = np.lexsort((token, bucket))
    token, owner, sizes = token[order], owner[order], sizes.astype(np.int32)
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))
    out = []
    for k in np.flatnonzero(np.diff(edge)).tolist():
        a, b = edge[k], edge[k + 1]
        own, at = np.unique(owner[a:b], return_inverse=True)
        out.append((k, _planes(np.diff(token[a:b], prepend=np.uint64(0))), _planes(at.astype(np.uint32)), _planes(sigs[own]), _planes(sizes[own])))
    for i in range(0, len(out), 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 16]), _SCHEMA)], schema=_SCHEMA)


def _owners(sig: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each posting's (sig, size), and the sig and size of each number."""
    order = np.lexsort((size, sig))
    new = _starts(sig[order])
    new[1:] |= size[order][1:] != size[order][:-1]
    owner = np.empty(len(sig), np.int64)
    owner[order] = np.cumsum(new) - 1
    first = order[new]
    return owner, sig[first], size[first]


def _by_bucket(batches, work) -> Iterator[pa.RecordBatch]:
    """work(token, sig, size) of each bucket's postings, distinct and ordered by token and sig."""
    held, parts = None, []

    def bucket():
        token, sig, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((size, sig, token))
        token, sig, size = token[order], sig[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]) | (size[1:] != size[:-1])
        yield from work(token[new], sig[new], size[new].astype(np.int64))

    for batch in batches:
        for k, token, at, sig, size in zip(*(c.to_pylist() for c in batch.columns)):
            if k != held and parts:
                yield from bucket()
                parts = []
                release()
            held, at = k, _unplanes(at, np.uint32)
            parts.append((np.cumsum(_unplanes(token, np.uint64)), _unplanes(sig, np.int64)[at], _unplanes(size, np.int32)[at]))
    if parts:
        yield from bucket()
    del parts
    release()


def _dealt(postings: DataFrame, buckets: int) -> DataFrame:
    return postings.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")


def _postings(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """The postings of the prefixes by ranges of tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot, known, tokens, sigs, sizes, held = shared.value, set(), [], [], [], 0

        def flush():
            token, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            yield from _packed(_range_of(token, buckets), token, owner, np.array(sigs, np.int64), np.array(sizes, np.int64), buckets)

        for _, first, last, values, bounds in _sets(batches, 0):
            for i in range(last - first):
                s = values[bounds[i] : bounds[i + 1]]
                if not len(s) or (sig := signature(s)) in known:
                    continue
                known.add(sig)
                p = int(prefix(len(s)))
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    if is_hot[:p].any():
                        s = np.concatenate([s[~is_hot], s[is_hot]])
                tokens.append(s[:p].copy())
                sigs.append(sig)
                sizes.append(len(s))
                held += p
                if held >= FLUSH:
                    yield from flush()
                    known, tokens, sigs, sizes, held = set(), [], [], [], 0
        if tokens:
            yield from flush()
        del tokens
        release()

    return docs.filter("doc_id IS NOT NULL").select(F.col("text").cast("binary")).mapInArrow(run, _POSTINGS)


def _shared_only(postings: DataFrame, buckets: int) -> DataFrame:
    """The postings of tokens that two sets have at least, by ranges of sets."""

    def work(token, sig, size):
        length = np.diff(np.append(np.flatnonzero(_starts(token)), len(token)))
        some = np.repeat(length > 1, length)
        yield from _packed(_set_range(sig[some], buckets), token[some], *_owners(sig[some], size[some]), buckets)

    return _dealt(postings, buckets).mapInArrow(lambda batches: _by_bucket(batches, work), _POSTINGS)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return new


def _unpacked(postings: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, sig, size of all rows of a table of postings."""
    parts = []
    for token, at, sig, size in zip(*(postings.column(c).to_pylist() for c in ("token", "at", "sig", "size"))):
        at = _unplanes(at, np.uint32)
        parts.append((np.cumsum(_unplanes(token, np.uint64)), _unplanes(sig, np.int64)[at], _unplanes(size, np.int32)[at].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _survivors(postings: DataFrame, families: DataFrame, buckets: int) -> DataFrame:
    """The postings of sets that have as many shared tokens as some partner would need, by ranges of tokens and under
    the names of their families (sig, family); the name of any other set is its own."""

    def choose(own: pa.Table, named: pa.Table) -> pa.Table:
        token, sig, size = _unpacked(own)
        order = np.lexsort((token, sig))
        token, sig, size = token[order], sig[order], size[order]
        new = _starts(sig)
        new[1:] |= token[1:] != token[:-1]
        token, sig, size = token[new], sig[new], size[new]
        start = np.flatnonzero(_starts(sig)) if len(sig) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(sig)))
        some = np.repeat(length >= shared_with_any(size[start]), length)
        token, sig, size = token[some], sig[some], size[some]
        if named.num_rows and len(sig):
            known, names = (np.array(named.column(c), np.int64) for c in ("sig", "family"))
            by = np.argsort(known)
            known, names = known[by], names[by]
            at = np.minimum(np.searchsorted(known, sig), len(known) - 1)
            sig = np.where(known[at] == sig, names[at], sig)
        out = list(_packed(_range_of(token, buckets), token, *_owners(sig, size), buckets)) if len(token) else []
        release()
        return pa.Table.from_batches(out, _SCHEMA)

    own = families.withColumn("bucket", F.shiftright(F.shiftrightunsigned("sig", 32) * F.lit(buckets).cast("long"), 32).cast("int"))
    return postings.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(choose, _POSTINGS)


def _pairs_of(token: np.ndarray, name: np.ndarray, size: np.ndarray, hot: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """name a < name b, the sizes of their sets (least a, greatest a, least b, greatest b), and how many tokens they
    share, or -1 for links of a chain. Postings are distinct and ordered by token, name and size."""
    ids, local = np.unique(name, return_inverse=True)
    low, high = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
    np.minimum.at(low, local, size)
    np.maximum.at(high, local, size)
    one = _starts(token)
    one[1:] |= local[1:] != local[:-1]
    t, m = token[one], local[one]
    start = np.flatnonzero(_starts(t)) if len(t) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(t)))
    chained = (length > most) | np.isin(t[start], hot, assume_unique=True)
    rest = np.repeat(length, length) - (np.arange(len(t)) - np.repeat(start, length))  # places from here to the list's end
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    at, k, held = np.flatnonzero(np.repeat((length > 1) & ~chained, length) & (rest > 1)), 1, 0
    while len(at):
        a, b = m[at], m[at + k]
        ok = (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
        keys.append(a[ok].astype(np.int64) * len(ids) + b[ok])
        held += int(ok.sum())
        if held > 2_000_000:
            u, c = _merge_counts(keys, counts)
            keys, counts, held = [u], [c], 0
        k += 1
        at = at[rest[at] > k]
    key, n = _merge_counts(keys, counts) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    long_ = np.repeat(chained & (length > 1), length)[np.cumsum(one) - 1] if len(t) else np.zeros(0, bool)
    if long_.any():
        x, y, z = token[long_], local[long_], size[long_]
        order = np.lexsort((y, z, x))
        x, y, z = x[order], y[order], z[order]
        near = (x[1:] == x[:-1]) & (y[1:] != y[:-1]) & (4 * z[:-1] >= 3 * z[1:])
        p, q = np.minimum(y[:-1], y[1:])[near], np.maximum(y[:-1], y[1:])[near]
        chain = np.unique(p.astype(np.int64) * len(ids) + q)
        key, n = np.concatenate([key, chain]), np.concatenate([n, np.full(len(chain), -1, np.int64)])
    a, b = (key // len(ids), key % len(ids)) if len(ids) else (key, key)
    return ids[a], ids[b], low[a], high[a], low[b], high[b], n


def _merge_counts(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key; keys after the first counted lists count once each."""
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.concatenate([*counts, *(np.ones(len(k), np.int64) for k in keys[len(counts) :])])
    return u, np.bincount(at, weight).astype(np.int64)


def _candidates(postings: DataFrame, hot: np.ndarray, buckets: int, most: int) -> DataFrame:
    """a, b: families that may hold similar sets, and chains of the lists of hot tokens and of those longer than `most`."""
    shared = postings.sparkSession.sparkContext.broadcast(hot)
    names = ["a", "b", "la", "ha", "lb", "hb", "c"]

    def work(token, name, size):
        columns = _pairs_of(token, name, size, shared.value, most)
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in columns], names)

    pairs = _dealt(postings, buckets).mapInArrow(lambda batches: _by_bucket(batches, work), ", ".join(f"{n} long" for n in names))
    sums = pairs.groupBy("a", "b").agg(
        F.sum(F.greatest("c", F.lit(0))).alias("c"), F.min("c").alias("least"), *(F.min(x).alias(x) for x in ("la", "lb")), *(F.max(x).alias(x) for x in ("ha", "hb"))
    )
    own = lambda n: F.least(n, n - F.floor((3 * n + 3) / 4) + 1 + F.floor(n / 10)) - n
    exact = F.least(own(F.col("la")), own(F.col("lb"))) + F.ceil(3 * (F.col("la") + F.col("lb")) / 7)
    any_ = F.greatest(F.lit(1), F.ceil((10 * F.greatest("la", "lb") - 65) / 100))
    need = F.when((F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb")), exact).otherwise(any_)
    return sums.filter((F.col("least") < 0) | (F.col("c") >= need)).select("a", "b")


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `least` of the sorted lists, and of how many: the long lists are set aside, the short
    ones merged, and what is frequent enough there is looked up in each long list by binary search."""
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (0.0085 * np.log2(longest + 1) + 1)))
    while aside and len(lists[len(lists) - aside]) < 8:  # short lists are merged faster than probed
        aside -= 1
    merged = np.concatenate(lists[: len(lists) - aside])
    merged.sort(kind="stable")
    start = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    count = np.diff(np.append(start, len(merged)))
    some = count >= least - aside
    member, count = merged[start[some]], count[some]
    for left, x in zip(range(aside - 1, -1, -1), lists[len(lists) - aside :]):
        if not len(member):
            break
        at = np.minimum(np.searchsorted(x, member), len(x) - 1)
        count = count + (x[at] == member)
        some = count >= least - left
        member, count = member[some], count[some]
    return member, count


def links(sets: list[np.ndarray], names: np.ndarray) -> list[tuple[int, int]]:
    """Places of similar sets of different families, a link for every two families that no earlier links join.

    The inverted lists hold families. A set finds those that hold at least 3/4 of its tokens, as any similar set
    does; their members are then compared with it exactly."""
    ids, family = np.unique(names, return_inverse=True)
    if len(ids) < 2:
        return []
    n = np.array([len(s) for s in sets], np.int64)
    token, owner = np.concatenate(sets), np.repeat(family, n)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = _starts(token)
    new[1:] |= owner[1:] != owner[:-1]
    token, owner = token[new], owner[new]
    start = np.flatnonzero(_starts(token))
    end, known = np.append(start[1:], len(token)), token[start]
    by = np.argsort(family, kind="stable")
    edge = np.searchsorted(family[by], np.arange(len(ids) + 1))
    members = [by[edge[f] : edge[f + 1]] for f in range(len(ids))]
    bodies: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    forest, out = Forest(len(ids)), []
    for x in by[edge[1] :].tolist():
        s, f = sets[x], int(family[x])
        own = np.searchsorted(known, s)
        own = own[end[own] - start[own] > 1]
        least = int(-(-3 * n[x] // 4))
        if len(own) < least:
            continue
        found = divide_skip([owner[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())], least)[0]
        for g in found[found < f].tolist():
            if forest.root(f) == forest.root(g):
                continue
            if g not in bodies:
                size = n[members[g]]
                bodies[g] = np.concatenate([sets[i] for i in members[g]]), np.cumsum(size) - size
            body, first = bodies[g]
            common = np.add.reduceat(s[np.minimum(np.searchsorted(s, body), len(s) - 1)] == body, first, dtype=np.int64)
            hit = np.flatnonzero(similar(n[x], n[members[g]], common))
            if len(hit):
                forest.join(f, g)
                out.append((x, int(members[g][hit[0]])))
    return out


def _placed(vertices: DataFrame, families: DataFrame, groups: DataFrame) -> DataFrame:
    """sig, doc_id, name, at (grp and two blocks): the cells in which each member of a candidate group is compared.

    A block holds GROUP documents or GROUP_TOKENS tokens. A large family has blocks of its own, which meet those of
    others; the rest of a group is dealt to blocks that all meet."""
    sizes = vertices.select("sig", "n").join(families, "sig").groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    names = groups.join(sizes.withColumnRenamed("family", "vertex"), "vertex", "left")
    names = names.join(vertices.select(F.col("sig").alias("vertex"), "n"), "vertex")  # a family's name is a set
    share = F.greatest(F.coalesce("members", F.lit(1)) / GROUP, F.coalesce("tokens", "n") / GROUP_TOKENS)
    names = names.select(F.col("component").alias("grp"), F.col("vertex").alias("name"), "members", share.alias("share"), (share > 0.5).alias("large"))
    names = written(names)
    block = lambda name, i: F.struct(name.alias("name"), i.cast("int").alias("i"))
    many = lambda x: F.greatest(F.lit(1), F.ceil(x)).cast("int")
    of = names.groupBy("grp").agg(
        F.sum(F.coalesce("members", F.lit(1))).alias("rows"), many(F.sum(F.when(~F.col("large"), F.col("share")).otherwise(0.0))).alias("blocks"),
        F.collect_list(F.when(F.col("large"), F.struct("name", many(F.col("share")).alias("parts")))).alias("large_ones"),
    )
    mine = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: block(F.lit(0).cast("long"), i))
    theirs = F.flatten(F.transform("large_ones", lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda i: block(x["name"], i))))
    of = of.select("grp", "rows", "blocks", F.concat(mine, theirs).alias("all"))
    member = names.select("grp", "name", "members", F.when(F.col("large"), many(F.col("share"))).alias("parts"))
    single = member.filter("members IS NULL").withColumn("sig", F.col("name"))
    several = spread_join(families.withColumnRenamed("family", "name"), member.filter("members IS NOT NULL"), ["name"], "members")
    rows = spread_join(single.unionByName(several).select("grp", "name", "parts", "sig"), of, ["grp"], "rows")
    hashed = F.xxhash64("sig")
    own = F.when(F.col("parts").isNull(), block(F.lit(0).cast("long"), F.pmod(hashed, "blocks"))).otherwise(block(F.col("name"), F.pmod(hashed, "parts")))
    rows = rows.withColumn("own", own)
    cells = F.transform(F.filter("all", lambda b: (b["name"] != F.col("own.name")) | (b["name"] == 0)), lambda b: F.struct("grp", F.least("own", b).alias("x"), F.greatest("own", b).alias("y")))
    return rows.select("sig", "name", F.explode(cells).alias("at")).join(vertices.select("sig", "doc_id"), "sig")


def _join_groups(docs: DataFrame, placed: DataFrame, partitions: int) -> DataFrame:
    """a, b: links between signatures of different families, from exact joins within the cells."""
    texts = _texts(docs, placed).select("at", "sig", "name", "text").repartition(partitions, "at").sortWithinPartitions("at", "sig")
    texts = texts.select(F.xxhash64("at").alias("at"), "sig", "name", "text")

    def run(batches):
        held, rows = None, []

        def cell():
            sets, sigs, names = [], [], []
            for a, b in S.blocks([r[2] for r in rows]):
                v, bound = S.shingle_sets([r[2] for r in rows[a:b]], WIDTH)
                for i, (sig, name, _) in enumerate(rows[a:b]):
                    s = v[bound[i] : bound[i + 1]]
                    if (not sigs or sigs[-1] != sig) and len(s) and signature(s) == sig:
                        sets.append(s)
                        sigs.append(sig)
                        names.append(name)
            found = links(sets, np.array(names, np.int64))
            return pa.RecordBatch.from_arrays([pa.array([sigs[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for at, sig, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != held:
                    if len(rows) > 1:
                        yield cell()
                        release()
                    held, rows = at, []
                rows.append((sig, name, text))
        if len(rows) > 1:
            yield cell()
        del rows
        release()

    return texts.mapInArrow(run, "a long, b long")


def _hot(survey: DataFrame, frequent: int, spark) -> np.ndarray:
    """The hot tokens in order; there are at most as many as a portion has tokens."""
    sums = survey.filter("kind = 1").groupBy("a").agg(F.sum("c").alias("n")).filter(F.col("n") >= frequent).select("a")
    return np.sort(sums.toArrow().column("a").to_numpy().astype(np.int64).view(np.uint64))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    survey = written(_survey(docs))
    own = survey.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sig"), F.col("c").alias("n"), "keys")
    vertices = own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig")
    vertices = written(vertices.agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.count("*").alias("rows")))
    total = vertices.agg(F.sum("n")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // 1_000_000)
    buckets = 2 + int(prefix(total)) // BUCKET
    kept = written(_stars(docs, vertices, partitions))
    families = written(_families(kept))
    frequent = max(HOT, (survey.filter("kind = 0").agg(F.sum("c")).first()[0] or 0) // PORTION + survey.filter("kind = 2").count())
    hot = _hot(survey, frequent, spark)
    postings = _survivors(_shared_only(_postings(docs, hot, buckets), buckets), families, buckets)
    groups = components(_candidates(postings, hot, buckets, LIST))
    placed = written(_placed(vertices, families, groups))
    found = written(_join_groups(docs, placed, partitions))
    discard(placed, families)
    labels = components(kept.unionByName(found)).withColumnRenamed("vertex", "sig")
    sized = labels.join(vertices.select("sig", "doc_id"), "sig")
    least = sized.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    named = spread_join(labels, least, ["component"], "rows").select("sig", "component_id")
    named = vertices.select("sig", "doc_id", "rows").join(named, "sig", "left").select("sig", "rows", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = spread_join(own.filter("n > 0 AND doc_id IS NOT NULL"), named, ["sig"], "rows").select("doc_id", "n", "component_id")
    alone = own.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("n", "n_shingles")
