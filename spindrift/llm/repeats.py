"""Removal of passages that an earlier document holds too: every byte covered by a 50-byte string that also starts
in a document with a smaller doc_id. Overlaps count, and strings are judged on the input.

Documents are dealt to cells by a hash of doc_id; their texts are shuffled once and the exchange is used three times.

1. Every 50-byte window has an anchor: of its 20-byte strings the one of least hash, the leftmost of ties. Equal
   windows have equal anchors, so only windows whose anchor occurs in two documents can repeat. Each cell sends
   its distinct anchors to the bucket of their hash, which tells the cells those that are shared.
2. Neighbouring windows with the same anchor make a context, the bytes that they cover. Cells send their distinct
   contexts of shared anchors, with the least doc_id of each, to the anchors' buckets.
3. A bucket sorts the suffixes of its distinct contexts (as far as the length in question), makes their Burrows-Wheeler
   transform and derives common prefixes by threshold-bounded interval expansion: beginning with the intervals of
   single symbols, the intervals that are new are extended backward by every symbol, breadth first; a border that
   first shows at length l marks a common prefix of l. The expansion stops at 50. Suffixes not yet parted share 50
   bytes, and the least doc_id of their contexts is the string's first place.
4. Cells mark the bytes of windows whose string has an earlier place, and cut them out.

The numbers of cells and buckets follow the bytes of the input. Buckets get each context once a cell, however many documents hold it, so a passage in a third of all documents
costs one row a cell. No step has all pairs of anything.

Defined results: a null text is empty; a row without a doc_id stays as it is and removes nothing; rows of one doc_id
don't remove each other's bytes; texts under 50 bytes stay; an empty table gives no rows; other columns are ignored
unless asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.memory import release
from spindrift.llm.shingles import mix
from spindrift.llm.tables import named

LENGTH = 50
GRAM = 20
#: Bytes whose anchors are found at once: small enough for a processor's cache.
BLOCK = 1 << 16
#: Anchors are told apart by so many bits of their hash; two that fall together only widen the search.
ANCHOR_BITS = 48
#: Cells for each shuffle partition at least, and about how many bytes of text a cell and a bucket stand for at most.
CELLS = 2
CELL_BYTES = 24 << 20
BUCKET_BYTES = 32 << 20
#: About how many bytes of contexts one suffix array holds.
ARRAY_BYTES = 1 << 18
NEVER = np.iinfo(np.int64).max

_rng = np.random.Generator(np.random.PCG64(20_240_613))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hash of every GRAM (20) bytes of x, by doubling: 1, 2, 4, 8, 16 and then 16 + 4."""
    h = _CODE[x]
    four = h
    for i, k in enumerate((1, 2, 4, 8)):
        h = h[:-k] * _FACTOR[i] + h[k:]
        four = h if k == 2 else four
    return mix(h[: len(x) - GRAM + 1] * _FACTOR[5] + four[16 : 16 + len(x) - GRAM + 1])


def anchors(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """Of pieces end to end in x (at most BLOCK bytes): for every context its piece, first and last window, anchor hash."""
    sizes = np.array(sizes, np.int64)
    count = np.maximum(0, sizes - LENGTH + 1)
    if not count.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = gram_hashes(x)
    low = (h & ~np.uint64(BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        low = np.minimum(low[:-k], low[k:])
    low = np.minimum(low[:-15], low[15:])  # 31 neighbours
    first = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[piece]
    place = (low[at] & np.uint64(BLOCK - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    return piece[new], at[new], at[last], h[place[new]] & np.uint64((1 << ANCHOR_BITS) - 1)


def _blocks(texts: list[bytes]):
    """(x, pieces, sizes): texts in blocks; pieces: (document, its offset). A longer text is cut with an overlap."""
    parts, where, size = [], [], 0
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), BLOCK - LENGTH):
            p = t[a : a + BLOCK - 1]
            if parts and size + len(p) >= BLOCK:
                yield np.frombuffer(b"".join(parts), np.uint8), where, [len(q) for q in parts]
                parts, where, size = [], [], 0
            parts.append(p)
            where.append((d, a))
            size += len(p)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), where, [len(q) for q in parts]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, kind=np.int64) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).view(kind).ravel()


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, last) of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return list(zip(sorted_[start].tolist(), start.tolist(), np.append(start[1:], len(sorted_)).tolist()))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the low half of the hash: anchors are the least of their neighbours, so their high bits are mostly 0."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)


class Cell:
    """The documents of a cell in a fixed order; those without a doc_id come last and take no part."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), [t or b"" for t in table.column("_body").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in self.order], [texts[i] for i in self.order]
        self.known = sum(i is not None for i in self.ids)
        self.doc = np.array(self.ids[: self.known], np.int64)

    def anchors(self):
        """Blocks of (x, offset of each piece in its document, document of each piece, piece, low, high, hash)."""
        for x, where, sizes in _blocks(self.texts[: self.known]):
            first = np.cumsum(sizes) - sizes
            piece, low, high, h = anchors(x, sizes)
            doc = np.array([w[0] for w in where], np.int64)
            shift = np.array([w[1] for w in where], np.int64) - first
            yield x, doc[piece], shift[piece], low, high, h

    def shared_anchors(self, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, distinct anchors in order, whether two documents of the cell have it)."""
        pairs = [(h, self.doc[doc]) for _, doc, _, _, _, h in self.anchors()]
        if not pairs:
            return []
        h, doc = (np.concatenate(c) for c in zip(*pairs))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(start):
            return []
        two = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        bucket = _bucket(h[start], buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, two = h[start][order], two[order]
        return [(k, h[a:b], two[a:b]) for k, a, b in _runs(bucket[order])]

    def contexts(self, shared: np.ndarray, buckets: int):
        """Distinct contexts of shared anchors in the order of their bucket, the bucket and high anchor bits of each,
        and the occurrences: place among the contexts, document, first window."""
        known: dict[bytes, int] = {}
        found = []
        for x, doc, shift, low, high, h in self.anchors() if len(shared) else ():
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            own = np.flatnonzero(shared[at] == h)
            body = x.tobytes()
            place = [known.setdefault(body[a:b], len(known)) for a, b in zip(low[own].tolist(), (high[own] + LENGTH).tolist())]
            found.append((np.array(place, np.int64), doc[own], low[own] + shift[own], h[own]))
        place, doc, first, h = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        anchor = np.zeros(len(known), np.uint64)
        anchor[place] = h  # equal bytes have equal anchors
        bucket = _bucket(anchor, buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        texts = list(known)
        return [texts[i] for i in order.tolist()], bucket[order], (anchor[order] >> np.uint64(32)).astype(np.uint16), to[place], doc, first


def suffix_array(x: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of x sorted by their first `depth` bytes (at least), and each suffix's group: equal that far. Doubling on ties only."""
    n = len(x)
    key = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k, shift in ((1, 8), (2, 16), (4, 32)):
        key = (key[:-k] << np.uint64(shift)) | key[k:]
    key = key[:n]
    order = np.argsort(key).astype(np.int64)
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = place
    k = 8
    while k < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        key = (rank[own] << 32) | (rank[own + k] + 1)
        by = np.argsort(key, kind="stable")
        order[at] = own = own[by]
        key = key[by]
        new[at] |= np.concatenate([[True], key[1:] != key[:-1]])
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = place
        k *= 2
    return order, rank[:n]


def expand_intervals(x: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Borders, in suffix order, between suffixes that differ within `length` symbols. Common prefixes are derived by
    increasing value, breadth first: a round extends the intervals that are new since the last one backward by every
    symbol of the transform, and a border that shows in round l stands for a common prefix of l symbols. Neighbours not
    parted before `length` share that many symbols.

    The rows that begin with a symbol are, in order, those whose transform holds it: row `forward[q]` is the extension
    of row q by its symbol. Two neighbouring extensions part as soon as their rows lie in different intervals, so only
    the extensions of rows whose interval has a new name are looked at; the largest part of an interval keeps its name,
    so that a row is renamed log n times at most."""
    n = len(x)
    back = np.argsort(x[order - 1], kind="stable").astype(np.int32)  # the transform, sorted: symbol counts and ranks
    forward = np.empty(n, np.int32)
    forward[back] = np.arange(n, dtype=np.int32)
    symbol = x[order]
    border = np.ones(n + 1, bool)
    border[1:-1] = symbol[1:] != symbol[:-1]
    last = int(np.flatnonzero(order == n - 1)[0])  # the last suffix has no symbol after its first
    border[last] = border[last + 1] = True
    name = np.cumsum(border[:-1], dtype=np.int32) - 1
    names = int(name[-1]) + 1
    low, high = np.empty(n + 1, np.int32), np.empty(n + 1, np.int32)  # of each interval, by name
    edge = np.flatnonzero(border)
    low[:names], high[:names] = edge[:-1], edge[1:]
    queue, due = np.flatnonzero(~border[:-1]), np.zeros(n + 1, bool)
    for _ in range(length - 1):
        new = queue[name[back[queue]] != name[back[queue - 1]]]
        if not len(new):
            break
        border[new] = True
        first = np.flatnonzero(np.concatenate([[True], name[new[1:]] != name[new[:-1]]]))
        parent, cuts = name[new[first]], np.diff(np.append(first, len(new)))
        start, end = np.empty(len(new) + len(first), np.int32), np.empty(len(new) + len(first), np.int32)
        at = np.arange(len(new)) + np.repeat(np.arange(1, len(first) + 1), cuts)
        start[at], end[at - 1] = new, new
        head = first + np.arange(len(first))
        start[head], end[head + cuts] = low[parent], high[parent]
        size = end - start
        largest = np.where(size == np.repeat(np.maximum.reduceat(size, head), cuts + 1), np.arange(len(size)), len(size))
        largest = np.minimum.reduceat(largest, head)
        low[parent], high[parent] = start[largest], end[largest]
        other = np.ones(len(size), bool)
        other[largest] = False
        start, end, size = start[other], end[other], size[other]
        low[names : names + len(size)], high[names : names + len(size)] = start, end
        rows = np.arange(int(size.sum()), dtype=np.int32) + np.repeat(start - (np.cumsum(size) - size).astype(np.int32), size)
        name[rows] = np.repeat(np.arange(names, names + len(size), dtype=np.int32), size)
        names += len(size)
        extended = forward[rows]
        due[extended] = due[extended + 1] = True
        queue = np.flatnonzero(due[:-1] & ~border[:-1])
        due[extended] = due[extended + 1] = False
    return border[:-1]


def first_places(contexts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts with the least doc_id of each: the least doc_id that has each window's string, all windows end
    to end; where each context's windows begin; and their number."""
    x = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # no UTF-8 text has this byte
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    windows = size - LENGTH + 1
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    owner = np.repeat(least, windows)
    order, _ = suffix_array(x)
    border = expand_intervals(x, order)
    value = np.full(len(x), NEVER, np.int64)
    value[at] = owner
    start = np.flatnonzero(border)
    lowest = np.minimum.reduceat(value[order], start)
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(lowest, np.diff(np.append(start, len(x))))
    return out[at], np.cumsum(windows) - windows, windows


def _rows(batch: pa.RecordBatch):
    """A batch's rows one at a time: its blobs needn't all be copied at once."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _batches(rows, schema: pa.Schema, most: int = 8):
    for i in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + most]), schema)], schema=schema)


def _table(rows, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("hashes", pa.binary()), ("two", pa.binary())])
_SHARED = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "c", "d"))])
_CONTEXTS = pa.schema([("bucket", pa.int32()), ("cell", pa.int32()), ("parts", pa.binary()), ("sizes", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("body", pa.binary())])
_DDL = {
    "anchors": "bucket int, cell int, hashes binary, two binary",
    "shared": "cell int, kind int, bucket int, a binary, b binary, c binary, d binary",
    "contexts": "bucket int, cell int, parts binary, sizes binary, least binary, most binary, body binary",
}


def _shared(batches):
    """Buckets of anchors -> for each cell the anchors that two documents have."""

    def bucket(k, parts):
        cell = np.concatenate([np.full(len(h), c, np.int32) for c, h, _ in parts])
        h, two = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(h, kind="stable")
        h, cell, two = h[order], cell[order], two[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(start, len(h)))
        keep = np.repeat((length > 1) | np.logical_or.reduceat(two, start), length)
        h, cell = h[keep], cell[keep]
        order = np.argsort(cell, kind="stable")
        h, cell = h[order], cell[order]
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        rows = [(int(cell[a]), 0, k, _planes(np.diff(h[a:b], prepend=np.uint64(0))), None, None, None) for a, b in zip(edge, np.append(edge[1:], len(h)))]
        yield from _batches(rows, _SHARED, 64)

    held, parts = None, []
    for batch in batches:
        for k, cell, hashes, two in _rows(batch):
            if k != held and parts:
                yield from bucket(held, parts)
                parts = []
                release()
            held = k
            parts.append((cell, np.cumsum(_unplanes(hashes, np.uint64)), np.frombuffer(two, bool)))
    if parts:
        yield from bucket(held, parts)
    del parts
    release()


def _places(batches):
    """Buckets of contexts -> for each cell, of its contexts that hold strings with an earlier place: place of the
    context, first window and number of windows of a run, least doc_id."""

    def bucket(k, parts):
        known: dict[bytes, int] = {}
        part_of: list[int] = []
        ids, least = [], []
        for _, part, sizes, low, _, body in parts:
            end = np.cumsum(sizes)
            own = []
            for p, a, b in zip(part.tolist(), (end - sizes).tolist(), end.tolist()):
                c = body[a:b]
                if (i := known.get(c)) is None:
                    i = known[c] = len(known)
                    part_of.append(p)
                own.append(i)
            ids.append(np.array(own, np.int64))
            least.append(low)
        lowest = np.full(len(known), NEVER, np.int64)
        np.minimum.at(lowest, np.concatenate(ids), np.concatenate(least))
        texts = list(known)
        shares = 1 + sum(map(len, texts)) // ARRAY_BYTES  # equal strings have one anchor, so one array need not hold them all
        share = np.array(part_of, np.int64) * shares >> (ANCHOR_BITS - 32)
        found: list[list[tuple]] = [[] for _ in parts]
        local = np.full(len(texts), -1, np.int64)
        for s in range(shares):
            members = np.flatnonzero(share == s)
            if not len(members):
                continue
            value, begin, _ = first_places([texts[i] for i in members], lowest[members])
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            new[begin] = True
            run = np.flatnonzero(new)
            run_size = np.diff(np.append(run, len(value)))
            first_run = np.searchsorted(run, begin)
            runs = np.diff(np.append(first_run, len(run)))
            earliest = np.minimum.reduceat(value, begin)
            local[members] = np.arange(len(members))
            for out, own, (_, _, _, _, most, _) in zip(found, ids, parts):
                some = np.flatnonzero(local[own] >= 0)
                some = some[earliest[local[own[some]]] < most[some]]
                if len(some):
                    c = local[own[some]]
                    n = runs[c]
                    r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_run[c], n)
                    useful = value[run[r]] < np.repeat(most[some], n)
                    r = r[useful]
                    out.append((np.repeat(some, n)[useful], run[r] - np.repeat(begin[c], n)[useful], run_size[r], value[run[r]]))
            local[members] = -1
        rows = [(part[0], 1, k, *(_planes(np.concatenate(v).astype(t)) for v, t in zip(zip(*out), (np.int32, np.int32, np.int32, np.int64)))) for part, out in zip(parts, found) if out]
        yield from _batches(rows, _SHARED, 64)

    held, parts = None, []
    for batch in batches:
        for k, cell, part, sizes, least, most, body in _rows(batch):
            if k != held and parts:
                yield from bucket(held, parts)
                parts = []
                release()
            held = k
            parts.append((cell, _unplanes(part, np.uint16), _unplanes(sizes, np.int32).astype(np.int64), _unplanes(least), _unplanes(most), body))
    if parts:
        yield from bucket(held, parts)
    del parts
    release()


def _read_shared(messages: pa.Table) -> np.ndarray:
    rows = messages.filter(pc.equal(messages.column("kind"), 0)) if messages.num_rows else messages
    parts = [np.cumsum(_unplanes(b, np.uint64)) for b in rows.column("a").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, *keep: str, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; the columns in keep are passed on, and `kept` (what
    remains, as text, without the torn characters at cuts) is added if text is asked for."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, cells = max(partitions, size // BUCKET_BYTES), max(CELLS * partitions, size // CELL_BYTES)
    dealt = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("_body"))), F.lit(cells)).cast("int")
    own = docs.select("doc_id", F.col("text").cast("binary").alias("_body"), *named(*keep)).withColumn("cell", dealt)

    def find_anchors(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        return _table([(k, cell, _planes(np.diff(h, prepend=np.uint64(0))), two.tobytes()) for k, h, two in Cell(table).shared_anchors(buckets)], _ANCHORS)

    def find_contexts(table: pa.Table, messages: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and messages.num_rows:
            cell = Cell(table)
            texts, bucket, part, place, doc, _ = cell.contexts(_read_shared(messages), buckets)
            least, most = np.full(len(texts), NEVER, np.int64), np.full(len(texts), -NEVER, np.int64)
            np.minimum.at(least, place, cell.doc[doc])
            np.maximum.at(most, place, cell.doc[doc])
            sizes, number = np.array([len(t) for t in texts], np.int32), table.column("cell")[0].as_py()
            for k, a, b in _runs(bucket):
                rows.append((k, number, *(_planes(v[a:b]) for v in (part, sizes, least, most)), b"".join(texts[a:b])))
        out = _table(rows, _CONTEXTS)
        del rows
        release()
        return out

    def cut(table: pa.Table, messages: pa.Table) -> pa.Table:
        cell = Cell(table)
        size = np.array([len(t) for t in cell.texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1  # one byte between documents parts their spans
        cover = np.zeros(int((size + 1).sum()) + 1, np.int32)
        found = messages.filter(pc.equal(messages.column("kind"), 1)) if messages.num_rows else messages
        if found.num_rows:
            _, bucket, _, place, doc, first = cell.contexts(_read_shared(messages), buckets)
            order = np.argsort(place, kind="stable")
            key, doc, first = place[order], doc[order], first[order]
            for k, a, b, c, d in zip(*(found.column(n).to_pylist() for n in ("bucket", "a", "b", "c", "d"))):
                wanted = np.searchsorted(bucket, k) + _unplanes(a, np.int32).astype(np.int64)
                low, run, earlier = _unplanes(b, np.int32), _unplanes(c, np.int32), _unplanes(d)
                lo, hi = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
                n = hi - lo
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                later = cell.doc[doc[at]] > np.repeat(earlier, n)
                start = (begin[doc[at]] + first[at] + np.repeat(low, n))[later]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + np.repeat(run, n)[later] - 1 + LENGTH, -1)
        gone = np.cumsum(cover) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        rises = np.concatenate([[0], np.cumsum(gone[1:] & ~gone[:-1])])
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, t in enumerate(cell.texts):
            a, b = int(begin[i]), int(begin[i] + size[i])
            removed = int(total[b] - total[a])
            kept = np.frombuffer(t, np.uint8)[~gone[a:b]].tobytes() if removed else t
            for name, v in zip(out, (cell.ids[i], len(t), removed, int(rises[b - 1] - rises[a] + gone[a]) if removed else 0, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if text else None)):
                out[name].append(v)
        if not text:
            out.pop("kept")
        kinds = {"doc_id": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        columns = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()}
        release()
        passed = table.take(pa.array(cell.order, pa.int64()))
        return pa.table({**columns, **{c: passed.column(c) for c in keep}})

    grouped = own.groupBy("cell")
    found = grouped.applyInArrow(find_anchors, _DDL["anchors"])
    shared = found.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "cell").mapInArrow(_shared, _DDL["shared"])
    contexts = grouped.cogroup(shared.groupBy("cell")).applyInArrow(find_contexts, _DDL["contexts"])
    places = contexts.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "cell").mapInArrow(_places, _DDL["shared"])
    longs = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    strings = [T.StructField(c, T.StringType()) for c in ("kept_sha256", *["kept"] * text)]
    schema = T.StructType([*longs, *strings, *(own.schema[c] for c in keep)])
    return grouped.cogroup(shared.unionByName(places).groupBy("cell")).applyInArrow(cut, schema)
