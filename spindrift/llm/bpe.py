"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

A text is cut into pieces by the pattern of the vocabulary; pieces that repeat are encoded once. The pieces of a
block are bucketed by length; a bucket is a padded matrix of token ids, one row a piece. In each round every row
looks up the ranks of its adjacent pairs in a hash table (open addressing over two flat arrays), merges its
leftmost pair of least rank and is compacted, until no row has a pair with a rank. A piece that is a token itself
is that token. A piece longer than LONG bytes is a matrix of one row, in which a round merges all places of the pair
of least rank at once, if the vocabulary shows that this changes nothing.

Defined results: null and empty texts have no ids and decode to nothing; invalid surrogates can't occur in Spark
strings; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256
CACHE = 400_000
BLOCK_BYTES = 1 << 20
NONE = np.int32(2**31 - 1)

_SPACED = re.compile(r"\s \s|\s \Z")


class Pairs:
    """Hash table from a pair of token ids to the token that they merge to: two arrays, linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(left) * 4 + 1))))
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 1
        while len(todo):
            free = self.keys[slot[todo]] < 0
            take, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[take], self.values[take] = key[won], merged[won]
            lost = np.ones(len(key), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            if len(todo):
                slot[todo] = (slot[todo] + 1) & int(self.mask)
                self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], NONE)
        open_ = np.flatnonzero((got != key) & (got >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            got = self.keys[slot[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out


class Codec:
    """Encoder and decoder of one vocabulary: bytes -> rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = Pairs(*np.array(splits, np.int64).T)
        self.safe = np.ones(len(self.bytes), bool)  # tokens that no pair turns into one of lower rank
        for a, b, i in splits:
            self.safe[[x for x in (a, b) if i < x]] = False
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of similar length."""
        size = np.array([len(p) for p in pieces])
        rows, width = len(pieces), int(size.max())
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.start[flat].reshape(rows, width)
        out: list[bytes] = [b""] * rows
        own = np.arange(rows)
        inside = np.arange(width - 1)[None, :] < (size - 1)[:, None]
        rank = np.full((rows, width - 1), NONE, np.int32)
        rank[inside] = self.pairs.find(ids[:, :-1][inside], ids[:, 1:][inside])
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(own), np.int64)
            best = rank[np.arange(len(own)), at] if rank.shape[1] else np.full(len(own), NONE)
            going = best != NONE
            if not going.all():
                packed = ids.astype("<u4")
                for r in np.flatnonzero(~going):
                    out[own[r]] = packed[r, : size[r]].tobytes()
                ids, rank, size, own, at, best = ids[going], rank[going], size[going], own[going], at[going], best[going]
                if not len(own):
                    return out
            line = np.arange(len(own))
            ids[line, at] = best
            columns = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.where(columns <= at[:, None], ids[:, :-1], ids[:, 1:])  # compaction: all that follows moves one to the left
            rank = np.where(columns[:, :-1] < at[:, None], rank[:, :-1], rank[:, 1:])
            size = size - 1
            left = np.flatnonzero(at > 0)
            if len(left):
                rank[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < size - 1)
            if len(right):
                rank[right, at[right]] = self.pairs.find(ids[right, at[right]], ids[right, at[right] + 1])

    def _merge_row(self, piece: bytes) -> bytes:
        """One long piece, a matrix of one row: a round merges all places of the row's pair of least rank, from the left.

        That is what as many rounds of the leftmost place alone would do, as long as no pair with the new token is of lower
        rank than the token: what a merge brings about then never comes before the places left of its kind. Where some
        pair is, a round merges the leftmost place alone."""
        ids = self.start[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if self.safe[best]:
                run = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))  # of overlapping places every other one counts
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            else:
                at = at[:1]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[k] = r.to_bytes(4, "little")
            elif len(p) > LONG:
                out[k] = self._merge_row(p)
            elif p:
                buckets.setdefault(len(p) if len(p) < 24 else -(-len(p) // 16) * 16, []).append(k)
        for members in buckets.values():
            for a in range(0, len(members), 8192):
                part = members[a : a + 8192]
                for k, got in zip(part, self._merge_matrix([pieces[k] for k in part])):
                    out[k] = got
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts.

        Texts are cut at single spaces first, and each word with its space is looked up among those met before: a
        space between two characters that aren't white space always begins a match of the pattern. Where white
        space meets a space on both sides, the pattern is run over the whole text.
        """
        plans: list[list[str]] = []
        new: dict[str, None] = {}
        cache = self.cache
        for t in texts:
            if ("  " in t or "\n " in t or "\t " in t or " \n" in t or not t.isprintable() and _SPACED.search(t)) and _SPACED.search(t):
                words = self.find(t)
            else:
                words = t.split(" ")
                words = [words[0], *(" " + w for w in words[1:])]
            plans.append(words)
            new.update(dict.fromkeys(w for w in words if w not in cache))
        if new:
            matches = [self.find(w) for w in new]
            pieces = list({p: None for m in matches for p in m})
            done = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
            if len(cache) + len(new) > CACHE:
                keep = {w: cache[w] for plan in plans for w in plan if w in cache}
                cache.clear()
                cache.update(keep)
            for w, m in zip(new, matches):
                cache[w] = b"".join([done[p] for p in m])
        return [b"".join([cache[w] for w in words]) for words in plans]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    if name not in _CODECS:
        _CODECS[name] = Codec.load(tokenizer_path(name))
    return _CODECS[name]


def blocks(texts: list[str | None], most: int = BLOCK_BYTES):
    """Texts (null as empty) in blocks of about `most` characters; a longer text is a block of its own."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded again."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            rows = []
            for part in blocks(b.column(1).to_pylist()):
                for ids in c.encode(part):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array of int) of every whole text."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for part in blocks(b.column(1).to_pylist()) for x in c.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
