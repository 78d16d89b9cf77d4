"""Vector bin packing of training examples into fixed-length sequences, by the dot-product heuristic.

An example demands tokens, segments and loss-bearing tokens; a sequence has a limit on each. The packer keeps a
bounded pool of waiting examples. It fills one sequence at a time with the waiting example that fits and whose
demand has the largest dot product with what is left of the limits (both as shares of the limits). Examples that
may be cut fill the rest of a sequence exactly; the last segment that a sequence may have is the beginning of the
longest waiting example; what remains at the end of a partition goes into sequences of power-of-two lengths. So cut
examples leave no padding, unless a sequence has all its segments and none of those waiting is long enough.

Every partition packs its own rows in their order, without a shuffle: a sequence never spans partitions, and a
task that is run again gives the same sequences. sequence_id holds the partition and the sequence's number in it.

Defined results: a null text is empty and has the end id alone; repeated rows are packed each; a null example
demand counts as 0; an example beyond a limit that may not be cut gets a sequence of its own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tables import tokenizer_path

LENGTH = 1024
#: Pieces of documents in a sequence, at most.
SEGMENTS = 64
POOL = 2048
END = 0
#: The same vocabulary as byte_bpe_50k.json, as ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Packer:
    """limits: tokens, segments, loss-bearing tokens of a sequence. cut: examples may be cut anywhere; all their tokens but
    the last, the end id, bear loss."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, pool: int = POOL):
        self.limits, self.cut, self.size = np.array(limits, np.float64), cut, pool
        self.demand = np.zeros((2 * pool, 3))
        self.keys: list = []
        self.sequence = 0

    def add(self, key, tokens: int, segments: int, loss: int) -> Iterator[tuple]:
        """Yields (key, start, length, sequence, offset) of whatever is placed now; start counts within the added example."""
        start = 0
        if self.cut:
            full = int(min(self.limits[0], self.limits[2]))
            while tokens - start >= self.limits[0] and loss >= full:  # a full sequence by itself
                yield key, start, full, self.sequence, 0
                start += full
                loss -= full
                self.sequence += 1
            tokens -= start
            if not tokens:
                return
        self._wait((key, start), tokens, segments, loss)
        while len(self.keys) >= self.size:
            yield from self._fill(self.limits)

    def end(self) -> Iterator[tuple]:
        while self.keys:
            left = self.demand[: len(self.keys), 0].sum()
            if self.cut and left < self.limits[0]:
                yield from self._fill(np.minimum(self.limits, [2.0 ** int(np.log2(left)), np.inf, np.inf]))
            else:
                yield from self._fill(self.limits)

    def _wait(self, key, *demand) -> None:
        self.demand[len(self.keys)] = demand
        self.keys.append(key)

    def _take(self, i: int):
        """The i-th waiting example leaves; the last one takes its place."""
        key, demand, last = self.keys[i], self.demand[i].copy(), len(self.keys) - 1
        self.keys[i] = self.keys[last]
        self.demand[i] = self.demand[last]
        self.keys.pop()
        return key, demand

    def _part(self, i: int, most: float):
        """At most `most` tokens of the i-th waiting example, its beginning; the rest goes on waiting."""
        (key, start), d = self._take(i)
        some = int(min(most, d[0]))
        if some < d[0]:
            self._wait((key, start + some), d[0] - some, d[1], max(0.0, d[2] - some))
        return key, start, some, np.array([some, d[1], min(some, d[2])])

    def _fill(self, limits: np.ndarray) -> Iterator[tuple]:
        left, offset, number = limits.copy(), 0, self.sequence
        self.sequence += 1
        while self.keys and left[0] >= 1:
            waiting = self.demand[: len(self.keys)]
            fits = (waiting <= left).all(1)
            if self.cut and left[1] < 2:  # the last segment: the longest example, to the end or to a power of two
                if left[1] < 1 or left[2] < 1 and not fits.any():
                    return
                i = int(waiting[:, 0].argmax()) if left[2] >= 1 else int(np.where(fits, waiting[:, 0], -1).argmax())
                most = min(left[0], left[2] if waiting[i, 2] > left[2] else np.inf)
                if waiting[i, 0] < left[0] and 1 << int(offset + min(most, waiting[i, 0])).bit_length() - 1 > offset:
                    most = (1 << int(offset + min(most, waiting[i, 0])).bit_length() - 1) - offset
                key, start, some, _ = self._part(i, most)
                yield key, start, some, number, offset
                return
            if not fits.any():
                if not self.cut:
                    if not offset:  # beyond a limit by itself: a sequence of its own
                        (key, start), d = self._take(0)
                        yield key, start, int(d[0]), number, 0
                    return
                if left[2] < 1:
                    return
                key, start, some, d = self._part(int(np.argmin(waiting[:, 0])), min(left[0], left[2]))
            else:
                score = np.where(fits, (waiting / self.limits) @ (left / self.limits), -1.0)
                (key, start), d = self._take(int(score.argmax()))
                some = int(d[0])
            yield key, start, some, number, offset
            offset += some
            left -= d


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH)) -> DataFrame:
    """example_id (long), tokens, segments, loss_tokens -> example_id, sequence_id, offset. Examples stay whole."""

    def run(batches):
        packer, base = Packer(limits, cut=False), TaskContext.get().partitionId() << 32

        def out(placed):
            placed = list(placed)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in placed], pa.int64()), pa.array([base + p[3] for p in placed], pa.int64()), pa.array([p[4] for p in placed], pa.int64())], ["example_id", "sequence_id", "offset"])

        for b in batches:
            yield out(p for row in zip(*(c.to_pylist() for c in b.columns)) for p in packer.add(row[0], *(x or 0 for x in row[1:])))
        yield out(packer.end())

    return examples.select("example_id", *(F.col(c).cast("long") for c in ("tokens", "segments", "loss_tokens"))).mapInArrow(run, "example_id long, sequence_id long, offset long")


_ENCODERS: dict = {}


def added_tokens(name: str) -> dict[str, int]:
    """Tokens that the vocabulary's JSON form cuts out of a text before all else, with their ids."""
    with open(tokenizer_path(name.removesuffix(".tiktoken") + ".json"), "rb") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{name}: an added token that isn't plain text")
    return {t["content"]: t["id"] for t in tokens}


def encoder(name: str = VOCABULARY):
    """A function from a text to its ids as a uint32 array; one for each worker process."""
    if name not in _ENCODERS:
        import tiktoken

        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(name))

        def encode(text: str) -> np.ndarray:
            try:
                return coding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:  # a run of white space of about a million characters is more than its pattern search can take
                return np.array(plain_encoder(name).encode(text, add_special_tokens=False).ids, np.uint32)

        _ENCODERS[name] = encode
    return _ENCODERS[name]


def plain_encoder(name: str):
    """The vocabulary's JSON form in its own library, which is slower and takes any text; one for each worker process."""
    name = name.removesuffix(".tiktoken") + ".json"
    if name not in _ENCODERS:
        import tokenizers

        _ENCODERS[name] = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    return _ENCODERS[name]


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, segments: int = SEGMENTS) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    sequence has at most `length` tokens, `segments` pieces and `length` loss-bearing tokens; end ids bear no loss."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode, packer, base = encoder(vocabulary), Packer((length, segments, length), cut=True), TaskContext.get().partitionId() << 32

        def out(placed):
            rows = [(doc, base_start + start, size, zlib.crc32(ids[start : start + size].tobytes()), total, base + number, offset) for (doc, ids, total, base_start), start, size, number, offset in placed]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 7)], names)

        def documents(b):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or "").astype("<u4"), np.uint32(END)).astype("<u4")
                whole = len(ids) // length * length
                if whole:  # only the rest waits, so that the pool holds less than `length` ids of a document
                    yield from packer.add((doc, ids, len(ids), 0), whole, 1, whole)
                if whole < len(ids):
                    yield from packer.add((doc, ids[whole:].copy(), len(ids), whole), len(ids) - whole, 1, len(ids) - whole - 1)

        for b in batches:
            yield out(documents(b))
        yield out(packer.end())

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
