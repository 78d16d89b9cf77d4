"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions in time linear in the features, by the sum-of-squares identity. Features are each distinct word
(hashed to a bucket, weighted by its share of the text), structure statistics cut into bands (shares of capitals,
digits, symbols and separators, word and line lengths, repetition) and metadata of the text (bands of its length).

Defined results: null and empty texts have only their bands as features and a score like any other text; null
labels are not learned, repeated labels of a document count once (the largest); without labels all scores are
0.5; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.samples import labelled_sample

BUCKETS = 1 << 14
BANDS = 16
FACTORS = 8
#: Bound of the training sample, in rows.
TRAIN_ROWS = 4000
EPOCHS = 12
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # of a byte: 0 other, 1 capital, 2 small, 3 digit, 4 white space, 5 line end, 6 symbol, 7 separator, 8 beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in "!#$%&*+<=>@^_`~\\/"]] = 6
_CLASS[[ord(c) for c in "|{}[]();:"]] = 7
_CLASS[128:] = 8
STATISTICS = ("capitals", "digits", "symbols", "separators", "white", "lines", "foreign", "word length", "repeated words", "commonest word", "repeated lines", "length")
WIDTH = BUCKETS + len(STATISTICS) * BANDS
_SEEN: dict[str, int] = {}


def _bucket(word: str) -> int:
    got = _SEEN.get(word)
    if got is None:
        if len(_SEEN) > 500_000:
            _SEEN.clear()
        got = _SEEN[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return got


def statistics(text: str, words: Counter, n_words: int) -> list[float]:
    """Each between 0 and 1."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(b))
    c = np.bincount(_CLASS[b], minlength=9)
    letters = max(1, int(c[1] + c[2] + c[8]))
    lines = [x for x in text.split("\n") if x]
    share = lambda x, most: min(1.0, x / most)
    return [
        c[1] / letters, share(c[3] / n, 0.2), share(c[6] / n, 0.3), share(c[7] / n, 0.2), share(c[4] / n, 0.4), share(c[5] / n, 0.05), c[8] / letters,
        share(n / max(1, n_words), 20), 1 - len(words) / max(1, n_words), max(words.values(), default=0) / max(1, n_words),
        1 - len(set(lines)) / max(1, len(lines)), share(np.log2(n + 1), 20),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; the values of words have a length of 1 together, each band counts 1/4."""
    text = text or ""
    words = Counter(text.split())
    total = sum(words.values())
    bands = [BUCKETS + i * BANDS + min(BANDS - 1, int(s * BANDS)) for i, s in enumerate(statistics(text, words, total))]
    index = np.array([*map(_bucket, words), *bands], np.int32)
    count = np.fromiter(words.values(), np.float64, len(words))
    norm = np.sqrt((count * count).sum()) or 1.0
    return index, np.concatenate([count / norm, np.full(len(bands), 0.5)]).astype(np.float32)


class Machine:
    """w0, w (WIDTH), v (WIDTH, FACTORS)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(WIDTH, np.float32)
        self.v = rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of rows end to end; first: where each begins. Every row has features."""
        vx = self.v[index] * value[:, None]
        linear = np.add.reduceat(self.w[index] * value, first)
        total, squares = np.add.reduceat(vx, first), np.add.reduceat(vx * vx, first)
        return self.w0 + linear + 0.5 * (total * total - squares).sum(1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        first = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        return 1 / (1 + np.exp(-np.clip(self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), first), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
        """Adagrad on the log loss, in small batches, with light weight decay."""
        rng, rate = np.random.default_rng(seed), 0.1
        gw, gv, g0 = np.full(WIDTH, 1e-4, np.float32), np.full((WIDTH, FACTORS), 1e-4, np.float32), 1e-4
        for _ in range(epochs if len(rows) else 0):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), 32):
                batch = order[a : a + 32]
                index, value = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
                size = [len(rows[i][0]) for i in batch]
                first = np.cumsum([0, *size[:-1]])
                error = (1 / (1 + np.exp(-np.clip(self.raw(index, value, first), -30, 30))) - labels[batch]).astype(np.float32)
                own = np.repeat(error, size)
                vx = self.v[index] * value[:, None]
                total = np.repeat(np.add.reduceat(vx, first), size, 0)
                dw, dv = own * value, (own * value)[:, None] * (total - vx)
                cells, at = np.unique(index, return_inverse=True)
                sw, sv = np.zeros(len(cells), np.float32), np.zeros((len(cells), FACTORS), np.float32)
                np.add.at(sw, at, dw)
                np.add.at(sv, at, dv)
                sw += 1e-4 * self.w[cells]
                sv += 1e-3 * self.v[cells]
                gw[cells] += sw * sw
                gv[cells] += sv * sv
                self.w[cells] -= rate * sw / np.sqrt(gw[cells])
                self.v[cells] -= 0.3 * rate * sv / np.sqrt(gv[cells])
                d0 = float(error.sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Features are made on the executors; the driver gets those of at most `rows` rows."""

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary()), b.column(1), b.column(2)], ["i", "x", "label", "doc_id"])

    sample = labelled_sample(docs, labels, label, rows).select("text", "label", "doc_id").mapInArrow(run, "i binary, x binary, label int, doc_id long")
    got = sorted(sample.collect(), key=lambda r: r.doc_id)
    return Machine().fit([(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32)) for r in got], np.array([r.label for r in got], np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for a in range(0, len(texts), 64):
                out.append(shared.value.score([features(t) for t in texts[a : a + 64]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text), learned from labels (doc_id, quality)."""
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
