"""A local hashing embedding: character n-grams, words and word pairs are hashed to coordinates and counted."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 768


def slot(feature: str, size: int = SIZE) -> int:
    h = 5381
    for c in feature:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h) % size


def embed(content: str | None, size: int = SIZE) -> list[float]:
    """Counts of 3-, 4- and 5-grams (1), words over two characters (2) and neighbouring words (3), square roots, unit length."""
    t = re.sub(r"\s+", " ", (content or "").lower()).strip()
    v = np.zeros(size)
    for n in (3, 4, 5):
        for i in range(len(t) - n + 1):
            v[slot(t[i : i + n], size)] += 1
    words = [w for w in re.findall(r"\w+", t) if len(w) > 2]
    for w in words:
        v[slot(w, size)] += 2
    for a, b in zip(words, words[1:]):
        v[slot(f"{a} {b}", size)] += 3
    v = np.sqrt(v)
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def embeddings(rows: DataFrame, key: str, content: str, size: int = SIZE) -> DataFrame:
    """key, embedding (float array of unit length; zeros for an empty text)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([embed(t, size) for t in b.column(1).to_pylist()], pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(F.col(key).cast("long").alias(key), content).mapInArrow(run, f"{key} long, embedding array<float>")


def encode(vector: list[float]) -> bytes:
    """Little-endian float32 of unit length; refuses values that aren't finite."""
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        raise ValueError("a vector must be finite")
    return (v / (np.linalg.norm(v) or 1.0)).astype("<f4").tobytes()


def decode(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<f4")
