"""Word shingles of whole texts as sorted 52-bit hashes, a block of documents at a time in numpy.

A text's words are the matches of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Its set holds the
distinct runs of ``width`` words; a text with fewer words has one element, its whole sequence; a text
without words (or a null) has none. Bytes are hashed with a random code per byte and a polynomial
modulo 2^64, so the cost is a few array passes per byte and none per word.
"""

from __future__ import annotations

import numpy as np

HASH_BITS = 52
DOCS_PER_BLOCK = 1 << (64 - HASH_BITS)
BYTES_PER_BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20_240_611))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# An odd multiplier for each place of a word in its shingle, drawn independently.
_PLACE = np.random.Generator(np.random.PCG64(20_240_612)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) on a uint64 array."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _follow(s: np.ndarray, word: np.ndarray, place: int) -> np.ndarray:
    """The hash of a run of words that goes on with a word: not linear in the place, so that the order of words counts."""
    s = s ^ (s >> np.uint64(29))
    s *= _PLACE[place % len(_PLACE)]
    s ^= s >> np.uint64(32)
    s += word
    return s


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, BYTES_PER_BLOCK * 2)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a)
    return _POWERS["up"], _POWERS["down"]


def blocks(texts: list[bytes | None]):
    """Cut a list of texts into (first, last) ranges of bounded bytes and documents; a longer text is its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and (size + n > BYTES_PER_BLOCK or i - first >= DOCS_PER_BLOCK):
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and each text's first word index (length len(texts) + 1)."""
    joined = b" ".join(t or b"" for t in texts) + b" "
    b = np.frombuffer(joined, np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=at[1:])
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODE[b] * up[: len(b)], out=total[1:])
    space = np.empty(len(b) + 1, bool)
    space[0] = True
    space[1:] = _SPACE[b]
    turn = np.flatnonzero(space[1:] != space[:-1])
    start, end = turn[0::2], turn[1::2]
    h = mix((total[end] - total[start]) * down[start])
    return h, np.searchsorted(start, at)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of at most DOCS_PER_BLOCK texts, end to end, and each text's bounds."""
    h, first = word_hashes(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    keep = np.zeros(0, np.uint64)
    if len(h) >= width:
        s = h[: len(h) - width + 1]
        for k in range(1, width):
            s = _follow(s, h[k : len(h) - width + 1 + k], k)
        whole = doc[: len(s)] == doc[width - 1 :]
        keep = (doc[: len(s)][whole] << np.uint64(HASH_BITS)) | (mix(s[whole]) >> np.uint64(64 - HASH_BITS))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        few = n[short].astype(np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            few[has] = _follow(few[has], h[first[short[has]] + k], k)
        few = mix(few) >> np.uint64(64 - HASH_BITS)
        keep = np.concatenate([keep, (short.astype(np.uint64) << np.uint64(HASH_BITS)) | few])
    keep.sort()
    if len(keep):
        keep = keep[np.concatenate([[True], keep[1:] != keep[:-1]])]
    bound = np.searchsorted(keep, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(HASH_BITS)) if len(texts) < DOCS_PER_BLOCK else np.append(
        np.searchsorted(keep, np.arange(len(texts), dtype=np.uint64) << np.uint64(HASH_BITS)), len(keep))
    return keep & np.uint64((1 << HASH_BITS) - 1), bound
