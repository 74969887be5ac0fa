"""Vectorised text work on the bytes of an Arrow string column: words, word hashes, shingles.

A column's texts are one byte array with offsets. White space is ASCII, so a UTF-8 text splits into words bytewise. All
functions work on slices of bounded size, so memory follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
CHUNK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_KEYS = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) ^ (0xA0761D6478BD642F << 1)) & (2**64 - 1) | 1 for i in range(8)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            a = np.full(max(n, CHUNK_BYTES + 1), b, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n, i + 65536)
        yield i, j
        i = j


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    p, inv = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, p[:-1], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _KEYS[7])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's range of words (offsets)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev = np.zeros(len(data), bool)
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | edge[:-1]))
    nxt = np.zeros(len(data), bool)
    nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z folded, and each text's range of words."""
    starts, ends, at = words(data, off)
    return spans_hash(FOLD[data], starts, ends), at


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in text order, and their text's number. A text of fewer words has one shingle, the whole
    sequence; one without words has none."""
    count = np.diff(at)
    n = np.maximum(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        out += hashes[j : j + n] * _KEYS[j]
    text = np.repeat(np.arange(len(count)), count)
    ok = text[:n] == text[k - 1 :] if n else np.zeros(0, bool)
    out, owner = mix(out[ok]), text[:n][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = count[short].astype(np.uint64) * _KEYS[6]
        for j in range(k - 1):
            has = count[short] > j
            whole[has] += hashes[at[short[has]] + j] * _KEYS[j]
        out, owner = np.concatenate([out, mix(whole)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values in order, and the owners' offsets into them. owner is in order."""
    v, at = values.copy(), np.searchsorted(owner, np.arange(n + 1))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            v[i:j].sort()
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[at[:-1][at[:-1] < len(v)]] = True
    return v[new], np.concatenate([[0], np.cumsum(new)])[at]
