"""Vectorised 64-bit hashes of the words and word shingles of whole texts.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A word's
hash is a polynomial over random byte values, taken for a whole slice of text
at once and followed by a mixer, so no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes hashed at once
U = np.uint64
_rng = np.random.default_rng(20240229)
_BASE = 0x9E3779B97F4A7C15 | 5


def _byte_values() -> np.ndarray:
    values = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


_VALUES = _byte_values()
_STEP = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (U(_BASE), U(pow(_BASE, -1, 1 << 64)))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _hash_slice(data: np.ndarray) -> np.ndarray:
    values = _VALUES[data]
    inside = values != 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    if not len(starts):
        return np.empty(0, U)
    up, down = _tables(len(data))
    sums = np.add.reduceat(values * up[: len(data)], starts)
    return mix(sums * down[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) <= SLICE:
        return _hash_slice(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):  # cut after the last space of the slice, or grow it
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            end = min(end + SLICE, len(data))
        parts.append(_hash_slice(data[at:end]))
        at = end
    return np.concatenate(parts)


def batch_word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """``word_hashes`` of each text; short texts are hashed together."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        bounds = np.cumsum([len(b) + 1 for b in group])
        values = _VALUES[data]
        inside = values != 0
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        hashes = _hash_slice(data)
        ends = np.searchsorted(starts, bounds)
        yield from np.split(hashes, ends[:-1])

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if size + len(raw) > SLICE and group:
            yield from flush()
            group, size = [], 0
        if len(raw) > SLICE:
            yield word_hashes(text)
        else:
            group.append(raw)
            size += len(raw) + 1
    if group:
        yield from flush()


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a word sequence.

    A sequence shorter than ``size`` is one shingle as a whole; an empty one has none.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, U)
    if n < size:
        return mix((words * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + U(n))
    total = words[: n - size + 1] * _STEP[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * _STEP[k]
    return np.unique(mix(total))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: what a worker holds of texts at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
