"""Word shingle hashes of many texts at a time, on the bytes of an Arrow column.

A word is a maximal run of letters and digits, with A-Z as a-z; every code point beyond
ASCII counts as a letter. A shingle is ``width`` consecutive words. A text of fewer words,
but not none, has one shingle of all of them.
Every step is vectorised over a slice of about a megabyte of text, so memory stays
bounded by the slice or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
WIDTH = 5

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[[b for b in range(128) if not chr(b).isalnum()]] = 0
_BYTE[65:91] = _BYTE[97:123]
_BETWEEN = _BYTE == 0
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` bytes each, of at least one item."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, upto
        at = upto


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the index of its text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~_BETWEEN[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = letter[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gaps = np.diff(np.append(starts, len(data)))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, gaps)
    value = _BYTE[data[starts[0]:]] * _POWERS[within & 4095]
    if within.max(initial=0) >= 4096:
        value = np.where(within >= 4096, mix(value + (within >> 12).astype(np.uint64)), value)
        value[_BETWEEN[data[starts[0]:]]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(offsets, starts, side="right") - 1


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each text where its own begin (n + 1 offsets)."""
    data, offsets = raw(texts)
    h, owner = words(data, offsets)
    counts = np.bincount(owner, minlength=len(texts))
    full = np.maximum(counts - width + 1, 0)
    made = np.where(counts > 0, np.maximum(full, 1), 0)
    at = np.concatenate([[0], np.cumsum(made)])
    word_at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], np.uint64)
    if len(h) >= width:
        sums = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            sums += h[j:len(h) - width + 1 + j] * _PLACE[j]
        inside = owner[:len(sums)] == owner[width - 1:]
        out[np.repeat(full > 0, made)] = sums[inside]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        few = h[word_at[i]:word_at[i + 1]]
        out[at[i]] = (few * _PLACE[:len(few)]).sum(dtype=np.uint64)
    return mix(out), at
