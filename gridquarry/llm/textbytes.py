"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Word bytes are the ASCII digits and letters and every byte of a non-ASCII
character; ASCII letters are lower-cased. That is the word pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def text_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) in slices of about ``most``
    bytes, one row at least; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        missing = np.asarray(column.is_null())
        if (np.diff(offsets)[missing] > 0).any():  # rare: bytes under a null
            yield from text_slices(column.fill_null(""), most)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(low: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per row the index of its first word
    (one more entry at the end); words don't cross rows. ``table``: which bytes
    belong to words."""
    inside = table[low]
    before = np.zeros(len(low), dtype=bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(low)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _BASE
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """One 64-bit hash a word, in blocks of about ``most`` bytes so that the
    temporary arrays stay small for texts of any length."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    if not n:
        return out
    powers = _powers(int((ends - starts).max()))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, "right")))
        size = ends[lo:hi] - starts[lo:hi]
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        letters = low[place + np.repeat(starts[lo:hi], size)].astype(np.uint64) + np.uint64(1)
        out[lo:hi] = np.add.reduceat(letters * powers[place], begin)
        lo = hi
    return mixed(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _BASE + words[j : j + n]
    return mixed(h)
