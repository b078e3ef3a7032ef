"""Vectorised helpers over Arrow batches of UTF-8 text, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_OTHER_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
with np.errstate(over="ignore"):
    _POWER, _OTHER_POWER = (np.cumprod(np.full(65536, b, np.uint64)) for b in (_BASE, _OTHER_BASE))


def batch_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20):
    """Slices of a batch with about ``limit`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and the offset of each; null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    if array.offset:
        array = pa.concat_arrays([array])
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def split_words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = BLANK):
    """Start and end byte of each word and the row it belongs to."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``other`` ones are made from tables of their own."""
    table, powers = (_OTHER_TABLE, _OTHER_POWER) if other else (_TABLE, _POWER)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    to = np.cumsum(size)
    pos = np.arange(to[-1]) - np.repeat(to - size, size)
    at = pos + np.repeat(starts, size)
    with np.errstate(over="ignore"):
        power = powers[pos & 0xFFFF]
        if size.max() > 0xFFFF:
            power = power + (pos >> 16).astype(np.uint64) * table[7]
        return mix(np.add.reduceat(table[buf[at]] * power, to - size) + size.astype(np.uint64))


def grams(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hashes of n consecutive hashes, one for each start; mind the rows' ends yourself."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    f, m = np.uint64(factor), len(h) - n + 1
    with np.errstate(over="ignore"):
        g = h[:m].copy()
        for j in range(1, n):
            g *= f
            g += h[j : j + m]
    return mix(g)
