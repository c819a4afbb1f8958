"""Vectorised byte kernels over Arrow string columns: words, word hashes, shingles.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 keeps
those bytes out of multi-byte characters, so bytes give the same words as code
points. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(n: int, seed: int) -> np.ndarray:
    """n 64-bit constants from a counter (splitmix64)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = _mixed(256, 11) | U64(1)
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_COMBINE = _mixed(64, 23) | U64(1)
_BASE = U64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each row and the end) of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    size = 8 if wide else 4
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * size).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word, index of each row's first word and the end), bytes counted in ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data[lo:hi]]
    cut = np.zeros(hi - lo + 1, bool)
    cut[offsets - lo] = True
    before = np.empty(hi - lo, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1])) + lo
    after = np.empty(hi - lo, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` reads A-Z as a-z, ``table`` gives each byte's own value."""
    global _POWERS
    table = table if table is not None else _LOWER if lower else _BYTE
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    if n and int((ends - starts).max()) > len(_POWERS):
        _POWERS = _powers(2 * int((ends - starts).max()))
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lengths = ends[i:j] - starts[i:j]
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
        at = within + np.repeat(starts[i:j], lengths)
        out[i:j] = np.add.reduceat(table[data[at]] * _POWERS[within], first)
        i = j
    return mix(out)


def runs(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word runs inside a row: (hash, index of first word, index of each row's first run and the end)."""
    counts = np.maximum(np.diff(rows) - (k - 1), 0)
    if len(hashes) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    n = len(hashes) - k + 1
    h = hashes[:n] * _COMBINE[0]
    for i in range(1, k):
        h += hashes[i : n + i] * _COMBINE[i]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(int(ends[-1])) - np.repeat(ends[:-1], counts) + np.repeat(rows[:-1], counts)
    return mix(h[at]), at, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's set of k-word shingles of lower-cased words, as sorted distinct hashes.

    Fewer than k words make one shingle of the whole sequence; no words, the empty set.
    """
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    h, _, cuts = runs(hashes, rows, k)
    out = []
    for r in range(len(offsets) - 1):
        a, b = rows[r], rows[r + 1]
        if b - a >= k:
            s = np.sort(h[cuts[r] : cuts[r + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = (hashes[a:b] * _COMBINE[: b - a]).sum(dtype=U64, keepdims=True) + _COMBINE[32 + b - a : 33 + b - a]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, U64))
    return out


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each row; offsets count from the first row's start."""
    offsets = offsets - offsets[0]
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(flags[: offsets[-1]], offsets[full], dtype=np.int64)
    return out
