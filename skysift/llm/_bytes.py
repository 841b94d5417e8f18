"""Vectorised hashing of words and byte strings: whole batches in NumPy, no per-word Python.

A string's fingerprint is the sum of T[byte] * B**position modulo 2**64, with a random table T and an odd base B,
moved to position 0 by the inverse power of B. Prefix sums give every substring's value in a few array operations.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240611)
TABLE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
TABLE_B = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B**0 .. B**(n-1), or the same of B's inverse; kept for the next call."""
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        _powers[key] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_sums(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """P with P[j] - P[i] = sum of table[data[k]] * B**k over i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = table[data]
    terms *= powers(len(data))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """A 64-bit fingerprint of each data[start:end]."""
    if not len(data) or not len(starts):
        return np.zeros(len(starts), np.uint64)
    sums = prefix_sums(data, table)
    value = (sums[ends] - sums[starts]) * powers(len(data), inverse=True)[np.minimum(starts, len(data) - 1)]
    return mix(value ^ ((ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column end to end, and the offsets of its rows (nulls: empty)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if column.type not in (pa.large_binary(), pa.large_string()) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, ends, and for each row its first word's index (one more at the end)."""
    inside = ~_SPACE[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)
