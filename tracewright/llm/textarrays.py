"""Whole texts as byte arrays: Arrow string columns to numpy, word spans and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one pass over numpy arrays takes at a time; a longer text is a pass of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of about `size` bytes of text."""
    if not len(column):
        return
    data, off = utf8(column)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, BASE_INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n + 1).bit_length())
    up, down = _powers(size)
    return up[: n + 1], down[: n + 1]


@lru_cache(2)
def byte_codes(fold_case: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    if fold_case:
        t[65:91] = t[97:123]
    return t


def prefix_hash(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Prefix sums s so that span_hash(s, i, j) identifies bytes i..j-1 whatever their place."""
    s = np.zeros(len(data) + 1, U)
    np.cumsum(byte_codes(fold_case)[data] * powers(len(data))[0][:-1], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((s[end] - s[start]) * powers(len(s) - 1)[1][start] + (end - start).astype(U))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes other than 20, 09-0D; rows are never bridged."""
    on = ~SPACE[data]
    before, after = np.zeros(len(on), bool), np.zeros(len(on), bool)
    before[1:], after[:-1] = on[:-1], on[1:]
    at = off[:-1][off[:-1] < off[1:]]
    before[at] = False
    after[at[1:] - 1] = False
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1
