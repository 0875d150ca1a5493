"""Vectorised word hashing over Arrow text buffers.

Texts stay in the Arrow buffer: bytes are classified by a 256-entry table, word
borders found with numpy, and every word gets a 64-bit polynomial hash from one
prefix sum (differences of the sum are scaled back by the inverse power).  No
Python string is made per word, and the temporary memory is bounded by PIECE
bytes however long a text is (a single word longer than PIECE extends it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def space_words() -> np.ndarray:
    """Words are runs of anything but ASCII white space; A-Z counts as a-z."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


def alnum_words() -> np.ndarray:
    """Words are runs of ASCII letters, digits and any non-ASCII bytes; A-Z counts as a-z."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    t[~keep] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        inverse = pow(_P, -1, 1 << 64)
        up, down = np.full(n, _U(_P)), np.full(n, _U(inverse))
        up[0] = down[0] = _U(1)
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first): byte range and hash of each word; first[i] is the first word of text i (length n + 1)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    is_word = table[data] > 0
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1] | border[1:-1]
    ends[:-1] &= ~is_word[1:] | border[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes, done, lo = np.empty(len(start), _U), 0, 0
    while done < len(start):
        lo = start[done]
        upto = max(done + 1, int(np.searchsorted(end, lo + PIECE, "right")))
        a, b = start[done:upto] - lo, end[done:upto] - lo
        up, down = _power_tables(int(b[-1]) + 1)
        sums = np.empty(int(b[-1]) + 1, _U)
        sums[0] = 0
        np.cumsum(table[data[lo : lo + b[-1]]].astype(_U) * up[: b[-1]], out=sums[1:])
        hashes[done:upto] = (sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93)
        done = upto
    return start, end, mix(hashes), np.searchsorted(start, offsets)
