"""Vectorised word and shingle work on the UTF-8 buffers of Arrow columns.

Texts are never decoded: words are maximal runs of bytes other than space and
0x09-0x0D, which cannot occur inside a multi-byte UTF-8 character.  All hashes
are 64 bit and the same on every machine.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so powers of it can be inverted modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def release_memory() -> None:
    """Give freed memory back: a Python worker outlives its task, and the next task may need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values that does not cross a text's edge."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = at[1:] > at[:-1]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    first = at[:-1][filled]
    start[first] = inside[first]
    end[:-1] &= ~inside[1:]
    last = at[1:][filled] - 1
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the n + 1 offsets of each text's words."""
    start, end = runs(~IS_SPACE[data], at)
    return start, end, np.searchsorted(start, at)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span, by differences of one polynomial prefix sum."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, word_at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows, in order, and the n + 1 offsets of each text's.

    A text of fewer than k words has its whole sequence as its only window; one
    without words has none.
    """
    n_words = np.diff(word_at)
    per_text = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    out_at = np.zeros(len(word_at), np.int64)
    np.cumsum(per_text, out=out_at[1:])
    out = np.empty(out_at[-1], np.uint64)
    text = np.repeat(np.arange(len(n_words)), per_text)
    first = word_at[:-1][text] + np.arange(len(out)) - out_at[:-1][text]
    size = np.minimum(n_words[text], k)
    rolled = np.zeros(len(out), np.uint64)
    for j in range(k):
        on = size > j
        if on.all():
            rolled = mix(rolled * np.uint64(31) + hashes[first + j])
        else:
            rolled[on] = mix(rolled[on] * np.uint64(31) + hashes[first[on] + j])
    out[:] = mix(rolled + size.astype(np.uint64))
    return out, out_at


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
