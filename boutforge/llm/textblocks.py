"""Arrow text columns as flat numpy arrays: words, their hashes and ragged ranges.

The operators that run in Python workers read a string column's UTF-8 buffer in place.
No Python string is made for a word, so a pass costs a few nanoseconds per byte.
A column is cut into blocks of whole documents of about ``BLOCK_BYTES``; a longer document
forms a block of its own, so memory is bounded by that or by one row.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C17)  # odd, so that its powers can be inverted modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


_release = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give back what a batch has needed: tables that a very long document has made larger, and free memory of the allocators.

    A worker outlives its tasks, and what it keeps is missing to the stages after.
    """
    if "up" in _powers and len(_powers["up"]) > 2 * BLOCK_BYTES:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if _release is not None:
        _release(0)


def giving_back(task):
    """A worker's task that leaves nothing behind: what it has built is dropped, and free memory given back, when it ends.

    Idle workers wait for later stages beside the JVM, so what they hold counts against whatever runs then.
    """

    @functools.wraps(task)
    def run(*batches):
        yield from task(*batches)
        gc.collect()
        trim()

    return run


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of whole documents; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes anywhere."""
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, or of other bytes than ``between``, and the first word of each document."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~between[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = ~inside
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and the first word of each document."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    return spans_hash(low, starts, ends), first


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each (start, count), one after another."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts.astype(np.int64) - (ends - counts), counts)
