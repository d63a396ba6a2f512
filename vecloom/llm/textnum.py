"""Vectorised views of Arrow string columns: words as 64-bit hashes, without a Python object a word.

Everything works on the UTF-8 bytes of a batch.  The six white-space bytes
never occur inside a multi-byte character, so words can be cut bytewise.
Hashes are polynomial in the bytes modulo 2**64 over a fixed random table, then
mixed; they agree between runs, tasks and machines.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
WINDOW = 1 << 18
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n at least."""
    if not _powers or len(_powers["up"]) < n:
        m = max(WINDOW + (1 << 16), n)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash for each span of bytes; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = BYTE_LOWER if lower else BYTE
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + WINDOW, "right")), first + 1)
        stop = int(ends[last - 1])
        up, down = powers(stop - base + 1)
        total = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(values[data[base:stop]] * up[: stop - base], out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (n + 1 values)."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = cut[cut > 0]
    after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and for each text the number of words before it."""
    data, offsets = buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    return spans_hash(data, starts, ends, lower), bounds


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of a batch of at most about ``limit`` bytes of text each, so that memory stays bounded."""
    if batch.num_rows == 0:
        return
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        last = max(int(np.searchsorted(sizes, done + limit, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches of a task in such parts; after the last one, memory that is free goes back to the system, as workers are used again."""
    for batch in batches:
        yield from slices(batch, column)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which has no such call
        pass
