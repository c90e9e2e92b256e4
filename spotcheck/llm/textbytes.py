"""Vectorised reading of UTF-8 text columns inside Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of array code takes; a longer text makes a pass of its own.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


#: What tasks of one kind keep in a worker for the next ones.
kept_between_tasks: list[dict] = []


def tidy(task: Callable, keep: bool = False) -> Callable:
    """A task over batches that gives its memory back when it ends.

    Workers live on between stages, and what a stage leaves counts against the next one.
    Without ``keep`` it begins by dropping what tasks of other kinds keep.
    """

    @functools.wraps(task)
    def run(batches):
        try:
            if not keep:
                for table in kept_between_tasks:
                    table.clear()
            yield from task(batches)
        finally:
            release()

    return run


def release() -> None:
    """Return freed memory to the system, where its C library can."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null("" if kind == pa.large_string() else b"")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their bytes and offsets, about ``limit`` bytes at a time."""
    data, offsets = text_column(batch.column(name))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1 << max(18, int(n).bit_length()), base, np.uint64)]), dtype=np.uint64)
        _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, from which the hash of any slice follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power("up", _BASE, len(data))[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices, equal for equal bytes wherever they stand."""
    inverse = _power("down", _INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document number of the words ``[^\\x20\\x09-\\x0D]+``, or of others by a table of bytes; none crosses documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    prev = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~prev | first[:-1]))
    follows = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~follows | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of the given sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)
