"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

They turn a block of texts into word boundaries and 64-bit hashes with array operations only, so
that a task's cost per byte stays small and its memory is bounded by the block, not the batch.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BYTES = 1_000_000  # text processed by one round of array operations

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


@cache
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1), modulo 2 ** 64."""
    return _powers(base, 1 << max(10, int(size - 1).bit_length()))[:size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`range_hashes` gets the hash of any byte range."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * powers(_MULTIPLIER, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(pow(_MULTIPLIER, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def row_base() -> int:
    """Rows of a task are numbered from here, so that rows with equal ids stay apart."""
    return TaskContext.get().partitionId() << 40


def byte_table(separators: str, lower: bool = True) -> np.ndarray:
    """A byte-to-byte table: 0 for bytes whose (lower-cased) value is in the character class
    ``separators``, else that value."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    outside = re.compile(separators.encode(), re.DOTALL)
    table[[b for b in range(256) if outside.match(bytes([table[b]]))]] = 0
    return table


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Hand freed memory back to the system: Python workers live on from stage to stage, beside the
    executor's heap."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def blocks(
    batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes of text: (rows, bytes, offsets); one row at least."""
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(text)))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        last = min(max(last, row + 1), rows)
        yield (
            slice(row, last),
            data[offsets[row] : offsets[last]],
            offsets[row : last + 1] - offsets[row],
        )
        row = last
    release()


def run_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses a text boundary."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    begins[cuts] |= inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    stops[cuts] |= inside[cuts]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and n + 1 offsets into them per text."""
    low = table[data]
    starts, ends = run_bounds(low != 0, offsets)
    hashes = range_hashes(prefix_hashes(low), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, per_text: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's k-word shingles; fewer words make one shingle."""
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        rolled = mix(rolled * np.uint64(_MULTIPLIER) + hashes[i : i + len(rolled)])
    found = []
    for first, last in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True):
        if last - first >= k:
            found.append(np.unique(rolled[first : last - k + 1]))
        elif last > first:
            short = np.array([last - first], dtype=np.uint64)
            for h in hashes[first:last]:
                short = mix(short * np.uint64(_MULTIPLIER) + h)
            found.append(short)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def records(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)],
        schema=schema,
    )


def keep_rows(docs: DataFrame, decide: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, for which a function of a batch says true.

    ``decide`` makes that function once per task.
    """

    def keep(batches):
        chosen = decide()
        for batch in batches:
            yield batch.filter(pa.array(chosen(batch), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
