"""Arrow batches in small pieces, so that a task's memory follows neither its rows nor its table."""
from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in pieces of at most `limit` bytes of a text or binary column and 1,000 rows; a longer row comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = size = 0
    for i, n in enumerate(lengths):
        if i > first and (size + n > limit or i - first == 1000):
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield batch.slice(first)


def tidy(run):
    """A function of batches that gives the memory it used back to the system when its task ends; Spark reuses Python workers."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
