"""Shared helpers: batch text access, vectorised word hashing, shared folders."""
from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import remove, scratch

BLOCK_BYTES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITESPACE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str = "text") -> Column:
    """The text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one, so that an operator's own columns cannot clash with any of them."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def schema_of(df: DataFrame, name: str, other: str) -> StructType:
    """The column of a name, and other ones as DDL."""
    return StructType([df.schema[name], *StructType.fromDDL(other).fields])


def rows_of(df: DataFrame, columns: list[str], row: str = "row", **other: Column) -> DataFrame:
    """The columns that whole_row packed; those named in `other` get that value instead."""
    return df.select(*[(other[c] if c in other else F.col(f"{row}.{quoted(c)}")).alias(c) for c in columns])


def held_out(doc_id: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id written as text leaves the remainder; a null id is never held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def local_path(uri: str) -> str:
    """The path of a mounted shared folder; workers write plain files below it."""
    got = urlparse(uri)
    if got.scheme not in ("", "file"):
        raise ValueError(f"a mounted (file:) spark.checkpoint.dir is needed, not {uri}")
    return got.path


_written: list[list[DataFrame]] = []  # tables of the calls of temporary() that are under way


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage by a written table in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _written:
        _written[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Takes away written tables of which all that is still needed has been written elsewhere."""
    for table in tables:
        remove(table.sparkSession, table.written_at)


def temporary(f):
    """A function whose results are written tables: all others that it writes go when it ends."""

    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        _written.append([])
        try:
            out = f(*args, **kwargs)
        finally:
            mine = _written.pop()
        kept = {t.written_at for t in (out if isinstance(out, tuple) else (out,))}
        discard(*[t for t in mine if t.written_at not in kept])
        if _written:
            _written[-1].extend(t for t in mine if t.written_at in kept)
        return out

    return wrapped


def blocks(lengths: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row is a range of its own."""
    if not len(lengths):
        return
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def byte_rows(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def row_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(i, j, rows i to j as bytes) of at most `limit` bytes each; a longer row comes alone."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in blocks(lengths, limit):
        yield i, j, byte_rows(column.slice(i, j - i))


def task(run):
    """A function of batches that returns the memory it used to the system when its task ends.

    Spark reuses Python workers, also for later stages of other operators.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _accumulated(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


@functools.lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _accumulated(_BASE, BLOCK_BYTES // 4), _accumulated(_BASE_INV, BLOCK_BYTES // 4)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base's powers and inverse powers modulo 2^64, at least n of each; 4 MB of them are kept."""
    if n <= BLOCK_BYTES // 4:
        return _kept_powers()
    return _accumulated(_BASE, n), _accumulated(_BASE_INV, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, non-overlapping spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in bounded pieces, cut between spans
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES // 4 - 1, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        p, q = powers(hi - lo + 1)
        pre = np.empty(hi - lo + 1, np.uint64)
        pre[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=pre[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (pre[e] - pre[s]) * q[s] + (e - s).astype(np.uint64) * _MUL
        i = j
    return mix(out)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """span_hashes of the spans' first bytes, for each length; shorter spans are left as they are."""
    return [span_hashes(data, starts, np.minimum(ends, starts + n)) for n in lengths]


def byte_table(separators: bytes) -> np.ndarray:
    """True for each byte value that belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


SPACE_TABLE = byte_table(WHITESPACE)
WORD_TABLE = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes."""
    w = np.zeros(len(data) + 2, np.int8)
    w[1:-1] = is_word[data]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def joined(rows: list[bytes], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The rows with a separator after each, and where each row starts (one more entry: the end)."""
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=at[1:])
    return np.frombuffer(separator.join(rows) + separator, np.uint8), at


def words(rows: list[bytes], is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, in order, and the first word's index of each row (one more entry: the end)."""
    data, at = joined(rows)
    if lower:
        data = LOWER[data]
    s, e = spans(data, is_word)
    return span_hashes(data, s, e), np.searchsorted(s, at)
