"""Token-id files of shuffled byte planes (operator 9).

A file: magic, then sections (ids, document lengths, document ids), then the
chunk index and its place. A section is cut into chunks of a fixed number of
integers; a chunk's bytes are transposed, so that all first bytes come first,
then all second bytes, and each plane is compressed by zstandard. The index has
each chunk's section, count, width, and the length of each plane, so any range
of ids can be read without the rest.

Files are values of a binary column: Spark's committer then keeps those of
failed or repeated tasks out, in any store that Spark can write.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_blocks, scratch, task, text_bytes
from .wordids import TokenizerIds

VOCABULARY = "word_bpe_49k.json"
MAGIC = b"LMPLANE1"
CHUNK = 65_536  # integers of a chunk
FILE_BYTES = 4 << 20  # text bytes of a file, at least one document
TARGET_BYTES = 48 << 20  # text bytes of a range partition, read in batches
END_ID = 1
_ENTRY = struct.Struct("<BBIQ8I")  # section, width, count, offset, plane lengths
_TAIL = struct.Struct("<QI8s")


def to_planes(values: np.ndarray) -> np.ndarray:
    """The bytes of the values, one row per byte place."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def from_planes(planes: list[bytes], kind: str) -> np.ndarray:
    rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    return np.ascontiguousarray(rows.T).reshape(-1).view(kind)


def write_file(ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, chunk: int = CHUNK, level: int = 1) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    out, index, at = [MAGIC], [], len(MAGIC)
    for section, values in enumerate((ids.astype("<u4"), lengths.astype("<u4"), keys.astype("<i8"))):
        for i in range(0, len(values), chunk):
            part = np.ascontiguousarray(values[i : i + chunk])
            planes = [pack(p.tobytes()) for p in to_planes(part)]
            sizes = [len(p) for p in planes]
            index.append(_ENTRY.pack(section, len(planes), len(part), at, *sizes, *[0] * (8 - len(sizes))))
            out += planes
            at += sum(sizes)
    return b"".join([*out, *index, _TAIL.pack(at, len(index), MAGIC)])


def read_section(data: bytes, section: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values [start, stop) of a section; only chunks that hold them are decompressed."""
    at, n, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    kind = "<i8" if section == 2 else "<u4"
    out, seen, first = [], 0, None
    unpack = zstandard.ZstdDecompressor().decompress
    for k in range(n):
        s, width, count, place, *sizes = _ENTRY.unpack_from(data, at + k * _ENTRY.size)
        if s != section:
            continue
        if seen + count > start and (stop is None or seen < stop):
            first = seen if first is None else first
            planes = []
            for size in sizes[:width]:
                planes.append(unpack(data[place : place + size]))
                place += size
            out.append(from_planes(planes, kind))
        seen += count
    if not out:
        return np.zeros(0, kind)
    return np.concatenate(out)[start - first : None if stop is None else stop - first]


FILES = "part int, number int, n_docs long, n_ids long, nulls binary, data binary"


def _writer(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, number = TokenizerIds(path, lower=True), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            keys = batch.column(0)
            for i, j, rows in row_blocks(batch.column(1), FILE_BYTES):
                packed = ids.encode_all(rows)  # the tokenizer folds case; doing so for ASCII first makes fewer units
                lengths = np.array([len(p) // 4 + 1 for p in packed])
                own = keys.slice(i, j - i)
                nulls = np.packbits(own.is_null().to_numpy(zero_copy_only=False))
                values = np.frombuffer(end.join(packed) + end, "<u4")
                data = write_file(values, lengths, own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([j - i], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([nulls.tobytes()], pa.binary()), pa.array([data], pa.binary())],
                    [x.split()[0] for x in FILES.split(", ")],
                )
                number += 1

    return task(run)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, chunk: int = CHUNK) -> None:
    """Writes the ids of all texts in ascending order of the id: one shuffle by range, then files."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    if partitions is None:
        total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
        partitions = max(1, -(-total // TARGET_BYTES))
    # the row number keeps many equal ids apart; texts only settle ties of ids
    rows = rows.withColumns({"h": F.xxhash64("t"), "m": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(partitions, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "t")
    rows.mapInArrow(_writer(path, chunk), FILES).write.option("compression", "uncompressed").parquet(folder)


def starts_of(files: DataFrame) -> DataFrame:
    """Each file's part and number, and the ids of all files before it: sums by part, then within a part."""
    sizes = files.select("part", "number", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row per partition of the writer, the only rows that meet in one window
    before = parts.withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(before, "part").select("part", "number", (F.col("before") + F.col("within")).alias("first"))


def read_ids(files: DataFrame) -> DataFrame:
    """One row per document of the files: its place, count and checksum."""
    rows = files.select("part", "number", "nulls", "data").join(materialise(starts_of(files), "file-starts"), ["part", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                data = row["data"]
                lengths = read_section(data, 1).astype(np.int64)
                ids = read_section(data, 0).tobytes()
                keys = read_section(data, 2)
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(keys)).astype(bool)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls), pa.array(starts + row["first"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.mapInArrow(task(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Writes token-id files and reads them back.

    Null and empty texts hold the end id alone; a very long text is encoded whole,
    in a file of its own; rows of one id follow each
    other, ordered by a hash of their texts; null ids come first; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "token-ids")
    write_ids(docs, folder, path, id_col, text_col, partitions)
    return read_ids(spark.read.schema(FILES).parquet(folder))
