"""File catalogues and text snippets, history sink, user transforms."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import PIECE_BYTES, pieces, tidy
from ..functions.names import split_path, trim
from .shared import qualified


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One level of a folder: name, stem, ext, size, mtime; contents aren't read.

    A folder in it whose name has a suffix is a table of several files: one row,
    with their sizes added up. Other folders are left out.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    below = F.split(F.substr("path", F.lit(len(qualified(spark, folder).rstrip("/")) + 2)), "/")
    f = f.withColumns({"__name": F.element_at(below, 1), "__deep": F.size(below) > 1})
    stem, ext = split_path(F.col("__name"))
    f = f.groupBy("__name", "__deep").agg(F.sum("length").alias("size"), F.max("modificationTime").alias("mtime")).filter(~F.col("__deep") | (ext != ""))
    return f.select(F.try_url_decode("__name").alias("name"), stem.alias("stem"), ext.alias("ext"), "size", "mtime")


def snippet(content: Column, most: int = 2000) -> Column:
    """Start of a file's text: UTF-8, invalid bytes dropped, white space collapsed."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")
    return F.substring(trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)


def text_files(spark: SparkSession, folder: str, most: int = 2000) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", snippet(F.col("content"), most).alias("snippet"))


def append_history(deliveries: DataFrame, path: str) -> None:
    """Successful deliveries only, partitioned by user."""
    deliveries.filter("success").write.mode("append").partitionBy("user_id").parquet(path)


def transform_files(files: DataFrame, f: Callable[[str, bytes], bytes], ext: str) -> DataFrame:
    """f on each (name, content); a failure gives an error and no content, and stops nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            out, size = [], 0
            for name, content in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                try:
                    out.append((name, bytes(f(name, bytes(content))), None))
                    size += len(out[-1][1])
                except Exception as e:  # the user's function may raise anything
                    out.append((name, None, f"{type(e).__name__}: {e}"))
                if size > PIECE_BYTES:  # a function may give more than it took
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], names=["name", "content", "error"])

    got = files.select("name", "content").mapInArrow(tidy(run), "name string, content binary, error string")
    stem, _ = split_path(F.col("name"))
    return got.withColumn("output", F.concat(stem, F.lit(ext)))


#: Named text transforms; unknown names give the default.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "plain": lambda c: c,
    "collapse": lambda c: F.regexp_replace(c, r"(?U)\s+", " "),
    "upper": F.upper,
    "number": lambda c: F.coalesce(c.try_cast("double").cast("string"), c),
}


def named_transform(name: str, c: Column, default: str = "plain") -> Column:
    return TRANSFORMS.get(name, TRANSFORMS[default])(c)
