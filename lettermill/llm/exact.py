"""Exact duplicates by a tree of merges over sorted digest runs; DataFrame operations only.

Each input partition is a run of (digest, kept row, count). At every level FAN
neighbouring runs become one: a task sorts and merges its own rows first, then
runs are exchanged and merged again, so a group of copies is one row per run and
level however many rows it has. A digest is the text's SHA-256; byte length and a
second hash go along and must agree wherever rows are merged.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted, rows_of, text_bytes, whole_row

FAN_BITS = 4  # 16 runs meet in one merge
RUN_BITS = 33  # Spark's row numbers hold the partition above these bits


def _digests(docs: DataFrame, text: str, doc_id: str, **more: Column) -> DataFrame:
    """A written table of the documents' digests, in runs: one for each partition of the input."""
    data = text_bytes(text)
    own = docs.select(F.col(quoted(doc_id)).alias("doc_id"), *[c.alias(n) for n, c in more.items()], data.alias("data"), F.monotonically_increasing_id().alias("at"))
    return materialise(own.select(
        "doc_id", *more, "at", F.shiftright("at", RUN_BITS).alias("run"), F.unhex(F.sha2("data", 256)).alias("digest"),
        F.struct(F.octet_length("data").alias("n"), F.xxhash64("data").alias("h")).alias("proof"),
    ), "digests")


def _merged(runs: DataFrame, bits: int, stays) -> DataFrame:
    """Runs whose numbers agree but for the last bits, as one: per digest the row that stays and the rows counted."""
    got = runs.groupBy(F.shiftright("run", bits).alias("run"), "digest").agg(
        stays("row").alias("row"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    same = F.when(F.col("low") == F.col("high"), F.col("row")).otherwise(F.raise_error(F.lit("texts of equal digest differ")))
    return got.withColumn("row", same)


def _classes(table: DataFrame, keep: str) -> DataFrame:
    """The table's rows with the row that stays of their class (struct of doc_id and at) and the class's size."""
    ranked = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()  # a null id goes before any other
    runs = table.select("run", "digest", F.struct(ranked.alias("known"), "doc_id", "at").alias("row"), F.lit(1).cast("long").alias("n"), F.col("proof").alias("low"), F.col("proof").alias("high"))
    last = table.agg(F.max("run")).first()[0] or 0
    for _ in range(max(1, -(-last.bit_length() // FAN_BITS))):
        runs = _merged(runs, FAN_BITS, F.max if keep == "largest" else F.min)
    groups = runs.filter("n > 1").select("digest", F.struct("row.doc_id", "row.at").alias("stays"), F.col("n").alias("size"))
    # A digest is one row per run here, so that a group of any size is dealt out by its runs.
    answers = table.select("run", "digest").distinct().join(groups, "digest")
    return table.join(answers, ["run", "digest"], "left")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; texts of any length are
    taken whole. Of equal texts the row with the largest (or smallest) id stays;
    a null id stays only where all are null; of rows that repeat this id too, one
    stays. An empty table gives no rows; other columns are not read.
    """
    got = _classes(_digests(docs, text, doc_id), keep)
    alone = F.col("stays").isNull()
    return got.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("at") == F.col("stays.at"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; see classes."""
    got = _classes(_digests(docs, text, doc_id, whole=whole_row(docs)), keep)
    return rows_of(got.filter(F.col("stays").isNull() | (F.col("at") == F.col("stays.at"))), docs.columns, "whole")
