"""A training corpus from documents: filter, deduplicate, pack.

Every stage works on all that the one before kept and reads it from a written
table, so a lost executor costs a stage's tasks at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import chosenpath, packing, quality, repeats, toxicity
from lettermill.llm.common import documents, materialise, rows_of

TOXIC_FROM = 0.5
GOOD_FROM = 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM, with all their columns.

    Null and empty texts have the score of a text without terms; very long texts
    are scored whole; repeated rows stay or go together; a null id is scored as
    any other; an empty table gives no rows; without labels all scores are 0.5,
    so nothing stays.
    """
    got = toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)), whole=True)
    return rows_of(got.filter(F.col("score") < TOXIC_FROM), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is GOOD_FROM or more, with all their columns.

    Null, empty and very long texts, repeated rows, null ids and empty tables are
    treated as in drop_toxic; without labels all scores are 0.5 and all stay.
    """
    got = quality.score(docs, quality.train(docs, _labels(spark, sf_dir)), whole=True)
    return rows_of(got.filter(F.col("score") >= GOOD_FROM), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with all its columns: that of the least id.

    Null and empty texts are one group, so one of them stays; very long texts are
    compared whole; of repeated rows, and of equal ids in a group, one stays; null
    ids come after all others; an empty table gives no rows.
    """
    return chosenpath.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that also start elsewhere; n_chars follows the text.

    One row per document; null texts stay null, short ones as they are, very long
    ones are cut whole; repeated rows and equal texts all lose what they share, so
    a text may end up empty; an empty table gives no rows.
    """
    return repeats.without_repeats(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of up to 1024 tokens.

    Null and empty texts are their end id alone; long texts are cut; repeated rows
    are packed as often as they occur; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near copies", drop_near_copies),
    ("repeated strings", cut_repeats),
    ("packing", pack),
]

#: SQL cannot express the learned filters, the join or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
