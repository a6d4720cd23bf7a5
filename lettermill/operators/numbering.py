"""Row numbers over whole tables and hot keys."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

RUN_BITS = 33  # Spark's row ids hold the partition above these bits


def numbered(df: DataFrame, order: list[str], by: list[str] | tuple[str, ...] = (), column: str = "n") -> DataFrame:
    """Adds row numbers from 1 within each key, in ascending order, however many rows a key has.

    Rows are cut into ranges of (key, order), and each is numbered in place: the
    rows of a key in a range follow each other, and what the ranges before hold of
    it is added. Only counts per range and key meet, never a key's rows. Nulls are
    a key, and come first in order; equal rows are numbered in any order.
    """
    keys = list(by)
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    table = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__run", F.shiftright("__at", RUN_BITS))
    runs = table.groupBy("__run", *keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__size")
    if not keys:  # one row per range
        out = table.join(F.broadcast(runs), "__run")
    else:
        runs = runs.withColumnsRenamed({"__run": "__in"} | {k: f"__key{i}" for i, k in enumerate(keys)})
        same = F.col("__run") == F.col("__in")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
        out = table.join(runs, same)
    return out.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(column))
