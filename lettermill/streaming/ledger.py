"""What a stream's batches wrote: idempotent by batch id, and folded into a snapshot so that the tables stay few."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.shared import names_in, remove

MOST = 8  # tables of single batches before they are folded


class Ledger:
    """Tables below a folder: batch=n of each batch, snapshot=n of all up to n, and pointer=n, which makes a snapshot count.

    A batch that is written again replaces its table, or is passed over if a
    snapshot has it. To fold, the snapshot is written, then its pointer, and only
    then go the tables that it replaces; a crash at any point leaves a state that
    reads the same, and that the next fold clears up. Tables count once Spark has
    marked them as a success, so that mark must not be turned off.
    """

    def __init__(self, folder: str, schema: StructType, fold: Callable[[DataFrame], DataFrame] = lambda df: df, most: int = MOST) -> None:
        self.folder, self.schema, self.fold, self.most = folder.rstrip("/"), schema, fold, most

    def _numbers(self, spark: SparkSession, kind: str, whole: bool = True) -> list[int]:
        found = [n for n in names_in(spark, self.folder) if n.startswith(kind + "=")]
        return sorted(int(n.split("=")[1]) for n in found if not whole or "_SUCCESS" in names_in(spark, f"{self.folder}/{n}"))

    def _snapshot(self, spark: SparkSession) -> int | None:
        return max(self._numbers(spark, "pointer"), default=None)

    def _after(self, spark: SparkSession, snapshot: int | None) -> list[int]:
        return [n for n in self._numbers(spark, "batch") if snapshot is None or n > snapshot]

    def holds(self, spark: SparkSession, number: int) -> bool:
        """Whether a batch is part of a snapshot."""
        last = self._snapshot(spark)
        return last is not None and number <= last

    def put(self, rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if self.holds(spark, number):
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if len(self._after(spark, self._snapshot(spark))) > self.most:
            self.compact(spark, number)

    def compact(self, spark: SparkSession, number: int) -> None:
        """Folds all up to a batch into one table."""
        self.fold(self.read(spark, before=number + 1)).write.mode("overwrite").parquet(f"{self.folder}/snapshot={number}")
        self._point(spark, number)
        for kind in ("batch", "snapshot", "pointer"):
            for n in self._numbers(spark, kind, whole=False):
                if n < number or (kind == "batch" and n == number):
                    remove(spark, f"{self.folder}/{kind}={n}")

    def _point(self, spark: SparkSession, number: int) -> None:
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointer={number}")

    def tables(self, spark: SparkSession) -> int:
        return len(self._numbers(spark, "batch")) + len(self._numbers(spark, "snapshot"))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before one."""
        last = self._snapshot(spark)
        places = [] if last is None else [f"{self.folder}/snapshot={last}"]
        places += [f"{self.folder}/batch={n}" for n in self._after(spark, last) if before is None or n < before]
        return spark.read.schema(self.schema).parquet(*places) if places else spark.createDataFrame([], self.schema)
