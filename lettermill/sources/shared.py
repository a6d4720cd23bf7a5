"""Folders that the driver and all executors share."""
from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path below spark.checkpoint.dir.

    Where that is unset, a local master (as in tests) gets a temporary folder of
    its own machine; a cluster has no such folder that all can see, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in a shared folder: they are made once, and a lost executor costs no more than a read."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's path with its store, as Spark's readers name it."""
    fs, path = _place(spark, folder)
    return fs.makeQualified(path).toString()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none if it is not there."""
    fs, path = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _place(spark, folder)
    fs.delete(path, True)
