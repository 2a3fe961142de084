"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.sources.shared import shared_folder


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_made: list[list[str]] = []


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that stages wrote within, once they are read no more."""
    _made.append([])
    try:
        yield
    finally:
        for folder in _made.pop():
            delete(spark, folder)


class Stage:
    """Writes tables to one run's own folder and reads them back, which cuts their lineage.

    A table that was written is read again by any executor, so losing executors
    costs at most the tasks that were running. ``drop`` removes a table that a
    later one has replaced, ``clear`` all that are left once no result reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        for folders in _made[-1:]:
            folders.append(self.folder)
        self.written: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.folder}/{len(self.written):03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.written if any(t is x for x in tables)]:
            delete(self.spark, path)

    def clear(self) -> None:
        delete(self.spark, self.folder)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number of their own each, and the name of its column, which no other has."""
    name = "row"
    while name in df.columns:
        name += "_"
    return Stage(df.sparkSession, "rows").write(df.withColumn(name, F.monotonically_increasing_id())), name
