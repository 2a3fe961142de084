"""Sorted runs: Parquet, and files in the record codec."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from statelog.functions.codec import decode_records

RECORD = "key binary, value binary, tombstone boolean, seq long"
SUFFIX = ".data"


def write_parquet_runs(records: DataFrame, path: str) -> None:
    """Runs as Parquet, one folder per generation, sorted by key so that row groups can be skipped."""
    rows = records.repartition("gen").sortWithinPartitions("gen", "key")
    rows.write.partitionBy("gen").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def _decoded(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_name, data in zip(batch.column("run").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = decode_records(data, strict)
                cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run_name] * len(rows), pa.string()), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())],
                    ["run", "key", "value", "tombstone", "seq"],
                )

    return run


def read_runs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(run, key, value, tombstone, seq) of all run files in a folder, of any file system that Spark reads.

    A damaged record ends its file, with ``strict`` it is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("run"), "content")
    return files.mapInArrow(_decoded(strict), f"run string, {RECORD}")


def newest_run_get(runs: DataFrame) -> DataFrame:
    """Live state of runs: the run of the greatest name counts for each key, tombstones hide it."""
    won = runs.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "seq"), F.struct("run", "seq")).alias("w"))
    return won.filter("NOT w.tombstone").select("key", "w.value", "w.seq")


class RunFiles(DataSource):
    """Sink of encoded records: ``df.write.format("statelog_runs")`` of (gen, key, data) rows.

    One file per generation, sorted by key: rows must come by generation and
    key, each generation in one partition, as ``layout.runs`` gives them. The
    path is a folder of any file system that Arrow reaches and all executors
    share. A run is written as it comes, beside its place, and takes its place
    when the whole job is done; a job that fails leaves no run.
    """

    @classmethod
    def name(cls) -> str:
        return "statelog_runs"

    def schema(self) -> str:
        return "gen long, key binary, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RunWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    runs: list[tuple[str, str]]


class _RunWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _folder(self):
        return pa_fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator) -> WriterCommitMessage:
        files, folder = self._folder()
        files.create_dir(folder, recursive=True)
        runs: list[tuple[str, str]] = []
        gen, last, out = None, None, None
        for row in iterator:
            if out is None or row["gen"] != gen:
                if out is not None:
                    out.close()
                gen, last = row["gen"], None
                name = f"{folder}/run_{gen:019d}{SUFFIX}"
                if any(n == name for _, n in runs):
                    raise ValueError("rows of a run must come together")
                runs.append((f"{name}.{uuid.uuid4().hex}.part", name))
                out = files.open_output_stream(runs[-1][0])
            key = row["key"].encode() if isinstance(row["key"], str) else bytes(row["key"])
            if last is not None and key < last:
                raise ValueError("rows of a run must come by key")
            last = key
            out.write(bytes(row["data"]))
        if out is not None:
            out.close()
        return _Written(runs)

    def commit(self, messages) -> None:
        files, _ = self._folder()
        for m in messages:
            for part, name in m.runs if m is not None else ():
                files.move(part, name)

    def abort(self, messages) -> None:
        files, _ = self._folder()
        for m in messages:
            for part, _ in m.runs if m is not None else ():
                files.delete_file(part)
