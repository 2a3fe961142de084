"""A store in a folder: its settings, its operation log and its run files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog import config
from statelog.operators import layout, state
from statelog.operators.blocks import cached
from statelog.sources import runs

LOG = "key string, value string, tombstone boolean, seq long, expires_at long"


class Store:
    """Opens a folder of any file system that Spark reads; what isn't there yet is empty.

    ``config.json`` holds the settings, ``log`` the operations as Parquet, one
    part added by each call, and ``sstable/level0`` the runs. The kind of
    in-memory table is a setting without effect: tables are relations here.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        if settings is None:
            text = [(r.value,) for r in self._read("text", "config.json", "value string", wholetext=True).collect()] or [("{}",)]
        else:
            import json

            text = [(json.dumps(settings),)]
        self.settings = config.load(spark.createDataFrame(text[:1], "json string")).first().asDict()

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, kind: str, name: str, schema: str, **options) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(kind).schema(schema).options(**options).load(f"{self.folder}/{name}")

    @property
    def log(self) -> DataFrame:
        """All operations."""
        return self._read("parquet", "log", LOG)

    def append(self, more: DataFrame, order: str) -> None:
        """Adds operations (key, value, tombstone, expires_at) in an order, numbered on from the last one."""
        state.following(self.log, more, order).write.mode("append").parquet(f"{self.folder}/log")

    def put(self, rows: DataFrame, order: str, now_us: Column | None = None, ttl_ns: Column | None = None) -> None:
        """Puts (key, value); with a time to live, they expire in whole seconds after ``now_us``."""
        now = F.unix_micros(F.current_timestamp()) if now_us is None else now_us
        expires = F.lit(0).cast("long") if ttl_ns is None else state.expiry(now, ttl_ns)
        self.append(rows.select("key", "value", F.lit(False).alias("tombstone"), expires.alias("expires_at"), order), order)

    def delete(self, rows: DataFrame, order: str) -> None:
        """Deletes by ``key``, whether there or not."""
        self.append(rows.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), F.lit(0).cast("long").alias("expires_at"), order), order)

    def get(self, key: str) -> DataFrame:
        return state.get(self.log, key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return state.multi_get(self.log, keys)

    def tiered(self) -> DataFrame:
        """The log in generations and tiers, by the store's settings."""
        s = self.settings
        most = (s["memtable_max_entries"], s["memtable_max_bytes"])
        return layout.with_tiers(layout.generations(self.log, *most), *most, s["memtable_instances"], s["multi_file_sstable"])

    def flush(self) -> None:
        """Writes every run that isn't there yet."""
        rows = layout.runs(self.tiered())
        have = self.runs().select("run").distinct()
        rows = rows.join(F.broadcast(have), F.format_string("run_%019d.data", "gen") == F.col("run"), "left_anti")  # one name for each run
        rows = rows.repartition("gen").sortWithinPartitions("gen", "key")
        data = rows.select("gen", F.col("key").cast("binary").alias("key"), state.encode_record(F.col("key"), F.col("value"), F.col("tombstone"), F.col("seq")).alias("data"))
        self.spark.dataSource.register(runs.RunFiles)
        data.write.format("statelog_runs").mode("append").save(f"{self.folder}/sstable/level0")

    def runs(self) -> DataFrame:
        """Records of all run files."""
        if not self._exists("sstable/level0"):
            return self.spark.createDataFrame([], f"run string, {runs.RECORD}")
        return runs.read_runs(self.spark, f"{self.folder}/sstable/level0")

    def recovered(self) -> DataFrame:
        """The state that the run files alone give."""
        return runs.newest_run_get(self.runs())

    def cached(self, blocks: DataFrame) -> DataFrame:
        """Blocks kept for repeated reads if they fit the store's cache."""
        return cached(blocks, self.settings["cache_size"])
