"""Last-writer-wins state of a stream of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_stream(ops: DataFrame) -> DataFrame:
    """Winners of a streaming op log; late and repeated operations with lower seq change nothing.

    A built-in aggregation keeps the state, so no Python runs per key.
    """
    won = ops.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "seq"), "seq").alias("w"))
    return won.select("key", "w.value", "w.tombstone", "w.seq")


def run_available(ops: DataFrame, out: str, checkpoint: str) -> None:
    """Folds all that is available now; each batch adds the keys that it changed to ``out``, in a folder of its own.

    A batch that is run again replaces its own folder only, so that the state
    can be read at any time and after any crash.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = latest_stream(ops).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """(key, value, tombstone, seq): of every key what the last batch that changed it says."""
    rows = spark.read.parquet(out)
    won = rows.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "seq"), F.struct("seq", "batch")).alias("w"))
    return won.select("key", "w.value", "w.tombstone", "w.seq")


def compact(spark: SparkSession, out: str, to: str) -> None:
    """The state so far as one batch of a new folder, which readers and a later run may go on from."""
    read_state(spark, out).write.parquet(f"{to}/batch=-1")
