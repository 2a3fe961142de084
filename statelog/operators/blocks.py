"""Fixed-size blocks of byte contents, and the trace of a byte-bounded block cache."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(content: Column, number: Column, size: int) -> Column:
    """Block ``number`` of a content; what lies beyond its end is zero bytes."""
    part = F.substr(content, (number * size + 1).cast("int"), F.lit(size))
    return F.rpad(part, F.lit(size), F.unhex(F.lit("00")))


def split(files: DataFrame, size: int, path: str = "path", content: str = "content") -> DataFrame:
    """(path, block_num, data): every content in blocks of ``size`` bytes, the last one padded."""
    count = F.ceil(F.octet_length(content) / size).cast("long")
    rows = files.filter(count > 0).select(F.col(path).alias("path"), content, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block_num"))
    return rows.select("path", "block_num", block_of(F.col(content), F.col("block_num"), size).alias("data"))


def join(blocks: DataFrame) -> DataFrame:
    """(path, content): blocks put together again, in order."""
    parts = F.array_sort(F.collect_list(F.struct("block_num", "data")))
    return blocks.groupBy("path").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["data"])).alias("content"))


def read_at(content: Column, offset: int, size: int) -> Column:
    """Exactly ``size`` bytes from ``offset``; an error where the content ends before."""
    cut = F.raise_error(F.concat(F.lit("file truncated: "), F.octet_length(content).cast("string")))
    return F.when(F.octet_length(content) >= offset + size, F.substr(content, F.lit(offset + 1), F.lit(size))).otherwise(cut.cast("binary"))


def append(blocks: DataFrame, added: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """``added`` (path, data, and an order) with the numbers that follow those of ``blocks``."""
    bad = F.raise_error(F.lit("invalid block size")).cast("binary")
    have = blocks.groupBy("path").agg(F.max("block_num").alias("last"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(order))
    rows = added.join(have, "path", "left").withColumn("block_num", (F.coalesce(F.col("last") + 1, F.lit(0)) + place - 1).cast("long"))
    return rows.select("path", "block_num", F.when(F.octet_length("data") == size, F.col("data")).otherwise(bad).alias("data"))


def write(blocks: DataFrame, writes: DataFrame, size: int) -> DataFrame:
    """Blocks after ``writes`` (path, block_num, data, seq): the newest counts, and gaps are zero blocks."""
    rows = blocks.select("path", "block_num", "data", F.lit(-1).cast("long").alias("seq")).unionByName(writes.select("path", "block_num", "data", "seq"))
    won = rows.groupBy("path", "block_num").agg(F.max_by("data", "seq").alias("data"))
    ends = won.groupBy("path").agg(F.max("block_num").alias("last"))
    all_ = ends.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block_num"))
    return all_.join(won, ["path", "block_num"], "left").select("path", "block_num", F.coalesce("data", F.unhex(F.lit("00" * size))).alias("data"))


def _trace(capacity: int):
    """Adds hits to accesses that come by cache and seq, with the blocks that are held as the only state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        used, started, last = 0, False, None
        for batch in batches:
            hits = []
            for cache, path, number, size in zip(*(batch.column(c).to_pylist() for c in ("cache", "path", "block_num", "size")), strict=True):
                if not started or cache != last:
                    held.clear()
                    used, started, last = 0, True, cache
                key = (path, number)
                hits.append(key in held)
                used += size - held.pop(key, 0)
                held[key] = size
                while used > capacity and held:
                    used -= held.popitem(last=False)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*batch.schema.names, "hit"])

    return run


def cache_trace(accesses: DataFrame, capacity: int, cache: str | None = None) -> DataFrame:
    """``accesses`` (path, block_num, size, seq) with whether a least-recently-used cache holds the block.

    Serial within a cache, in memory for the blocks held; a log of several names
    them in the column ``cache``. A block larger than the cache drives out
    everything, itself included.
    """
    rows = accesses.select("path", "block_num", "size", "seq", (F.lit(0) if cache is None else F.col(cache)).alias("cache"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.repartition("cache").sortWithinPartitions("cache", "seq").mapInArrow(_trace(capacity), f"{kinds}, hit boolean")


def cached(blocks: DataFrame, capacity: int) -> DataFrame:
    """Blocks kept for repeated reads, in memory as far as it goes and on disk beyond; ``capacity`` in bytes decides on memory at all.

    A relation larger than ``capacity`` isn't kept and is read again. Losing an
    executor loses no blocks, which are then read again too.
    """
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    return blocks.persist(StorageLevel.MEMORY_AND_DISK) if size <= capacity else blocks
