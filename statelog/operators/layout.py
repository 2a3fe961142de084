"""How an op log lies in generations of in-memory tables and sorted runs.

A table is full at a number of distinct keys or of bytes; the next operation
opens another. Where tables open is a chain from the log's first operation, and
is worked out over ranges of the log side by side: a task finds, for every place
of its range that a table may open at first, where the chain from there leaves
the range and how many tables open before; one task then follows the chain from
range to range, one step for each; and every range is folded from where its
first table opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelog.sources.shared import numbered, written

from .state import record_size, winners

#: Operations of a range; a table may take up to as many.
RANGE = 1 << 18


class _Table:
    """The open table: its keys' sizes, and whether it is full."""

    def __init__(self, max_entries: int, max_bytes: int):
        self.max_entries, self.max_bytes = max_entries, max_bytes
        self.sizes: dict = {}
        self.used = 0

    def put(self, key, size: int) -> bool:
        self.used += size - self.sizes.get(key, 0)
        self.sizes[key] = size
        return len(self.sizes) >= self.max_entries or self.used >= self.max_bytes

    def clear(self) -> None:
        self.sizes.clear()
        self.used = 0


def _fold(max_entries: int, max_bytes: int):
    """Adds the generation to rows that come by (shard, seq) and say at which place and generation the first table opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, gen, place, opens = _Table(max_entries, max_bytes), None, 0, 0, 0
        started = False
        for batch in batches:
            out = []
            for s, key, size, first, base in zip(*(batch.column(c).to_pylist() for c in ("_shard", "key", "_size", "_opens", "_base")), strict=True):
                if not started or s != last:
                    started, last, place, opens, gen = True, s, 0, first, base
                    table.clear()
                if place < opens:  # the table of an earlier range takes it
                    out.append(gen - 1)
                else:
                    out.append(gen)
                    if table.put(key, size):
                        gen += 1
                        table.clear()
                place += 1
            keep = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.int64())], [*batch.schema.names, "_gen"])

    return run


def openings(keys: list, sizes: list[int], own: int, max_entries: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place where a range's first table may open: where it and its followers leave the range, and how many they are.

    ``keys`` and ``sizes`` are those of the range's ``own`` operations and of the
    next range's. The third array says where a place's own table is followed by
    the next, or -1 where the operations at hand don't fill it. A window slides
    over them: what it loses at its start only counts if its key isn't in it
    again, so that each operation is looked at twice.
    """
    n = len(keys)
    again = np.full(n, n, np.int64)
    seen: dict = {}
    for i in range(n - 1, -1, -1):
        again[i] = seen.get(keys[i], n)
        seen[keys[i]] = i
    after = np.full(own, -1, np.int64)
    entries = used = end = 0  # of the window [start, end)
    held: dict = {}
    for start in range(own):
        while end < n and (end == start or (entries < max_entries and used < max_bytes)):
            had = held.get(keys[end], -1)
            if had >= start:
                used -= sizes[had]
            else:
                entries += 1
            used += sizes[end]
            held[keys[end]] = end
            end += 1
        if entries >= max_entries or used >= max_bytes:
            after[start] = end
        if again[start] >= end:
            entries -= 1
            used -= sizes[start]
    most = int(after[0]) + 1 if own and 0 <= after[0] < own else own
    leave, count = np.full(own + 1, -1, np.int64), np.zeros(own + 1, np.int64)
    for i in range(own - 1, -1, -1):
        if after[i] >= own:
            leave[i], count[i] = after[i], 1
        elif after[i] >= 0:
            leave[i], count[i] = leave[after[i]], count[after[i]] + 1
        else:
            count[i] = 1
    return leave[:most], count[:most], after


def _ways(max_entries: int, max_bytes: int):
    """One row for each range of rows that come by (range, place): its number, size, and where its chains leave it."""

    def made(number, keys, sizes, own) -> pa.RecordBatch:
        leave, count, _ = openings(keys, sizes, own, max_entries, max_bytes)
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (leave, count)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([own], pa.int64()), *lists], ["range", "own", "leave", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, sizes, own = None, [], [], 0
        for batch in batches:
            for r, key, size, mine in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "_size", "mine")), strict=True):
                if r != number:
                    if own:
                        yield made(number, keys, sizes, own)
                    number, keys, sizes, own = r, [], [], 0
                keys.append(key)
                sizes.append(size)
                own += mine
        if own:
            yield made(number, keys, sizes, own)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order: at which place of each its first table opens, and that table's number."""
    opens, base, unfilled = 0, 0, 0
    for batch in batches:
        out = []
        for number, own, leave, count in zip(*(batch.column(c).to_pylist() for c in ("range", "own", "leave", "count")), strict=True):
            if opens < 0:
                # A table that its range and the next don't fill takes the next; what is beyond that isn't known.
                out.append((number, None if unfilled else own, base))
                unfilled += 1
                continue
            out.append((number, min(opens, own), base))
            if opens >= own:
                opens -= own
            else:
                base += count[opens]
                opens = leave[opens] - own if leave[opens] >= 0 else -1
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["range", "_opens", "_base"])


def generations(ops: DataFrame, max_entries: int, max_bytes: int, shard: str | None = None, span: int = RANGE) -> DataFrame:
    """``ops`` with ``gen``, the number of the table that took each operation.

    A log of one store is cut into ranges of ``span`` operations, which are
    worked on side by side, as long as no table takes more than ``span``; else,
    and for each store of a log that names them in ``shard``, the fold is serial
    within a store. The result is written, so that it is worked out once. Rows
    with equal ``seq`` come in the order of their keys.
    """
    columns = ops.columns
    rows = ops.withColumn("_size", record_size(ops))
    if shard is None:
        many = rows.count() > span
        found = _ranged(rows, max_entries, max_bytes, span) if many else None
        rows = rows.withColumn("_shard", F.lit(0).cast("long")) if found is None else found
        if found is None:
            rows = rows.withColumn("_opens", F.lit(0).cast("long")).withColumn("_base", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("_shard", F.col(shard)).withColumn("_opens", F.lit(0).cast("long")).withColumn("_base", F.lit(0).cast("long"))
    dealt = rows.repartition("_shard").sortWithinPartitions("_shard", "seq", "key")
    names = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes)
    laid = dealt.mapInArrow(_fold(max_entries, max_bytes), f"{names}, _gen long")
    return written(laid.select(*columns, F.col("_size").alias("size"), F.col("_gen").alias("gen")), "laid")


def _ranged(rows: DataFrame, max_entries: int, max_bytes: int, span: int) -> DataFrame | None:
    """The log with its ranges as shards and where their first tables open; None if a table takes more than a range."""
    log = numbered(rows, "log", "seq", "key")
    place = F.col("place")
    number = F.floor(place / span)
    both = log.select("key", "_size", "place", F.explode(F.array(number, number - 1)).alias("range")).filter("range >= 0")
    both = both.withColumn("mine", (F.col("range") == number).cast("int"))
    # A last range without operations of its own makes no row.
    dealt = both.repartition("range").sortWithinPartitions("range", "place").select("range", "key", "_size", "mine")
    ways = written(dealt.mapInArrow(_ways(max_entries, max_bytes), "range long, own long, leave array<long>, count array<long>"), "ways")
    chain = ways.coalesce(1).sortWithinPartitions("range").mapInArrow(_chain, "range long, _opens long, _base long")
    chain = written(chain, "chain")
    if chain.filter("_opens IS NULL").limit(1).count():
        return None
    log = log.withColumn("range", number).join(chain, "range")
    return log.withColumnRenamed("range", "_shard").drop("place")


def full_tables(laid: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """One row: how many generations became full. Only the newest can be open."""
    newest = laid.agg(F.max("gen").alias("newest"))
    stats = generation_stats(laid.join(F.broadcast(newest), laid.gen == newest.newest, "left_semi"))  # one row
    full = F.coalesce(F.max(F.col("gen") + F.when((F.col("n_keys") >= max_entries) | (F.col("bytes") >= max_bytes), 1).otherwise(0)), F.lit(0))
    return stats.agg(full.cast("long").alias("fulls"))


def generation_stats(laid: DataFrame) -> DataFrame:
    """(gen, n_ops, n_keys, bytes): operations, distinct keys and bytes of their newest records."""
    per_key = laid.groupBy("gen", "key").agg(F.count("*").alias("n"), F.max_by("size", "seq").alias("size"))
    return per_key.groupBy("gen").agg(F.sum("n").cast("long").alias("n_ops"), F.count("*").alias("n_keys"), F.sum("size").cast("long").alias("bytes"))


def with_tiers(laid: DataFrame, max_entries: int, max_bytes: int, instances: int, multi_file: bool = True) -> DataFrame:
    """``laid`` with its tier: the open table, full ones still in memory, or runs on disk.

    Without ``multi_file`` flushed tables go to no run: their operations are in
    the tier LOST, which no read finds.
    """
    if instances < 1:
        raise ValueError("at least one table instance is needed")
    fulls = F.broadcast(full_tables(laid, max_entries, max_bytes))  # one row
    tier = F.when(F.col("gen") <= F.col("fulls") - instances, "SST" if multi_file else "LOST").when(F.col("gen") < F.col("fulls"), "RO").otherwise("ACTIVE")
    return laid.join(fulls).withColumn("tier", tier).drop("fulls")


def runs(tiered: DataFrame) -> DataFrame:
    """Records of the runs on disk: the newest of each key in each, tombstones kept, sorted by key."""
    disk = tiered.filter("tier = 'SST'")
    return winners(disk, by=("gen", "key")).repartition("gen").sortWithinPartitions("gen", "key")


def layered_get(tiered: DataFrame) -> DataFrame:
    """(key, found, gen, tier): which layer answers for each key."""
    won = winners(tiered.filter("tier <> 'LOST'"), carry=("tombstone", "gen", "tier"), first=("gen",))
    return won.select("key", (~F.col("tombstone")).alias("found"), "gen", "tier")


def recovered(tiered: DataFrame) -> DataFrame:
    """The state after a restart, which has the runs on disk only."""
    return winners(tiered.filter("tier = 'SST'")).filter("NOT tombstone").drop("tombstone")


def segments(ops: DataFrame, records: int = 1000) -> DataFrame:
    """(segment, n_ops, first_seq, last_seq) of the log in segments of ``records`` sequence numbers."""
    segment = F.floor((F.col("seq") - 1) / records).cast("long")
    return ops.groupBy(segment.alias("segment")).agg(F.count("*").alias("n_ops"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
