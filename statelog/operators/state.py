"""Last-writer-wins state of an op log (key, value, tombstone, seq [, epoch])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statelog.functions.codec import encode_record
from statelog.sources.shared import numbered

#: Bytes that a record counts for beside its key and value.
RECORD_OVERHEAD = 41


def puts(rows: DataFrame, key: Column, value: Column, seq: Column, expires_at: Column | None = None) -> DataFrame:
    """Put operations; ``expires_at`` in epoch seconds, 0 for none, is carried and not enforced."""
    when = F.lit(0).cast("long") if expires_at is None else expires_at
    return rows.select(key.alias("key"), value.alias("value"), F.lit(False).alias("tombstone"), seq.alias("seq"), when.alias("expires_at"))


def expiry(now: Column, ttl_ns: Column) -> Column:
    """``expires_at`` in whole epoch seconds of a record put at ``now`` (epoch microseconds) to live for so many nanoseconds.

    Seconds are cut after the addition; a null time to live is none, which is 0.
    """
    return F.coalesce(F.floor((now + F.floor(ttl_ns / 1000)) / 1_000_000), F.lit(0)).cast("long")


def following(ops: DataFrame, more: DataFrame, order: str) -> DataFrame:
    """Operations ``more`` (key, value, tombstone, expires_at), numbered on from those of ``ops`` in an order."""
    last = ops.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    rows = numbered(more, "append", order).crossJoin(F.broadcast(last))  # one row
    return rows.select("key", "value", "tombstone", (F.col("last") + F.col("place") + 1).alias("seq"), "expires_at")


def appended(ops: DataFrame, more: DataFrame, order: str) -> DataFrame:
    """``ops`` and those that follow them."""
    return ops.unionByName(following(ops, more, order), allowMissingColumns=True)


def deletes(rows: DataFrame, key: Column, seq: Column) -> DataFrame:
    """Delete operations: blind tombstones without value."""
    return rows.select(key.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("tombstone"), seq.alias("seq"), F.lit(0).cast("long").alias("expires_at"))


def _order(ops: DataFrame, *first: str) -> Column:
    return F.struct(*[c for c in (*first, "epoch", "seq") if c in ops.columns])


def winners(ops: DataFrame, by: tuple[str, ...] = ("key",), carry: tuple[str, ...] = ("value", "tombstone", "seq"), first: tuple[str, ...] = ()) -> DataFrame:
    """The newest operation of each key, tombstones included; partial on the map side.

    The winner is taken as one struct, so that a null value wins too.
    """
    won = ops.groupBy(*by).agg(F.max_by(F.struct(*carry), _order(ops, *first)).alias("w"))
    return won.select(*by, *[F.col(f"w.{c}").alias(c) for c in carry])


def latest(ops: DataFrame, carry: tuple[str, ...] = ("value", "seq")) -> DataFrame:
    """Live keys with their newest value: what a read of every key would find."""
    return winners(ops, carry=(*carry, "tombstone")).filter("NOT tombstone").drop("tombstone")


def get(ops: DataFrame, key: str) -> DataFrame:
    """A single key; the filter moves below the aggregation to the scan."""
    return latest(ops).filter(F.col("key") == key)


def multi_get(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found, value) for every requested key, missing and deleted ones included."""
    state = latest(ops).withColumn("found", F.lit(True))
    return keys.select("key").join(state, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def get_as_of(ops: DataFrame, gets: DataFrame) -> DataFrame:
    """(seq, key, found, value) for gets (key, seq): the newest operation before each.

    One window over operations and gets together, so no range join.
    """
    rows = ops.select("key", "seq", F.struct("value", "tombstone").alias("op")).unionByName(gets.select("key", "seq", F.lit(None).cast("struct<value:string,tombstone:boolean>").alias("op")))
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("last", F.last("op", ignorenulls=True).over(before)).filter("op IS NULL")
    found = F.col("last").isNotNull() & ~F.coalesce(F.col("last.tombstone"), F.lit(False))
    return seen.select("seq", "key", found.alias("found"), F.when(found, F.col("last.value")).alias("value"))


def tombstones(ops: DataFrame) -> DataFrame:
    """Keys whose newest operation is a delete."""
    return winners(ops).filter("tombstone").select("key", "seq")


def ordered_scan(ops: DataFrame) -> DataFrame:
    """Live records with their place in byte order of keys, from 1.

    Tasks order ranges of keys, and a range's places follow from how many keys
    those before it have.
    """
    rows = numbered(latest(ops), "scan", "key")
    return rows.select((F.col("place") + 1).alias("pos"), "key", "value")


def record_size(ops: DataFrame) -> Column:
    """Bytes that an operation counts for; a delete has no value."""
    value = F.when(F.col("tombstone"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0)))
    return (F.octet_length("key") + value + RECORD_OVERHEAD).cast("long")


def expired(ops: DataFrame, now: int) -> DataFrame:
    """Opt-in view: live keys whose time to live has run out by ``now`` (epoch seconds)."""
    return latest(ops, carry=("value", "seq", "expires_at")).filter((F.col("expires_at") != 0) & (F.col("expires_at") <= now))


def encoded(ops: DataFrame) -> DataFrame:
    """(key, seq, data): each operation's bytes in the run format."""
    return ops.select("key", "seq", encode_record(F.col("key"), F.col("value"), F.col("tombstone"), F.col("seq")).alias("data"))
