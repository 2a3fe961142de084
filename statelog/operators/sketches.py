"""Count-Min sketches and Bloom filters as tables of cells and of bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelog.functions.hashing import COUNTER_SEED_BYTES, FILTER_SEED_BYTES, cell


def counter_columns(epsilon: float | Column) -> Column | int:
    """Cells per row: e / epsilon, rounded up."""
    return math.ceil(math.e / epsilon) if isinstance(epsilon, float) else F.ceil(F.lit(math.e) / epsilon).cast("long")


def counter_rows(delta: float | Column) -> Column | int:
    """Rows: ln(e / delta), rounded up."""
    return math.ceil(math.log(math.e / delta)) if isinstance(delta, float) else F.ceil(F.ln(F.lit(math.e) / delta)).cast("long")


def filter_bits(n: int | Column, p: float | Column) -> Column | int:
    """Bits for n items at false-positive rate p."""
    if isinstance(p, float):
        return math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return F.ceil(n * F.abs(F.ln(p)) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0))).cast("long")


def filter_hashes(n: int | Column, m: int | Column) -> Column | int:
    """Hash functions for n items in m bits."""
    return math.ceil(m / n * math.log(2)) if isinstance(n, int) else F.ceil(m / n * F.ln(F.lit(2.0))).cast("long")


def _check(m: int, k: int) -> None:
    if not 0 < m < 1 << 32 or not 0 < k < 1 << 32:
        raise ValueError("invalid bloom meta")


def _spread(items: DataFrame, item: str, base: int, width: int, m: int, k: int, *keep: str) -> DataFrame:
    rows = items.select(*keep, F.col(item).alias("_data"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("row"))
    return rows.select(*keep, "row", cell(F.col("_data"), base, F.col("row"), width, m).alias("idx"))


def counter(items: DataFrame, item: str, m: int, k: int, base: int) -> DataFrame:
    """(row, idx, cnt): the cells that are not 0.

    Equal items are counted first, so that each is hashed once per row; counts
    are summed before they are shuffled.
    """
    distinct = items.groupBy(F.col(item).cast("binary").alias("_item")).agg(F.count("*").alias("_n"))
    cells = _spread(distinct, "_item", base, COUNTER_SEED_BYTES, m, k, "_n")
    return cells.groupBy("row", "idx").agg(F.sum("_n").cast("long").alias("cnt"))


def estimate(sketch: DataFrame, items: DataFrame, item: str, m: int, k: int, base: int) -> DataFrame:
    """(item, est) for distinct items: the least of an item's cells; at most m * k cells are broadcast."""
    asked = items.select(item).distinct()
    cells = _spread(asked, item, base, COUNTER_SEED_BYTES, m, k, item)
    small = F.broadcast(sketch) if m * k <= 1 << 20 else sketch
    return cells.join(small, ["row", "idx"], "left").groupBy(item).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))


def merge_counters(*sketches: tuple[DataFrame, int, int, int]) -> DataFrame:
    """The sum of sketches given as (cells, m, k, base); all must have the same shape and seeds."""
    if len({s[1:] for s in sketches}) != 1:
        raise ValueError("sketches differ in shape or seed")
    out = sketches[0][0]
    for s in sketches[1:]:
        out = out.unionByName(s[0])
    return out.groupBy("row", "idx").agg(F.sum("cnt").cast("long").alias("cnt"))


def _wide(v: Column, digits: int) -> Column:
    return F.lpad(F.hex(v), digits, "0")


def serialize_counter(sketch: DataFrame, m: int, k: int) -> DataFrame:
    """One row of bytes: m, k and all cells row by row, each a big-endian 64-bit number."""
    rows = sketch.sparkSession.range(k).select(F.col("id").cast("int").alias("row"))
    dense = rows.join(sketch, "row", "left").groupBy("row").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("idx", "cnt")), lambda x: x["idx"].isNotNull())).alias("c"))
    line = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")), lambda i: _wide(F.coalesce(F.try_element_at("c", i), F.lit(0)), 16)), "")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("h")))), lambda x: x["h"]), "")
    return dense.agg(F.unhex(F.concat(_wide(F.lit(m), 16), _wide(F.lit(k), 16), lines)).alias("data"))


def deserialize_counter(data: DataFrame, column: str = "data") -> DataFrame:
    """(row, idx, cnt) of serialised bytes; the seed is not among them and must be known."""
    digits = F.hex(column)
    number = lambda at: F.conv(F.substr(digits, at, F.lit(16)), 16, 10).cast("long")
    m = number(F.lit(1))
    rows = data.select(digits.alias("h"), m.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), m * number(F.lit(17)) - 1)).alias("i"))
    cnt = F.conv(F.substr("h", (F.col("i") * 16 + 33).cast("int"), F.lit(16)), 16, 10).cast("long")
    return rows.select(F.floor(F.col("i") / F.col("m")).cast("int").alias("row"), (F.col("i") % F.col("m")).alias("idx"), cnt.alias("cnt")).filter("cnt != 0")


def bloom(items: DataFrame, item: str, m: int, k: int, base: int) -> DataFrame:
    """(bit): the bits that are set."""
    _check(m, k)
    return _spread(items, item, base, FILTER_SEED_BYTES, m, k).select(F.col("idx").alias("bit")).distinct()


def might_contain(bits: DataFrame, items: DataFrame, item: str, m: int, k: int, base: int) -> DataFrame:
    """(item, maybe) for distinct items: whether all of an item's bits are set."""
    _check(m, k)
    asked = _spread(items.select(item).distinct(), item, base, FILTER_SEED_BYTES, m, k, item)
    small = F.broadcast(bits) if m <= 1 << 20 else bits
    hit = asked.join(small.withColumn("hit", F.lit(True)), asked.idx == bits.bit, "left")
    return hit.groupBy(item).agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("maybe"))


def merge_blooms(*filters: tuple[DataFrame, int, int, int]) -> DataFrame:
    """The union of filters given as (bits, m, k, base); all must agree in these."""
    if len({f[1:] for f in filters}) != 1:
        raise ValueError("invalid bloom meta")
    out = filters[0][0]
    for f in filters[1:]:
        out = out.unionByName(f[0])
    return out.distinct()


def replay_deltas(deltas: DataFrame, delta: str, m: int, k: int, base: int) -> DataFrame:
    """The filter of a log of added items; empty or null deltas are not valid and left out."""
    return bloom(deltas.filter(F.octet_length(delta) > 0), delta, m, k, base)


def meta_bytes(m: int, k: int, base: int) -> bytes:
    _check(m, k)
    return b"".join(x.to_bytes(4, "big") for x in (m, k, base & 0xFFFFFFFF))


def read_meta(data: bytes) -> tuple[int, int, int]:
    """(m, k, base) of exactly twelve bytes."""
    if len(data) != 12:
        raise ValueError("invalid bloom meta")
    m, k, base = (int.from_bytes(data[i : i + 4], "big") for i in (0, 4, 8))
    _check(m, k)
    return m, k, base


def serialize_bloom(bits: DataFrame, m: int, k: int, base: int) -> DataFrame:
    """One row of bytes: m, k, base as 32-bit numbers, then the bits, lowest first in each byte."""
    head = meta_bytes(m, k, base).hex().upper()
    each = bits.groupBy(F.floor(F.col("bit") / 8).cast("long").alias("y")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))).alias("v"))
    all_ = bits.sparkSession.range(-(-m // 8)).withColumnRenamed("id", "y").join(each, "y", "left").select("y", _wide(F.coalesce("v", F.lit(0)), 2).alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda x: x["h"]), "")
    return all_.agg(F.unhex(F.concat(F.lit(head), text)).alias("data"))


def deserialize_bloom(data: DataFrame, column: str = "data") -> DataFrame:
    """(m, k, base, bit) of serialised bytes; an error unless their length is exact."""
    digits = F.hex(column)
    number = lambda at: F.conv(F.substr(digits, F.lit(at), F.lit(8)), 16, 10).cast("long")
    m, k, size = number(1), number(9), F.octet_length(column)
    good = (size >= 12) & (m > 0) & (k > 0) & (size == 12 + F.ceil(m / 8))
    checked = F.when(good, m).otherwise(F.raise_error(F.lit("invalid bloom filter data")).cast("long"))
    rows = data.select(checked.alias("m"), k.alias("k"), number(17).alias("base"), digits.alias("h"))
    rows = rows.select("m", "k", "base", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / 8) - 1)).alias("y"))
    byte = F.conv(F.substr("h", (F.col("y") * 2 + 25).cast("int"), F.lit(2)), 16, 10).cast("int")
    rows = rows.select("m", "k", "base", "y", byte.alias("v")).filter("v != 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x"))
    return rows.filter(F.call_function("shiftright", F.col("v"), F.col("x")).bitwiseAND(F.lit(1)) == 1).select("m", "k", "base", (F.col("y") * 8 + F.col("x")).alias("bit"))
