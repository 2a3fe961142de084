"""Seeded hashing of byte strings to cells, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed bytes of either sketch: a big-endian 32-bit number, for counters followed by 28 zero bytes.
FILTER_SEED_BYTES = 4
COUNTER_SEED_BYTES = 32


def seed_bytes(base: int, row: Column, width: int) -> Column:
    """The seed of hash function ``row``: base + row modulo 2 ** 32, padded with zero bytes to ``width``."""
    number = (F.lit(base).cast("long") + row.cast("long")).bitwiseAND(F.lit(4294967295))
    return F.unhex(F.rpad(F.lpad(F.hex(number), 8, "0"), 2 * width, "0"))


def cell(data: Column, base: int, row: Column, width: int, m: int) -> Column:
    """First eight bytes, big-endian, of MD5(data, seed), modulo m."""
    digest = F.md5(F.concat(data.cast("binary"), seed_bytes(base, row, width)))
    part = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("long")
    if m < 1 << 31:  # two halves stay within 64 bits
        return (((part(1) % m) * ((1 << 32) % m) + part(9)) % m).cast("long")
    whole = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (whole % F.lit(m).cast("decimal(20,0)")).cast("long")
