"""The record codec: lengths and sequence numbers as base-128 varints, then key and value bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(v: Column) -> Column:
    return F.unhex(F.lpad(F.hex(v), 2, "0"))


def uvarint(v: Column) -> Column:
    """Seven bits a byte, low ones first, the high bit set on all but the last."""
    v = v.cast("long")
    n = F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7).cast("int"))
    one = lambda i: byte(F.call_function("shiftrightunsigned", v, (i * 7).cast("int")).bitwiseAND(127).bitwiseOR(F.when(i < n - 1, 128).otherwise(0)))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.unhex(F.lit("")), lambda acc, i: F.concat(acc, one(i)))


def encode_record(key: Column, value: Column, tombstone: Column, seq: Column) -> Column:
    """One record's bytes; a tombstone carries no value."""
    key = key.cast("binary")
    value = F.when(tombstone | value.isNull(), F.unhex(F.lit(""))).otherwise(value.cast("binary"))
    return F.concat(uvarint(F.octet_length(key)), uvarint(F.octet_length(value)), byte(tombstone.cast("int")), uvarint(seq), key, value)


def read_uvarint(data: bytes, at: int) -> tuple[int, int] | None:
    """(number, next position), or None where the bytes end or the number passes 64 bits."""
    out = shift = 0
    while at < len(data) and shift < 64:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return (out, at) if out < 1 << 64 else None
        shift += 7
    return None


def decode_records(data: bytes, strict: bool = False) -> list[tuple[bytes, bytes | None, bool, int]]:
    """(key, value, tombstone, seq) of each record up to the first that is damaged.

    With ``strict`` a damaged or cut record is an error. Only byte 1 means a tombstone.
    """
    out, at = [], 0
    while at < len(data):
        sizes = read_uvarint(data, at)
        more = read_uvarint(data, sizes[1]) if sizes else None
        seq = read_uvarint(data, more[1] + 1) if more and more[1] < len(data) else None
        if not seq or seq[1] + sizes[0] + more[0] > len(data):
            if strict:
                raise ValueError(f"damaged record at byte {at}")
            break
        dead = data[more[1]] == 1
        a = seq[1]
        b = a + sizes[0]
        at = b + more[0]
        out.append((data[a:b], None if dead else data[b:at], dead, seq[0]))
    return out
