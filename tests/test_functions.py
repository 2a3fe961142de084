"""Codec, hashing, parser, durations and settings against fixed vectors and models."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelog import config
from statelog.functions import codec, commands, hashing
from statelog.operators import sketches

BASE = 1700000000


def test_varints(spark):
    want = {0: "00", 127: "7F", 128: "8001", 300: "AC02", 20000: "A09C01", 1 << 40: "808080808020"}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", F.hex(codec.uvarint(F.col("n"))).alias("h")).collect()
    assert {r.n: r.h for r in rows} == want
    for n, h in want.items():
        assert codec.read_uvarint(bytes.fromhex(h), 0) == (n, len(h) // 2)


def test_records(spark):
    rows = spark.createDataFrame([("a", "1", False, 1), ("a", None, True, 300), ("k" * 200, "v" * 20000, False, 1 << 40), ("", "", False, 0)], "k string, v string, t boolean, s long")
    got = [bytes(r[0]) for r in rows.select(codec.encode_record(F.col("k"), F.col("v"), F.col("t"), F.col("s"))).collect()]
    assert got[0].hex() == "010100016131" and got[1].hex() == "010001ac0261" and len(got[2]) == 20212
    assert codec.decode_records(b"".join(got)) == [(b"a", b"1", False, 1), (b"a", None, True, 300), (b"k" * 200, b"v" * 20000, False, 1 << 40), (b"", b"", False, 0)]


@given(st.lists(st.tuples(st.binary(max_size=300), st.binary(max_size=300), st.booleans(), st.integers(0, (1 << 63) - 1)), max_size=5), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_cut_runs_keep_whole_records(records, cut):
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    parts = [number(len(k)) + number(0 if t else len(v)) + bytes([t]) + number(s) + k + (b"" if t else v) for k, v, t, s in records]
    data, want = b"".join(parts), [(k, None if t else v, t, s) for k, v, t, s in records]
    assert codec.decode_records(data, strict=True) == want
    short = codec.decode_records(data[: max(0, len(data) - cut)])
    assert short == want[: len(short)]


def test_cells(spark):
    row = spark.range(7).select(F.col("id").cast("int").alias("i"))
    bits = row.select(hashing.cell(F.lit("apple"), BASE, F.col("i"), 4, 959).alias("x"), hashing.cell(F.lit("apple"), BASE, F.col("i"), 32, 272).alias("y"), "i").orderBy("i").collect()
    assert [r.x for r in bits] == [696, 909, 260, 569, 164, 746, 615]
    assert [r.y for r in bits][:6] == [122, 196, 131, 121, 51, 127]
    wide = row.select(hashing.cell(F.lit("apple"), BASE, F.col("i"), 4, (1 << 32) - 5).alias("x")).collect()
    import hashlib

    digest = lambda i: int.from_bytes(hashlib.md5(b"apple" + (BASE + i).to_bytes(4, "big")).digest()[:8], "big")
    assert [r.x for r in wide] == [digest(i) % ((1 << 32) - 5) for i in range(7)]


PARSED = {
    "put( k , v )": ("PUT", ["k", "v"]),
    'PUT(k,"a, b")': ("PUT", ["k", "a, b"]),
    r'PUT(k,"a\"b\\c")': ("PUT", ["k", 'a"b\\c']),
    'PUT(k,ab"c d"ef)': ("PUT", ["k", "abc def"]),
    'PUT(k," v ")': ("PUT", ["k", "v"]),
    "PUT(a,b)) x": ("PUT", ["a", "b)"]),
    r"PUT(k,a\nb)": ("PUT", ["k", r"a\nb"]),
    r'PUT(k,"a\nb")': ("PUT", ["k", "a\nb"]),
    "GET()": ("GET", []),
    "exit": ("EXIT", []),
    "EXIT(x)": ("EXIT", ["x"]),
    "(k)": commands.NOT_A_CALL,
    "GET k": commands.NOT_A_CALL,
    "GET)k(": commands.NOT_A_CALL,
    'PUT(k,"a)': commands.OPEN_QUOTE,
    r'PUT(k,"a\)': commands.OPEN_ESCAPE,
    "PUT(,x)": commands.EMPTY_ARGUMENT,
    "PUT(k,)": commands.EMPTY_ARGUMENT,
    'PUT(k,"")': commands.EMPTY_ARGUMENT,
    r'PUT(k,"\n")': commands.EMPTY_ARGUMENT,
    "": "",
    None: "",
}


def test_parser(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(PARSED)], "i int, line string")
    for r, want in zip(commands.parse_lines(lines).orderBy("i").collect(), PARSED.values(), strict=True):
        if isinstance(want, str):
            assert (r.call.ok, r.call.err) == (False, want)
        else:
            assert (r.call.ok, r.call.cmd, r.call.args) == (True, *want)


@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), min_size=1, max_size=8).filter(lambda t: t.strip()), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_quoted_arguments_come_back(args):
    line = ",".join('"' + a.replace("\\", "\\\\").replace('"', '\\"') + '"' for a in args)
    assert commands.split_arguments(line) == ([a.strip() for a in args], None)


def test_durations(spark):
    want = {"1h30m": 54 * 10**11, "-1.5h": -54 * 10**11, ".5s": 5 * 10**8, "1µs": 1000, "+2ms": 2 * 10**6, "1": None, "1.2.3s": None, "h": None, "0": 0, "1s x": None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", commands.duration_ns(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == want


def test_settings(spark):
    texts = ['{"block_size": 5000, "memtable_type": "btree", "multi_file_sstable": false}', "not json", "{}"]
    got = config.load(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert [r.bad for r in got] == [False, True, False]
    assert (got[0].block_size, got[0].memtable_type, got[0].multi_file_sstable) == (4096, "btree", False)
    for r in got[1:]:
        assert {k: r[k] for k in config.DEFAULTS} == config.DEFAULTS
    assert json.loads(json.dumps(config.DEFAULTS))


def test_bloom_bytes(spark):
    items = spark.createDataFrame([("apple",), ("banana",), ("cherry",)], "item string")
    m, k = sketches.filter_bits(100, 0.01), sketches.filter_hashes(100, 959)
    assert (m, k) == (959, 7)
    bits = sketches.bloom(items, "item", m, k, BASE)
    data = bytes(sketches.serialize_bloom(bits, m, k, BASE).first()[0])
    assert len(data) == 132 and data[:12].hex() == "000003bf000000076553f100"
    back = sketches.deserialize_bloom(spark.createDataFrame([(bytearray(data),)], "data binary"))
    assert {(r.m, r.k, r.base) for r in back.collect()} == {(m, k, BASE)}
    back = back.select("bit")
    assert back.exceptAll(bits).count() == 0 == bits.exceptAll(back).count() and back.count() == 20
    absent = spark.createDataFrame([("pear",), ("grape",), ("mango",), ("apple",)], "item string")
    assert {r.item: r.maybe for r in sketches.might_contain(bits, absent, "item", m, k, BASE).collect()} == {"pear": False, "grape": False, "mango": False, "apple": True}
    for bad in (b"", data[:-1], bytes(12)):
        with pytest.raises(Exception, match="invalid bloom filter data"):
            sketches.deserialize_bloom(spark.createDataFrame([(bytearray(bad),)], "data binary")).collect()
    with pytest.raises(ValueError):
        sketches.merge_blooms((bits, m, k, BASE), (bits, m, k, BASE + 1))
    with pytest.raises(ValueError):
        sketches.read_meta(bytes(12))


def test_counter_bytes(spark):
    m, k = sketches.counter_columns(0.01), sketches.counter_rows(0.01)
    assert (m, k) == (272, 6)
    sketch = sketches.counter(spark.createDataFrame([("apple",), ("apple",)], "item string"), "item", m, k, BASE)
    data = sketches.serialize_counter(sketch, m, k)
    assert len(data.first()[0]) == 13072
    assert sorted(map(tuple, sketches.deserialize_counter(data).collect())) == sorted(map(tuple, sketch.select("row", "idx", "cnt").collect()))
    with pytest.raises(ValueError):
        sketches.merge_counters((sketch, m, k, 1), (sketch, m, k, 2))
