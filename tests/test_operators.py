"""State, layout, runs, blocks and cache against small models."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from statelog.operators import blocks, layout, state
from statelog.operators.session import session
from statelog.sources import runs

OPS = "key string, value string, tombstone boolean, seq long"


def log_of(spark, ops):
    return spark.createDataFrame([(k, v, v is None, i + 1) for i, (k, v) in enumerate(ops)], OPS)


def rotated(ops, entries, most):
    """Tables as dictionaries: the generation of each operation."""
    table, gen, out = {}, 0, []
    for k, v in ops:
        table[k] = len(k) + len(v or "") + 41
        out.append(gen)
        if len(table) >= entries or sum(table.values()) >= most:
            table, gen = {}, gen + 1
    return out, gen


@pytest.mark.parametrize("seed", range(4))
def test_generations(spark, seed):
    rng = random.Random(seed)
    ops = [(rng.choice("abcdefgh"), rng.choice([None, "x" * rng.randint(0, 90)])) for _ in range(200)]
    entries, most, n = rng.randint(1, 6), rng.choice([100, 300, 10**9]), rng.randint(1, 4)
    want, fulls = rotated(ops, entries, most)
    laid = layout.generations(log_of(spark, ops), entries, most)
    assert [r.gen for r in laid.orderBy("seq").collect()] == want
    tiers = {r.gen: r.tier for r in layout.with_tiers(laid, entries, most, n).collect()}
    assert tiers == {g: "SST" if g <= fulls - n else "RO" if g < fulls else "ACTIVE" for g in set(want)}


@pytest.mark.parametrize("seed", range(6))
def test_generations_over_ranges(spark, seed):
    """Ranges side by side against the serial fold, also where a table takes more than one."""
    rng = random.Random(100 + seed)
    letters = [f"k{i}" for i in range(rng.choice([3, 12, 400]))]
    ops = [(rng.choice(letters) if seed < 5 else f"u{i}", rng.choice([None, "x" * rng.randint(0, 90)])) for i in range(rng.choice([150, 301]))]
    entries, most = rng.randint(1, 9), rng.choice([200, 600, 10**9])
    want, _ = rotated(ops, entries, most)
    laid = layout.generations(log_of(spark, ops), entries, most, span=rng.choice([16, 50]))
    assert [r.gen for r in laid.orderBy("seq").collect()] == want


@pytest.mark.parametrize("seed", range(40))
def test_openings(seed):
    rng = random.Random(seed)
    keys = [rng.choice("abcdefgh") for _ in range(60)]
    sizes = [rng.randint(1, 9) for _ in keys]
    entries, most, own = rng.randint(1, 9), rng.choice([10, 30, 10**9]), rng.randint(1, 60)

    def after(start):
        table = {}
        for i in range(start, len(keys)):
            table[keys[i]] = sizes[i]
            if len(table) >= entries or sum(table.values()) >= most:
                return i + 1
        return -1

    leave, count, next_ = layout.openings(keys, sizes, own, entries, most)
    assert next_.tolist() == [after(i) for i in range(own)]
    for i in range(len(leave)):
        at, n = i, 0
        while 0 <= at < own:
            at, n = after(at), n + 1
        assert (leave[i], count[i]) == (at, n)


def test_single_file_mode(spark):
    ops = log_of(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")])
    laid = layout.generations(ops, 2, 10**9)
    tiered = layout.with_tiers(laid, 2, 10**9, 1, multi_file=False)
    assert layout.recovered(tiered).count() == 0 == layout.runs(tiered).count()
    assert {r.key: r.tier for r in layout.layered_get(tiered).collect()} == {"e": "ACTIVE"}
    with pytest.raises(ValueError, match="instance"):
        layout.with_tiers(laid, 2, 10**9, 0)


def test_appended_operations_and_expiry(spark):
    ops = spark.createDataFrame([("a", "1", False, 7, 0)], OPS + ", expires_at long")
    more = spark.createDataFrame([("b", "2", False, 99, 2), ("a", None, True, 0, 1)], "key string, value string, tombstone boolean, expires_at long, line long")
    got = state.appended(ops, more, "line").orderBy("seq").collect()
    assert [(r.key, r.seq, r.expires_at) for r in got] == [("a", 7, 0), ("a", 8, 0), ("b", 9, 99)]
    rows = spark.sql("SELECT 10900000L AS now, n FROM VALUES (100000000L), (1500000000L), (-900000000L), (CAST(NULL AS LONG)) t(n)")
    assert [r[0] for r in rows.select(state.expiry(F.col("now"), F.col("n"))).collect()] == [11, 12, 10, 0]


def test_ordered_scan(spark):
    keys = [f"prefix{i % 97:03d}{'é' if i % 3 else ''}" for i in range(300)]
    got = state.ordered_scan(log_of(spark, [(k, "v") for k in keys]).repartition(7)).orderBy("pos").collect()
    assert [(r.pos, r.key) for r in got] == list(enumerate(sorted(set(keys), key=str.encode), 1))


def test_stream_state_after_several_batches(spark, tmp_path):
    from statelog.streaming import state as streaming

    ops = [("a", "1"), ("b", "2"), ("a", None), ("c", "3"), ("b", "4")]
    folder = str(tmp_path / "in")
    log = log_of(spark, ops)
    for i in range(len(ops)):
        log.filter(F.col("seq") == i + 1).coalesce(1).write.mode("append").parquet(folder)
        streaming.run_available(spark.readStream.schema(OPS).parquet(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = {"a": (None, 3), "b": ("4", 5), "c": ("3", 4)}
    assert {r.key: (r.value, r.seq) for r in streaming.read_state(spark, str(tmp_path / "out")).collect()} == want
    streaming.compact(spark, str(tmp_path / "out"), str(tmp_path / "new"))
    assert {r.key: (r.value, r.seq) for r in streaming.read_state(spark, str(tmp_path / "new")).collect()} == want


def test_sharded_generations(spark):
    ops = log_of(spark, [("a", "1"), ("b", "2"), ("a", "3"), ("c", "4")])
    both = ops.withColumn("store", F.lit("x")).union(ops.withColumn("store", F.lit("y")))
    laid = layout.generations(both, 2, 10**9, "store").select("seq", "gen").collect()
    assert sorted((r.seq, r.gen) for r in laid) == [(1, 0), (1, 0), (2, 0), (2, 0), (3, 1), (3, 1), (4, 1), (4, 1)]


def test_recovery_resurrects(spark):
    ops = log_of(spark, [("a", "1"), ("a", "2"), ("b", "3"), ("a", None), ("c", "4"), ("d", "5")])
    tiered = layout.with_tiers(layout.generations(ops, 2, 10**9), 2, 10**9, 2)
    assert {r.key: r.value for r in layout.recovered(tiered).collect()} == {"a": "2", "b": "3"}
    assert {r.key: (r.found, r.tier) for r in layout.layered_get(tiered).collect()} == {"a": (False, "RO"), "b": (True, "SST"), "c": (True, "RO"), "d": (True, "ACTIVE")}


def test_null_value_wins(spark):
    ops = spark.createDataFrame([("a", "1", False, 1), ("a", None, False, 2)], OPS)
    assert [tuple(r) for r in state.latest(ops).collect()] == [("a", None, 2)]


def test_epochs_come_before_seq(spark):
    ops = spark.createDataFrame([("a", "old", False, 9, 0), ("a", "new", False, 1, 1)], OPS + ", epoch long")
    assert state.latest(ops).first().value == "new"


def test_empty_log(spark):
    ops = spark.createDataFrame([], OPS)
    assert state.latest(ops).count() == 0
    laid = layout.generations(ops, 3, 100)
    assert layout.with_tiers(laid, 3, 100, 2).count() == 0
    asked = spark.createDataFrame([("a",)], "key string")
    assert [tuple(r) for r in state.multi_get(ops, asked).collect()] == [("a", False, None)]


def test_puts_and_deletes(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "k string, v string, s long")
    ops = state.puts(rows, F.col("k"), F.col("v"), F.col("s")).unionByName(state.deletes(rows.filter("k = 'a'"), F.col("k"), F.col("s") + 10))
    assert [r.key for r in state.latest(ops).collect()] == ["b"]


def test_session(spark):
    script = ["PUT(k, 1)", "GET(k)", "", "DELETE(k)", "GET(k)", "PUT(k,2,5x)", "PUT(k)", "get k", "FOO(1)", "PUT(k,3,1h)", "GET(k)", "GET(a,b)", "QUIT", "GET(k)"]
    got = session(spark.createDataFrame(list(enumerate(script)), "line_no long, line string")).orderBy("line_no").collect()
    want = ["OK", "1", "OK", "(nil)", "invalid TTL, use 10s, 5m, 2h", None, "parse error: expected format CMD(arg1,arg2,...)", "unknown command", "OK", "3", "usage: GET(key)"]
    assert len(got) == len(want) and all(w is None or g.output == w for g, w in zip(got, want, strict=True))


def test_run_files(spark, tmp_path):
    ops = log_of(spark, [("b", "1"), ("a", "2"), ("c", None), ("a", "3"), ("b", None), ("d", "4")])
    laid = layout.generations(ops, 3, 10**9)
    tiered = layout.with_tiers(laid, 3, 10**9, 1)
    spark.dataSource.register(runs.RunFiles)
    rows = layout.runs(tiered)
    data = rows.select("gen", F.col("key").cast("binary").alias("key"), state.encode_record(F.col("key"), F.col("value"), F.col("tombstone"), F.col("seq")).alias("data"))
    data.write.format("statelog_runs").mode("append").save(str(tmp_path / "level0"))
    back = runs.read_runs(spark, str(tmp_path / "level0"), strict=True)
    assert sorted((r.key.decode(), r.tombstone, r.seq) for r in back.collect()) == sorted((r.key, r.tombstone, r.seq) for r in rows.collect())
    # The open table's operations are in no run.
    won = {}
    for r in sorted(rows.collect(), key=lambda r: r.gen):
        won[r.key] = None if r.tombstone else r.value.encode()
    assert {r.key.decode(): bytes(r.value) for r in runs.newest_run_get(back).collect()} == {k: v for k, v in won.items() if v is not None}
    assert not list((tmp_path / "level0").glob("*.part"))
    first = sorted((tmp_path / "level0").glob("*.data"))[-1]
    first.write_bytes(first.read_bytes()[:-1])
    assert runs.read_runs(spark, str(tmp_path / "level0")).count() == rows.count() - 1
    with pytest.raises(Exception, match="damaged"):
        runs.read_runs(spark, str(tmp_path / "level0"), strict=True).count()


def test_parquet_runs(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "1", False, 1), (1, "a", "2", False, 2)], "gen long, " + OPS)
    runs.write_parquet_runs(rows, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_blocks(spark):
    files = spark.createDataFrame([("f", b"0123456789"), ("empty", b""), ("none", None)], "path string, content binary")
    cut = blocks.split(files, 4)
    assert sorted((r.path, r.block_num, bytes(r.data)) for r in cut.collect()) == [("f", 0, b"0123"), ("f", 1, b"4567"), ("f", 2, b"89\0\0")]
    assert bytes(blocks.join(cut).first().content) == b"0123456789\0\0"
    assert bytes(files.filter("path = 'f'").select(blocks.block_of(F.col("content"), F.lit(9), 4)).first()[0]) == bytes(4)
    assert bytes(files.filter("path = 'f'").select(blocks.read_at(F.col("content"), 8, 2)).first()[0]) == b"89"
    with pytest.raises(Exception, match="file truncated"):
        files.filter("path = 'f'").select(blocks.read_at(F.col("content"), 8, 3)).collect()
    more = blocks.append(cut, spark.createDataFrame([("f", b"abcd", 1), ("g", b"efgh", 1)], "path string, data binary, ord int"), 4)
    assert sorted((r.path, r.block_num) for r in more.collect()) == [("f", 3), ("g", 0)]
    with pytest.raises(Exception, match="invalid block size"):
        blocks.append(cut, spark.createDataFrame([("f", b"abc", 1)], "path string, data binary, ord int"), 4).collect()
    wrote = blocks.write(cut, spark.createDataFrame([("f", 5, b"zzzz", 1), ("f", 5, b"yyyy", 2)], "path string, block_num long, data binary, seq long"), 4)
    assert {r.block_num: bytes(r.data) for r in wrote.collect()} == {0: b"0123", 1: b"4567", 2: b"89\0\0", 3: bytes(4), 4: bytes(4), 5: b"yyyy"}


@pytest.mark.parametrize("seed", range(3))
def test_cache(spark, seed):
    rng = random.Random(seed)
    acc = [("f", rng.randrange(6), rng.choice([8, 16, 40]), i) for i in range(80)]
    held, used, want = OrderedDict(), 0, []
    for p, n, size, _ in acc:
        want.append((p, n) in held)
        if (p, n) in held:
            used -= held.pop((p, n))
        held[p, n] = size
        used += size
        while used > 32 and held:
            used -= held.popitem(last=False)[1]
    got = blocks.cache_trace(spark.createDataFrame(acc, "path string, block_num long, size long, seq long"), 32).orderBy("seq").collect()
    assert [r.hit for r in got] == want


def test_script_files(spark, tmp_path):
    from statelog.operators.session import read_script, write_output

    (tmp_path / "script").write_text("PUT(a,1)\n\nGET(a)\r\nDELETE(a)\nGET(a)\nEXIT\nGET(a)\n")
    write_output(session(read_script(spark, str(tmp_path / "script"))), str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["OK", "1", "OK", "(nil)"]


def test_store(spark, tmp_path):
    from statelog.store import Store

    folder = str(tmp_path / "store")
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "config.json").write_text('{"memtable_max_entries": 2, "memtable_max_bytes": 100000, "memtable_instances": 1}')
    store = Store(spark, folder)
    assert store.settings["memtable_max_entries"] == 2 and store.log.count() == 0 == store.recovered().count()
    rows = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "a", "3"), (4, "c", "4")], "i int, key string, value string")
    store.put(rows, "i", F.lit(10_900_000), F.lit(1_500_000_000))
    store.delete(rows.filter("i = 2"), "i")
    assert [(r.seq, r.expires_at) for r in store.log.orderBy("seq").collect()] == [(1, 12), (2, 12), (3, 12), (4, 12), (5, 0)]
    assert [tuple(r) for r in store.get("a").select("key", "value").collect()] == [("a", "3")] and store.get("b").count() == 0
    store.flush()
    store.flush()
    again = Store(spark, folder)
    assert {r.key.decode(): bytes(r.value) for r in again.recovered().collect()} == {"a": b"3", "b": b"2", "c": b"4"}
    assert again.runs().count() == 4
    blocks_ = spark.createDataFrame([("f", 0, b"x" * 8)], "path string, block_num long, data binary")
    assert store.cached(blocks_).storageLevel.useMemory
    blocks_.unpersist()
    assert Store(spark, folder, {"multi_file_sstable": False, "memtable_max_entries": 2, "memtable_max_bytes": 100000}).tiered().filter("tier = 'SST'").count() == 0
