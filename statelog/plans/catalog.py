"""Queries over the test tables and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog import config
from statelog.functions import commands
from statelog.functions.codec import decode_records
from statelog.operators import blocks, layout, session, sketches, state
from statelog.sources import runs
from statelog.sources.shared import new_folder
from statelog.streaming.state import read_state, run_available

BASE = 1700000000
BLOOM = (14378, 7)
CMS = (272, 6)
BLOCK = 4096
#: (entries, bytes, instances) of the two layouts that are shown.
SMALL = (3, 1024, 4)
WIDE = (40, 1_000_000_000, 4)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that states its result."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an op log: one put per event, a delete for each error."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        (F.col("event_id") + 1).alias("seq"),
        F.col("event_type").alias("kind"),
    )


_OPS = "SELECT 'u' || user_id AS key, props AS value, event_type = 'error' AS tomb, event_id + 1 AS seq, event_type AS kind FROM events"
_WON = f"(SELECT key, arg_max({{'value': value, 'tomb': tomb, 'seq': seq}}, seq) AS w FROM ({_OPS}) GROUP BY key)"


@query(f"SELECT key, w.value AS value, w.seq AS seq FROM {_WON} WHERE NOT w.tomb")
def kv_latest_state(spark, sf_dir):
    """Live keys with their newest value."""
    return state.latest(event_log(spark, sf_dir))


@query(f"SELECT key, w.value AS value, w.seq AS seq FROM {_WON} WHERE NOT w.tomb AND key = 'u7'")
def kv_point_get(spark, sf_dir):
    """One key."""
    return state.get(event_log(spark, sf_dir), "u7")


_ASKED = "(SELECT 'u' || i AS key FROM range(0, 40) t(i) UNION ALL SELECT 'missing')"


@query(f"SELECT a.key, coalesce(NOT s.w.tomb, false) AS found, CASE WHEN NOT s.w.tomb THEN s.w.value END AS value FROM {_ASKED} a LEFT JOIN {_WON} s ON a.key = s.key")
def kv_multi_get(spark, sf_dir):
    """A list of keys, missing ones included."""
    asked = spark.range(40).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("key")).union(spark.createDataFrame([("missing",)], "key string"))
    return state.multi_get(event_log(spark, sf_dir), asked)


@query(
    f"""WITH o AS ({_OPS}), g AS (SELECT * FROM o WHERE kind = 'click'), p AS (SELECT * FROM o WHERE kind <> 'click')
SELECT g.seq, g.key, coalesce(NOT p.tomb, false) AS found, CASE WHEN NOT p.tomb THEN p.value END AS value
FROM g ASOF LEFT JOIN p ON g.key = p.key AND g.seq > p.seq"""
)
def kv_get_asof(spark, sf_dir):
    """What each get of the log saw."""
    log = event_log(spark, sf_dir)
    return state.get_as_of(log.filter("kind <> 'click'"), log.filter("kind = 'click'"))


@query(f"SELECT key, w.seq AS seq FROM {_WON} WHERE w.tomb")
def kv_tombstones(spark, sf_dir):
    """Keys whose newest operation is a delete."""
    return state.tombstones(event_log(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY key) AS pos, key, w.value AS value FROM {_WON} WHERE NOT w.tomb")
def kv_ordered_scan(spark, sf_dir):
    """Live keys with their place in byte order."""
    return state.ordered_scan(event_log(spark, sf_dir))


_SIZE = "(octet_length(encode(key)) + CASE WHEN tomb THEN 0 ELSE coalesce(octet_length(encode(value)), 0) END + 41)::BIGINT"


@query(f"SELECT kind, count(*) AS n_ops, sum({_SIZE})::BIGINT AS bytes, max({_SIZE}) AS largest FROM ({_OPS}) GROUP BY kind")
def kv_record_size(spark, sf_dir):
    """Bytes of records by kind of event."""
    log = event_log(spark, sf_dir)
    size = state.record_size(log)
    return log.groupBy("kind").agg(F.count("*").alias("n_ops"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def _laid(e: int, b: int) -> str:
    """Common table expressions that end in laid(key, value, tomb, seq, sz, gen)."""
    full = f"(e >= {e} OR b >= {b})"
    return f"""WITH RECURSIVE o AS (SELECT key, value, tomb, seq, {_SIZE} AS sz, row_number() OVER (ORDER BY seq) - 1 AS i FROM ({_OPS})),
l AS (SELECT i, sz, coalesce(lag(i) OVER w, -1) AS p, coalesce(lag(sz) OVER w, 0) AS ps FROM o WINDOW w AS (PARTITION BY key ORDER BY i)),
f(i, gen, s, e, b, ns, ng) AS (
  SELECT i, 0::BIGINT, 0::BIGINT, 1::BIGINT, sz, CASE WHEN 1 >= {e} OR sz >= {b} THEN 1 ELSE 0 END::BIGINT, CASE WHEN 1 >= {e} OR sz >= {b} THEN 1 ELSE 0 END::BIGINT FROM l WHERE i = 0
  UNION ALL
  SELECT i, gen, s, e, b, CASE WHEN {full} THEN i + 1 ELSE s END, CASE WHEN {full} THEN gen + 1 ELSE gen END FROM (
    SELECT l.i, f.ng AS gen, f.ns AS s,
      CASE WHEN f.ng <> f.gen THEN 0 ELSE f.e END + CASE WHEN l.p >= f.ns THEN 0 ELSE 1 END AS e,
      CASE WHEN f.ng <> f.gen THEN 0 ELSE f.b END + l.sz - CASE WHEN l.p >= f.ns THEN l.ps ELSE 0 END AS b
    FROM f JOIN l ON l.i = f.i + 1)),
laid AS (SELECT o.*, f.gen, f.ng FROM o JOIN f ON o.i = f.i),
fu AS (SELECT max(ng) AS fulls FROM laid)"""


def _tiered(e: int, b: int, n: int) -> str:
    return _laid(e, b) + f""",
t AS (SELECT laid.*, CASE WHEN gen <= fulls - {n} THEN 'SST' WHEN gen < fulls THEN 'RO' ELSE 'ACTIVE' END AS tier FROM laid, fu)"""


def _layout(spark, sf_dir, kind):
    """The log laid out, written once, and the same with its tiers."""
    laid = layout.generations(event_log(spark, sf_dir), kind[0], kind[1])
    return laid, layout.with_tiers(laid, *kind)


@query(_laid(*WIDE[:2]) + " SELECT seq, gen FROM laid")
def mem_generations(spark, sf_dir):
    """The in-memory table that took each operation."""
    return _layout(spark, sf_dir, WIDE)[0].select("seq", "gen")


@query(_laid(*SMALL[:2]) + " SELECT seq, gen FROM laid")
def mem_generations_small(spark, sf_dir):
    """The same with tables of three entries."""
    return _layout(spark, sf_dir, SMALL)[0].select("seq", "gen")


@query(_laid(*WIDE[:2]) + ", k AS (SELECT gen, key, count(*) AS n, arg_max(sz, seq) AS z FROM laid GROUP BY 1, 2) SELECT gen, sum(n)::BIGINT AS n_ops, count(*) AS n_keys, sum(z)::BIGINT AS bytes FROM k GROUP BY gen")
def mem_generation_stats(spark, sf_dir):
    """Operations, keys and bytes of each table."""
    return layout.generation_stats(_layout(spark, sf_dir, WIDE)[0])


@query(_tiered(*SMALL) + " SELECT gen, tier, count(*) AS n_ops FROM t GROUP BY 1, 2")
def mem_tiers(spark, sf_dir):
    """Where each table is by now."""
    return _layout(spark, sf_dir, SMALL)[1].groupBy("gen", "tier").agg(F.count("*").alias("n_ops"))


@query(
    _tiered(*WIDE)
    + """, r AS (SELECT gen, key, arg_max({'value': value, 'tomb': tomb, 'seq': seq}, seq) AS w FROM t WHERE tier = 'SST' GROUP BY 1, 2)
SELECT gen, key, w.value AS value, w.tomb AS tombstone, w.seq AS seq FROM r"""
)
def flush_runs(spark, sf_dir):
    """Records of all runs on disk."""
    return layout.runs(_layout(spark, sf_dir, WIDE)[1])


@query(_tiered(*WIDE) + ", r AS (SELECT key, arg_max({'tomb': tomb, 'gen': gen, 'tier': tier}, seq) AS w FROM t GROUP BY 1) SELECT key, NOT w.tomb AS found, w.gen AS gen, w.tier AS tier FROM r")
def layered_get(spark, sf_dir):
    """Which layer answers for each key."""
    return layout.layered_get(_layout(spark, sf_dir, WIDE)[1])


@query(
    _tiered(*WIDE)
    + """, r AS (SELECT key, arg_max({'value': value, 'tomb': tomb, 'seq': seq}, seq) AS w FROM t WHERE tier = 'SST' GROUP BY 1)
SELECT key, w.value AS value, w.seq AS seq FROM r WHERE NOT w.tomb"""
)
def recovery_state(spark, sf_dir):
    """The state that the runs alone give."""
    return layout.recovered(_layout(spark, sf_dir, WIDE)[1])


def _written_runs(spark, sf_dir):
    """The runs of the log's layout, written as files of encoded records and read again."""
    rows = layout.runs(_layout(spark, sf_dir, WIDE)[1])
    data = rows.select("gen", F.col("key").cast("binary").alias("key"), state.encode_record(F.col("key"), F.col("value"), F.col("tombstone"), F.col("seq")).alias("data"))
    folder = new_folder(spark, "runs")
    spark.dataSource.register(runs.RunFiles)
    data.write.format("statelog_runs").mode("append").save(folder)
    return runs.read_runs(spark, folder, strict=True)


_RUNS = _tiered(*WIDE) + ", r AS (SELECT gen, key, arg_max({'value': value, 'tomb': tomb, 'seq': seq}, seq) AS w FROM t WHERE tier = 'SST' GROUP BY 1, 2)"


@query(_RUNS + " SELECT printf('run_%019d.data', gen) AS run, key, CASE WHEN NOT w.tomb THEN w.value END AS value, w.tomb AS tombstone, w.seq AS seq FROM r")
def run_files(spark, sf_dir):
    """Every record of every run file that a folder holds."""
    return _written_runs(spark, sf_dir).select("run", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone", "seq")


@query(_RUNS + ", n AS (SELECT key, arg_max(w, gen) AS w FROM r GROUP BY key) SELECT key, w.value AS value, w.seq AS seq FROM n WHERE NOT w.tomb")
def run_files_get(spark, sf_dir):
    """What the newest run file with a key says about it, for every key."""
    found = runs.newest_run_get(_written_runs(spark, sf_dir))
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "seq")


@query(_tiered(*WIDE) + ", r AS (SELECT key, arg_max({'tomb': tomb, 'gen': gen, 'tier': tier}, seq) AS w FROM t WHERE tier <> 'SST' GROUP BY 1) SELECT key, NOT w.tomb AS found, w.gen AS gen, w.tier AS tier FROM r")
def layered_get_single_file(spark, sf_dir):
    """Single-file mode writes no runs: what was flushed is found by no read."""
    laid = _layout(spark, sf_dir, WIDE)[0]
    return layout.layered_get(layout.with_tiers(laid, *WIDE, multi_file=False))


@query(f"SELECT (seq - 1) // 1000 AS segment, count(*) AS n_ops, min(seq) AS first_seq, max(seq) AS last_seq FROM ({_OPS}) GROUP BY 1")
def wal_segments(spark, sf_dir):
    """The log in segments."""
    return layout.segments(event_log(spark, sf_dir))


def _varint(v: str) -> str:
    """Hexadecimal digits of a varint below 2 ** 28."""
    h = lambda x: f"printf('%02X', ({x})::BIGINT)"
    return f"""CASE WHEN {v} < 128 THEN {h(v)} WHEN {v} < 16384 THEN {h(f'{v} % 128 + 128')} || {h(f'{v} // 128')}
WHEN {v} < 2097152 THEN {h(f'{v} % 128 + 128')} || {h(f'{v} // 128 % 128 + 128')} || {h(f'{v} // 16384')}
ELSE {h(f'{v} % 128 + 128')} || {h(f'{v} // 128 % 128 + 128')} || {h(f'{v} // 16384 % 128 + 128')} || {h(f'{v} // 2097152')} END"""


@query(
    f"""SELECT seq, ({_varint("octet_length(encode(key))")}) || ({_varint("octet_length(encode(v))")}) || CASE WHEN tomb THEN '01' ELSE '00' END || ({_varint("seq")}) || hex(encode(key)) || hex(encode(v)) AS data
FROM (SELECT *, CASE WHEN tomb THEN '' ELSE coalesce(value, '') END AS v FROM ({_OPS}))"""
)
def sst_encode(spark, sf_dir):
    """Each operation in the run format."""
    return state.encoded(event_log(spark, sf_dir)).select("seq", F.hex("data").alias("data"))


def _decoded(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [r for data in batch.column("data").to_pylist() for r in decode_records(data, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        text = [[None if x is None else x.decode() for x in c] for c in cols[:2]]
        yield pa.RecordBatch.from_arrays([pa.array(text[0], pa.string()), pa.array(text[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())], ["key", "value", "tombstone", "seq"])


@query(f"SELECT key, CASE WHEN NOT tomb THEN value END AS value, tomb AS tombstone, seq FROM ({_OPS})")
def sst_roundtrip(spark, sf_dir):
    """Operations decoded from the run format."""
    return state.encoded(event_log(spark, sf_dir)).select("data").mapInArrow(_decoded, "key string, value string, tombstone boolean, seq long")


@query("SELECT e AS epsilon, d AS delta, ceil(exp(1) / e)::BIGINT AS m, ceil(ln(exp(1) / d))::BIGINT AS k FROM (VALUES (0.1::DOUBLE, 0.1::DOUBLE), (0.05, 0.05), (0.01, 0.01), (0.001, 0.01)) t(e, d)")
def cms_params(spark, sf_dir):
    """Shapes of counters."""
    rows = spark.createDataFrame([(0.1, 0.1), (0.05, 0.05), (0.01, 0.01), (0.001, 0.01)], "epsilon double, delta double")
    return rows.select("*", sketches.counter_columns(F.col("epsilon")).alias("m"), sketches.counter_rows(F.col("delta")).alias("k"))


@query(
    """SELECT n, p, m, ceil(m / n * ln(2))::BIGINT AS k FROM (SELECT n, p, ceil(n * abs(ln(p)) / pow(ln(2), 2))::BIGINT AS m
FROM (VALUES (100::BIGINT, 0.01::DOUBLE), (150, 0.01), (1000, 0.01), (1500, 0.01), (10000, 0.001)) t(n, p))"""
)
def bloom_params(spark, sf_dir):
    """Shapes of filters."""
    rows = spark.createDataFrame([(100, 0.01), (150, 0.01), (1000, 0.01), (1500, 0.01), (10000, 0.001)], "n long, p double")
    rows = rows.withColumn("m", sketches.filter_bits(F.col("n"), F.col("p")))
    return rows.withColumn("k", sketches.filter_hashes(F.col("n"), F.col("m")))


def _cell(item: str, row: str, width: int, m: int) -> str:
    seed = f"rpad(printf('%08x', {BASE} + {row}), {2 * width}, '0')"
    return f"(concat('0x', substr(md5(encode({item}) || unhex({seed})), 1, 16))::UBIGINT % {m})::BIGINT"


_KEYS = "(SELECT 'u' || user_id AS item FROM events)"
_CELLS = f"(SELECT item, r::INTEGER AS row, {_cell('item', 'r', 32, CMS[0])} AS idx FROM {_KEYS}, range({CMS[1]}) t(r))"
_SKETCH = f"(SELECT row, idx, count(*) AS cnt FROM {_CELLS} GROUP BY 1, 2)"


def _items(spark, sf_dir):
    return event_log(spark, sf_dir).select(F.col("key").alias("item"), "seq")


def _counter(items):
    return sketches.counter(items, "item", *CMS, BASE)


@query(f"SELECT * FROM {_SKETCH}")
def cms_table(spark, sf_dir):
    """Cells of a counter of all keys."""
    return _counter(_items(spark, sf_dir))


@query(
    f"""SELECT item, est, n AS exact, est >= n AS covers FROM (SELECT DISTINCT c.item, min(s.cnt) OVER (PARTITION BY c.item) AS est FROM {_CELLS} c JOIN {_SKETCH} s USING (row, idx))
JOIN (SELECT item, count(*) AS n FROM {_KEYS} GROUP BY 1) USING (item)"""
)
def cms_estimate(spark, sf_dir):
    """Estimates of all keys against their counts."""
    items = _items(spark, sf_dir)
    exact = items.groupBy("item").agg(F.count("*").alias("exact"))
    return sketches.estimate(_counter(items), items, "item", *CMS, BASE).join(exact, "item").withColumn("covers", F.col("est") >= F.col("exact"))


@query(f"SELECT * FROM {_SKETCH}")
def cms_merge(spark, sf_dir):
    """Two halves of the log, merged."""
    items = _items(spark, sf_dir)
    halves = [_counter(items.filter(F.col("seq") % 2 == i)) for i in (0, 1)]
    return sketches.merge_counters(*[(h, *CMS, BASE) for h in halves])


_CMS_HEX = f"""SELECT printf('%016X', {CMS[0]}) || printf('%016X', {CMS[1]}) || string_agg(printf('%016X', coalesce(cnt, 0)), '' ORDER BY r, i) AS h
FROM (SELECT r::INTEGER AS r, i FROM range({CMS[1]}) a(r), range({CMS[0]}) b(i)) d LEFT JOIN {_SKETCH} s ON s.row = d.r AND s.idx = d.i"""


@query(f"SELECT md5(h) AS digest, (length(h) // 2)::INTEGER AS bytes FROM ({_CMS_HEX})")
def cms_serialize(spark, sf_dir):
    """Digest of a counter's bytes."""
    data = sketches.serialize_counter(_counter(_items(spark, sf_dir)), *CMS)
    return data.select(F.md5(F.hex("data").cast("binary")).alias("digest"), F.octet_length("data").alias("bytes"))


@query(f"SELECT * FROM {_SKETCH}")
def cms_roundtrip(spark, sf_dir):
    """Cells from a counter's bytes."""
    return sketches.deserialize_counter(sketches.serialize_counter(_counter(_items(spark, sf_dir)), *CMS))


_SET = f"(SELECT DISTINCT {_cell('c_name', 'r', 4, BLOOM[0])} AS bit FROM customer, range({BLOOM[1]}) t(r))"
#: A filter of a third of the customers, so that the others can be asked for in vain.
_THIRD = f"{_SET[:-1]} WHERE c_custkey % 3 = 0)"


def _customers(spark, sf_dir, third=False):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("item"), "c_custkey")
    return rows.filter("c_custkey % 3 = 0") if third else rows


def _bits(items):
    return sketches.bloom(items, "item", *BLOOM, BASE)


@query(f"SELECT bit FROM {_SET}")
def bloom_bits(spark, sf_dir):
    """Bits of a filter of all customers."""
    return _bits(_customers(spark, sf_dir))


_PROBE = f"(SELECT item, bool_and(s.bit IS NOT NULL) AS maybe FROM (SELECT c_name AS item, {_cell('c_name', 'r', 4, BLOOM[0])} AS idx FROM customer, range({BLOOM[1]}) t(r)) p LEFT JOIN {_THIRD} s ON p.idx = s.bit GROUP BY item)"


@query(f"SELECT item, maybe FROM {_PROBE}")
def bloom_probe(spark, sf_dir):
    """All customers asked of a filter of a third of them."""
    return sketches.might_contain(_bits(_customers(spark, sf_dir, True)), _customers(spark, sf_dir), "item", *BLOOM, BASE)


@query(f"SELECT count(*) AS absent, count(*) FILTER (WHERE maybe) AS false_hits FROM {_PROBE} p JOIN (SELECT c_name FROM customer WHERE c_custkey % 3 <> 0) c ON p.item = c.c_name")
def bloom_fp_rate(spark, sf_dir):
    """Absent customers that the filter takes for present."""
    absent = _customers(spark, sf_dir).filter("c_custkey % 3 <> 0")
    probed = sketches.might_contain(_bits(_customers(spark, sf_dir, True)), absent, "item", *BLOOM, BASE)
    return probed.agg(F.count("*").alias("absent"), F.count_if("maybe").alias("false_hits"))


_BLOOM_HEX = f"""SELECT printf('%08X', {BLOOM[0]}) || printf('%08X', {BLOOM[1]}) || printf('%08X', {BASE}) || string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY y) AS h
FROM range({-(-BLOOM[0] // 8)}) d(y) LEFT JOIN (SELECT bit // 8 AS z, bit_or((1 << (bit % 8)::INTEGER))::INTEGER AS v FROM {_SET} GROUP BY 1) s ON s.z = d.y"""


@query(f"SELECT md5(h) AS digest, (length(h) // 2)::INTEGER AS bytes FROM ({_BLOOM_HEX})")
def bloom_serialize(spark, sf_dir):
    """Digest of a filter's bytes."""
    data = sketches.serialize_bloom(_bits(_customers(spark, sf_dir)), *BLOOM, BASE)
    return data.select(F.md5(F.hex("data").cast("binary")).alias("digest"), F.octet_length("data").alias("bytes"))


@query(f"SELECT {BLOOM[0]}::BIGINT AS m, {BLOOM[1]}::BIGINT AS k, {BASE}::BIGINT AS base, bit FROM {_SET}")
def bloom_roundtrip(spark, sf_dir):
    """Bits from a filter's bytes."""
    return sketches.deserialize_bloom(sketches.serialize_bloom(_bits(_customers(spark, sf_dir)), *BLOOM, BASE))


@query(f"SELECT bit FROM {_SET}")
def lsm_bloom_replay(spark, sf_dir):
    """Bits from a log of added items."""
    return sketches.replay_deltas(_customers(spark, sf_dir), "item", *sketches.read_meta(sketches.meta_bytes(*BLOOM, BASE)))


@query(f"SELECT bit FROM {_SET}")
def lsm_bloom_merge(spark, sf_dir):
    """Two halves of the customers, merged."""
    rows = _customers(spark, sf_dir)
    return sketches.merge_blooms(*[(_bits(rows.filter(F.col("c_custkey") % 2 == i)), *BLOOM, BASE) for i in (0, 1)])


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))


_HEX = "(SELECT doc_id AS path, hex(encode(text)) AS h FROM documents WHERE length(text) > 0)"
_BLOCKS = f"(SELECT path, n AS block_num, rpad(substr(h, (2 * {BLOCK} * n + 1)::BIGINT, {2 * BLOCK}), {2 * BLOCK}, '0') AS h FROM {_HEX}, range(0, 1 + (SELECT max(length(h)) FROM {_HEX}) // {2 * BLOCK}) t(n) WHERE 2 * {BLOCK} * n < length(h))"


@query(f"SELECT path, block_num, md5(h) AS digest FROM {_BLOCKS}")
def block_split(spark, sf_dir):
    """Digests of all texts' blocks."""
    return blocks.split(_files(spark, sf_dir), BLOCK).select("path", "block_num", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query(f"SELECT path, md5(string_agg(h, '' ORDER BY block_num)) AS digest FROM {_BLOCKS} GROUP BY path")
def block_join(spark, sf_dir):
    """Digests of texts put together from blocks."""
    return blocks.join(blocks.split(_files(spark, sf_dir), BLOCK)).select("path", F.md5(F.hex("content").cast("binary")).alias("digest"))


@query(f"SELECT path, substr(h, 33, 64) AS data FROM {_HEX} WHERE length(h) >= 96")
def block_read_at(spark, sf_dir):
    """Bytes 16 to 47 of every longer text."""
    rows = _files(spark, sf_dir).filter(F.octet_length("content") >= 48)
    return rows.select("path", F.hex(blocks.read_at(F.col("content"), 16, 32)).alias("data"))


@query(f"SELECT p AS path, row_number() OVER (PARTITION BY p ORDER BY path, block_num) - 1 AS block_num, md5(h) AS digest FROM (SELECT path % 10 AS p, * FROM {_BLOCKS})")
def block_append(spark, sf_dir):
    """Blocks of all texts appended to ten files."""
    cut = blocks.split(_files(spark, sf_dir), BLOCK)
    added = cut.select((F.col("path") % 10).alias("path"), F.struct("path", "block_num").alias("ord"), "data")
    none = spark.createDataFrame([], "path long, block_num long, data binary")
    return blocks.append(none, added, BLOCK).select("path", "block_num", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query(
    """WITH w AS (SELECT o_custkey % 50 AS path, o_orderkey % 23 AS n, arg_max(o_orderkey, o_orderkey) AS v FROM orders GROUP BY 1, 2),
e AS (SELECT path, max(n) AS last FROM w GROUP BY 1)
SELECT e.path, t.n AS block_num, CASE WHEN v IS NULL THEN '0000000000000000' ELSE printf('%016X', v) END AS data
FROM e, range(23) t(n) LEFT JOIN w ON w.path = e.path AND w.n = t.n WHERE t.n <= e.last"""
)
def block_upsert(spark, sf_dir):
    """Fifty files of blocks after all writes."""
    rows = table(spark, sf_dir, "orders")
    data = F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0"))
    writes = rows.select((F.col("o_custkey") % 50).alias("path"), (F.col("o_orderkey") % 23).alias("block_num"), data.alias("data"), F.col("o_orderkey").alias("seq"))
    none = spark.createDataFrame([], "path long, block_num long, data binary")
    return blocks.write(none, writes, 8).select("path", "block_num", F.hex("data").alias("data"))


@query(
    """WITH a AS (SELECT event_id AS seq, user_id % 37 AS n FROM events),
b AS (SELECT DISTINCT n AS block FROM a),
l AS (SELECT a.seq, a.n, b.block, max(CASE WHEN a.n = b.block THEN a.seq END) OVER (PARTITION BY b.block ORDER BY a.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a, b),
p AS (SELECT seq, n, max(CASE WHEN block = n THEN last END) OVER (PARTITION BY seq) AS before, last FROM l)
SELECT seq, n AS block_num, any_value(before) IS NOT NULL AND count(*) FILTER (WHERE last > before) < 8 AS hit FROM p GROUP BY seq, n"""
)
def lru_trace(spark, sf_dir):
    """All accesses; a block is held if fewer than 8 others were read since it was."""
    seen = table(spark, sf_dir, "events").select(F.lit("f").alias("path"), (F.col("user_id") % 37).alias("block_num"), F.lit(BLOCK).cast("long").alias("size"), F.col("event_id").alias("seq"))
    return blocks.cache_trace(seen, 8 * BLOCK).select("seq", "block_num", "hit")


@query(f"SELECT seq, key, CASE WHEN NOT tomb THEN value END AS value, CASE WHEN tomb THEN 'DELETE' ELSE 'PUT' END AS cmd FROM ({_OPS})")
def cli_parse(spark, sf_dir):
    """Commands made of the log, parsed."""
    log = event_log(spark, sf_dir)
    quoted = F.concat(F.lit('"'), F.replace(F.replace("value", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.when(F.col("tombstone"), F.concat(F.lit("delete( "), "key", F.lit(" )"))).otherwise(F.concat(F.lit(" put("), "key", F.lit(", "), quoted, F.lit(") ")))
    calls = commands.parse_lines(log.select("seq", line.alias("line")))
    return calls.select("seq", F.get("call.args", F.lit(0)).alias("key"), F.get("call.args", F.lit(1)).alias("value"), "call.cmd")


@query(
    f"""WITH o AS ({_OPS}), g AS (SELECT * FROM o WHERE kind = 'click'), p AS (SELECT * FROM o WHERE kind <> 'click')
SELECT g.seq AS line_no, CASE WHEN NOT p.tomb THEN p.seq::VARCHAR ELSE '(nil)' END AS output FROM g ASOF LEFT JOIN p ON g.key = p.key AND g.seq > p.seq
UNION ALL SELECT seq, 'OK' FROM p UNION ALL SELECT 0, 'unknown command' UNION ALL SELECT -1, 'parse error: expected format CMD(arg1,arg2,...)'"""
)
def cli_session(spark, sf_dir):
    """What a session of these commands prints."""
    log = event_log(spark, sf_dir)
    said = F.when(F.col("kind") == "click", F.concat(F.lit("GET("), "key", F.lit(")"))).when(F.col("tombstone"), F.concat(F.lit("DELETE("), "key", F.lit(")")))
    lines = log.select(F.col("seq").alias("line_no"), said.otherwise(F.concat(F.lit("PUT("), "key", F.lit(","), F.col("seq").cast("string"), F.lit(",1h)"))).alias("line"))
    more = spark.createDataFrame([(-2, "  "), (-1, "GET u1"), (0, "scan(u1)"), (1 << 40, "exit"), ((1 << 40) + 1, "GET(u1)")], "line_no long, line string")
    return session.session(lines.unionByName(more))


_TTLS = {"10s": 10**10, "5m": 3 * 10**11, "2h": 72 * 10**11, "1h30m": 54 * 10**11, "1.5s": 15 * 10**8, "-5s": -5 * 10**9, "0": 0, "250ms": 25 * 10**7, "3us": 3000, "7ns": 7, "10": None, "5x": None, "s": None, "": None}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if n is None else n}::BIGINT)" for t, n in _TTLS.items()) + ") t(ttl, ns)")
def ttl_parse(spark, sf_dir):
    """Durations."""
    return spark.createDataFrame([(t,) for t in _TTLS], "ttl string").select("ttl", commands.duration_ns(F.col("ttl")).alias("ns"))


@query(f"SELECT key, w.value AS value, w.seq AS seq, w.seq % 1000 + 1 AS expires_at FROM {_WON} WHERE NOT w.tomb AND w.seq % 2 = 0 AND w.seq % 1000 + 1 <= 500")
def ttl_expired_view(spark, sf_dir):
    """Keys whose time to live has run out."""
    log = event_log(spark, sf_dir).withColumn("expires_at", F.when((F.col("seq") % 2 == 0) & ~F.col("tombstone"), F.col("seq") % 1000 + 1).otherwise(0))
    return state.expired(log, 500)


_SETTINGS = [(5000, "rbtree", 1, 0, -1, 3), (8192, "skiplist", 4, 4, 8192, 0), (16384, "btree", 2, 1, 1, None), (None, "", -3, None, 0, 10)]
_NAMES = ("block_size", "memtable_type", "btree_degree", "memtable_instances", "cache_size", "memtable_max_entries")


@query(
    """SELECT i, CASE WHEN bs IN (4096, 8192, 16384) THEN bs ELSE 4096 END AS block_size, CASE WHEN mt IN ('hashmap', 'skiplist', 'btree') THEN mt ELSE 'hashmap' END AS memtable_type,
CASE WHEN bd >= 2 THEN bd ELSE 16 END AS btree_degree, CASE WHEN mi >= 1 THEN mi ELSE 1 END AS memtable_instances, CASE WHEN cs > 0 THEN cs ELSE 8192 END AS cache_size,
CASE WHEN me > 0 THEN me ELSE 1000 END AS memtable_max_entries FROM (VALUES """
    + ", ".join(f"({i}::BIGINT, {', '.join('NULL' if x is None else repr(x) + ('' if isinstance(x, str) else '::BIGINT') for x in r)})" for i, r in enumerate(_SETTINGS))
    + ") t(i, bs, mt, bd, mi, cs, me)"
)
def config_normalize(spark, sf_dir):
    """Settings with defaults for what is out of range."""
    kinds = "i long, " + ", ".join(f"{n} {'string' if n == 'memtable_type' else 'long'}" for n in _NAMES)
    return config.normalize(spark.createDataFrame([(i, *r) for i, r in enumerate(_SETTINGS)], kinds))


@query(f"SELECT key, w.value AS value, w.tomb AS tombstone, w.seq AS seq FROM {_WON}")
def stream_latest_state(spark, sf_dir):
    """The state of the log as a stream."""
    stored = table(spark, sf_dir, "events")
    events = spark.readStream.schema(stored.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    ops = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tombstone"), (F.col("event_id") + 1).alias("seq"))
    folder = new_folder(spark, "stream")
    run_available(ops, f"{folder}/state", f"{folder}/checkpoint")
    return read_state(spark, f"{folder}/state")


_JSON = [
    '{"data_dir": "d", "block_size": 8192, "memtable_type": "btree", "memtable_instances": 4, "btree_degree": 4, "cache_size": 100}',
    '{"block_size": 5000, "memtable_type": "rbtree", "memtable_instances": 0, "btree_degree": 1, "cache_size": -1, "memtable_max_entries": 3}',
    "{}",
    "{not json",
]


@query(
    """SELECT i, bad, CASE WHEN bs IN (4096, 8192, 16384) THEN bs ELSE 4096 END AS block_size, CASE WHEN mt IN ('hashmap', 'skiplist', 'btree') THEN mt ELSE 'hashmap' END AS memtable_type,
CASE WHEN bd >= 2 THEN bd ELSE 16 END AS btree_degree, CASE WHEN mi >= 1 THEN mi ELSE 1 END AS memtable_instances, CASE WHEN cs > 0 THEN cs ELSE 8192 END AS cache_size,
CASE WHEN me > 0 THEN me ELSE 1000 END AS memtable_max_entries, coalesce(dd, 'data') AS data_dir FROM (
SELECT i, NOT json_valid(j) AS bad, (g->>'block_size')::BIGINT AS bs, g->>'memtable_type' AS mt, (g->>'btree_degree')::BIGINT AS bd, (g->>'memtable_instances')::BIGINT AS mi,
(g->>'cache_size')::BIGINT AS cs, (g->>'memtable_max_entries')::BIGINT AS me, g->>'data_dir' AS dd FROM (SELECT i, j, CASE WHEN json_valid(j) THEN j::JSON ELSE '{}'::JSON END AS g FROM (VALUES """
    + ", ".join(f"({i}::BIGINT, '{j}')" for i, j in enumerate(_JSON))
    + ") t(i, j)))"
)
def config_load(spark, sf_dir):
    """Settings read from JSON texts; what is missing, out of range or damaged takes its default."""
    rows = config.load(spark.createDataFrame(list(enumerate(_JSON)), "i long, json string"))
    return rows.select("i", "bad", "data_dir", *_NAMES)


@query(f"SELECT key, seq, CASE WHEN seq % 2 = 0 AND NOT tomb THEN floor((epoch_us(ts) + ttl * 1000) / 1000000)::BIGINT ELSE 0 END AS expires_at FROM (SELECT 'u' || user_id AS key, event_id + 1 AS seq, event_type = 'error' AS tomb, ts, ((event_id + 1) % 7) * 1500 AS ttl FROM events)")
def put_expiry(spark, sf_dir):
    """Puts with a time to live: when each expires, in whole seconds."""
    rows = table(spark, sf_dir, "events")
    seq = F.col("event_id") + 1
    ttl = F.when((seq % 2 == 0) & (F.col("event_type") != "error"), commands.duration_ns(F.concat(((seq % 7) * 1500).cast("string"), F.lit("ms"))))
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), seq.alias("seq"), state.expiry(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))"), ttl).alias("expires_at"))
