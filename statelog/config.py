"""Settings, their defaults and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, defaults and allowed values of the settings.
SCHEMA = (
    "data_dir string, block_size long, cache_size long, memtable_max_entries long, memtable_max_bytes long, "
    "wal_segment_max_records long, multi_file_sstable boolean, memtable_type string, memtable_instances long, btree_degree long"
)
DEFAULTS = {
    "data_dir": "data",
    "block_size": 4096,
    "cache_size": 8192,
    "memtable_max_entries": 1000,
    "memtable_max_bytes": 1024,
    "wal_segment_max_records": 1000,
    "multi_file_sstable": True,
    "memtable_type": "hashmap",
    "memtable_instances": 1,
    "btree_degree": 16,
}
BLOCK_SIZES = (4096, 8192, 16384)
MEMTABLE_TYPES = ("hashmap", "skiplist", "btree")
# End of fixed values.

_VALID = {
    "block_size": lambda c: c.isin(*BLOCK_SIZES),
    "memtable_type": lambda c: c.isin(*MEMTABLE_TYPES),
    "btree_degree": lambda c: c >= 2,
    "memtable_instances": lambda c: c >= 1,
    **{k: (lambda c: c > 0) for k in ("cache_size", "memtable_max_entries", "memtable_max_bytes", "wal_segment_max_records")},
}


def setting(name: str) -> Column:
    """The setting's column if it is valid, else its default; null counts as not given."""
    c, default = F.col(name), F.lit(DEFAULTS[name])
    good = _VALID[name](c) if name in _VALID else c.isNotNull()
    return F.when(good, c).otherwise(default).alias(name)


def normalize(settings: DataFrame) -> DataFrame:
    """A table of settings, one set per row, with other columns kept."""
    return settings.select(*[setting(c) if c in DEFAULTS else F.col(c) for c in settings.columns])


def load(texts: DataFrame, column: str = "json") -> DataFrame:
    """Settings from JSON texts; a text that doesn't parse gives the defaults and ``bad`` true."""
    read = F.from_json(column, SCHEMA)
    rows = texts.select("*", read.alias("c"), F.expr(f"try_parse_json({column}) IS NULL").alias("bad"))
    return normalize(rows.select(*texts.columns, "bad", *[F.col(f"c.{n}").alias(n) for n in DEFAULTS]))
