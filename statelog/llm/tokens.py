"""Token counts from an exact histogram of encoded lengths.

Every document is encoded whole with a public tokenizer; only the lengths leave
the scan, summed per length before they are shuffled. Suffix sums over the
distinct lengths then answer, for every context limit, how many documents and
tokens reach it and how many tokens stay if texts are cut there, and quantiles.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vocabulary file of ranks, on every executor, and the split pattern that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN = 4096

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a file of base64 pieces and ranks, loaded once per process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encodings[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def _worker_encoding(path: str, pattern: str):
    """As ``encoding``, kept on the library's module, which outlives a task's own functions."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_statelog_kept", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = encoding(path, pattern)
    return kept[path, pattern]


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker_encoding(path, pattern)
        for batch in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "n_tokens", pa.array(n, pa.int64()))

    return run


def token_lengths(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every row: tokens of its whole text, 0 for a null or empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_lengths(path, pattern), "doc_id long, n_tokens long")


def _counted(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = _worker_encoding(path, pattern), Counter()
        for batch in batches:
            seen.update(len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(path, pattern), "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of that length, of at least L, and kept if cut at L.

    Columns: n_tokens, n_docs, docs_from, tokens_from, tokens_cut, rank_below
    (documents that are shorter) and share_upto (the quantile that L answers).
    Sums run within spans of SPAN lengths and then over spans, so that no task
    gets more than SPAN lengths of documents. Of an empty table: no rows.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / SPAN).alias("span"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("sd"), F.sum("tokens").alias("st"))
    down = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    total = Window.partitionBy()
    spans = spans.select(
        "span",
        zero(F.sum("sd").over(down)).alias("ad"),
        zero(F.sum("st").over(down)).alias("at"),
        F.sum("sd").over(total).alias("all_docs"),
        F.sum("st").over(total).alias("all_tokens"),
    )
    within = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = h.join(spans, "span").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens", (F.sum("n_docs").over(within) + F.col("ad")).alias("docs_from"), (F.sum("tokens").over(within) + F.col("at")).alias("tokens_from")
    )
    below = F.col("all_docs") - F.col("docs_from")
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("tokens_cut"),
        below.alias("rank_below"),
        ((below + F.col("n_docs")) / F.col("all_docs")).alias("share_upto"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column | int:
    """Tokens that stay if every text is cut at ``limit``, which needn't be a length that occurs."""
    at = sums.filter(F.col("n_tokens") >= limit).agg(F.max("docs_from").alias("d"), F.max("tokens_from").alias("t")).first()
    everything = sums.agg(F.max("tokens_from").alias("t")).first()["t"] or 0
    return everything - (at["t"] or 0) + limit * (at["d"] or 0)


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents don't exceed; None of no documents."""
    return sums.filter(F.col("share_upto") >= share).agg(F.min("n_tokens")).first()[0]
