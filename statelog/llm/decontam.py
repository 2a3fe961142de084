"""Benchmark decontamination: n-gram seeds, then local alignment.

The n-grams of the test items are looked up in every document. Every gram that a
document shares with an item seeds a comparison, however many documents have it,
so that an edited copy with GRAM words in a row left as they were is compared.
Around the seeds of an item a document's words are aligned with the item's by
the Smith-Waterman recurrence over word hashes, which scores edited copies; the
score is the share of what the whole item would get. Where too few of the item's
words are near the seeds for that score, the alignment is left out. Words are
compared in lower case and without ASCII punctuation, which edited copies often
change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage
from .textops import PUNCTUATION, Words, hash_ngrams, hash_words, slices, text_bytes

GRAM = 4
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
LEAST_WORDS = 8
#: Items are broadcast in parts of about so many bytes of text, each with a scan of its own.
PART_BYTES = 32 << 20
_FILTER_BITS = 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: (score, first, end) with the range in ``text``.

    One row of the matrix per item word; a row's own gaps are a running maximum.
    """
    m = len(text)
    j = np.arange(m + 1)
    h, start = np.zeros(m + 1, np.int64), j.copy()
    best = (0, 0, 0)
    for word in item:
        t = np.zeros(m + 1, np.int64)
        s = j.copy()
        diag = h[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = h[1:] + GAP
        take = diag >= up
        t[1:] = np.where(take, diag, up)
        s[1:] = np.where(take, start[:-1], start[1:])
        dead = t <= 0
        t[dead], s[dead] = 0, j[dead]
        lifted = t - GAP * j
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, j, 0))
        left = top + GAP * j
        better = left > t
        s = np.where(better, s[source], s)
        t = np.where(better, left, t)
        h, start = t, s
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(start[k]), k)
    return best


def _words(texts: list[str | None]) -> tuple[Words, np.ndarray]:
    """Words, and each text's first word number and the end."""
    w = hash_words(*text_bytes(pa.array([t or "" for t in texts], pa.string())), sep=PUNCTUATION)
    return w, np.searchsorted(w.doc, np.arange(len(texts) + 1))


def item_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item's number, first word within it) of every gram of the items."""
    w, first = _words(texts)
    grams, owner, at = hash_ngrams(w, GRAM, short=False)
    return grams, owner, at - first[owner]


def _hits(shared):
    """Documents with any gram of an item: their gram hashes that are an item's, and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        mask = np.uint64((1 << _FILTER_BITS) - 1)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[wanted & mask] = True
        for batch in batches:
            for part in slices(batch, "text"):
                w = hash_words(*text_bytes(part.column("text")), sep=PUNCTUATION)
                grams, owner, at = hash_ngrams(w, GRAM, short=False)
                keep = np.flatnonzero(maybe[grams & mask])
                where = np.searchsorted(wanted, grams[keep])
                where[where == len(wanted)] = 0
                keep = keep[wanted[where] == grams[keep]] if len(wanted) else keep[:0]
                docs = np.unique(owner[keep])
                first = np.searchsorted(w.doc, np.arange(w.n_docs))
                ends = np.searchsorted(owner[keep], docs, "right")
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int64)))
                few = part.take(pa.array(docs))
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id"), few.column("text"), lists(grams[keep].view(np.int64)), lists(at[keep] - first[owner[keep]])], ["doc_id", "text", "grams", "at"]
                )

    return run


def promising(item: np.ndarray, text: np.ndarray, least: float) -> bool:
    """Whether an alignment of ``least`` of the item's score can lie in ``text``: a bound that loses none.

    Such an alignment matches that share of the item's words, each with a word
    of its own of the text, and spans at most (3 - 2 * least) words for each of
    the item's.
    """
    need = least * len(item)
    if np.isin(item, text).sum() < need:
        return False
    inside = np.concatenate([[0], np.cumsum(np.isin(text, item))])
    span = min(len(text), int(np.ceil((3 - 2 * least) * len(item))))
    return bool((inside[span:] - inside[: len(inside) - span]).max() >= need)


def _aligned(shared, least: float, least_words: int):
    kinds = ["doc_id", "item_id", "score", "matched", "first_word", "end_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, starts, known, owners, own_grams, own_starts = shared.value
        sizes = np.diff(starts)
        for batch in batches:
            out: list[tuple] = []
            w, first = _words(batch.column("text").to_pylist())
            for i, (doc, grams, at) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("grams").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                text = w.hash[first[i] : first[i + 1]]
                grams, at = np.array(grams, np.int64).view(np.uint64), np.array(at, np.int64)
                had = np.unique(grams)
                among = [owners[a:b] for a, b in zip(np.searchsorted(known, had), np.searchsorted(known, had, "right"), strict=True)]
                for item in np.unique(np.concatenate(among)).tolist():
                    where = np.sort(at[np.isin(grams, own_grams[own_starts[item] : own_starts[item + 1]])])
                    size, best, words = int(sizes[item]), (0, 0, 0), hashes[starts[item] : starts[item + 1]]
                    for some in np.split(where, np.flatnonzero(np.diff(where) > 2 * size) + 1):
                        lo, hi = max(0, int(some[0]) - 2 * size), min(len(text), int(some[-1]) + 2 * size)
                        if not promising(words, text[lo:hi], least):
                            continue
                        got = align(words, text[lo:hi])
                        if got[0] > best[0]:
                            best = (got[0], got[1] + lo, got[2] + lo)
                    matched = int(np.isin(text[best[1] : best[2]], words).sum())
                    if best[0] >= least * MATCH * size and matched >= min(least_words, size):
                        out.append((doc, ids[item], best[0] / (MATCH * size), matched, best[1], best[2]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], kinds)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, score, matched, first_word, end_word): documents that hold a test item.

    ``score`` is the alignment's share of the whole item's score, ``matched``
    the words of the item's in the range of the document's words (runs of
    letters, digits and characters beyond ASCII). Items of fewer
    than GRAM words never match; null and empty texts have no words. Null ids
    stay null; repeated rows each come back.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "decontamination")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for known, items in _shared_parts(spark, benchmark):
        hits = stage.write(rows.mapInArrow(_hits(known), "doc_id long, text string, grams array<long>, at array<long>"), "hits")
        found = hits.mapInArrow(_aligned(items, least, least_words), "doc_id long, item_id long, score double, matched long, first_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def _shared_parts(spark: SparkSession, benchmark: DataFrame) -> Iterator[tuple[Broadcast, Broadcast]]:
    """For each part of the items: the hashes of its grams, and what its alignments need."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    for p in range(parts):
        few = sorted((r.item_id if r.item_id is not None else -1, r.text, r.item_id) for r in items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == p).collect())
        texts = [t for _, t, _ in few]
        grams, owner, _ = item_grams(texts)
        w, first = _words(texts)
        order = np.argsort(grams, kind="stable")
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        yield spark.sparkContext.broadcast(np.unique(grams)), spark.sparkContext.broadcast(([i for _, _, i in few], w.hash, first, grams[order], owner[order], grams, bounds))


def _cleaned(known: Broadcast, items: Broadcast, least: float, least_words: int, column: str):
    """The rows, less ``column``, whose text there holds no item."""
    hits, aligned = _hits(known), _aligned(items, least, least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                numbers = pa.array(np.arange(part.num_rows))
                found = aligned(hits([pa.RecordBatch.from_arrays([numbers, part.column(column)], ["doc_id", "text"])]))
                keep = np.ones(part.num_rows, bool)
                for got in found:
                    keep[got.column("doc_id").to_numpy()] = False
                yield part.drop_columns([column]).filter(pa.array(keep))

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that ``contaminated`` doesn't name, all columns unchanged, whatever their ids.

    One scan for each part of the items, no shuffle.
    """
    column = "lower"
    while column in docs.columns:
        column += "_"
    schema = docs.schema
    for known, items in _shared_parts(docs.sparkSession, benchmark):
        docs = docs.withColumn(column, F.lower(F.col("text").cast("string"))).mapInArrow(_cleaned(known, items, least, least_words, column), schema)
    return docs
