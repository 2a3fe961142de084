"""Quality by votes of the nearest labelled texts in a latent-semantic space.

A text becomes counts of hashed words, of hashed trigrams of character classes,
of word lengths and of words that repeat one just before; the shares of these
features, square rooted and weighted by rarity, are projected to the leading singular vectors of
a bounded labelled sample. The labelled vectors, also bounded, are broadcast;
every document's cosine with all of them is computed exactly, in blocks, and its
NEIGHBOURS nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold, labelled_sample, labelled_texts
from .textops import _stream, hash_words, slices, text_bytes

#: Bound of the labelled rows that the space and the voters come from.
SAMPLE = 4096
RANK = 48
NEIGHBOURS = 7
GRAMS = 1024
LENGTHS = 24
REPEATS = 4
WORDS = 512
WIDTH = GRAMS + LENGTHS + REPEATS + WORDS
#: What all words weigh against all trigrams.
WORD_SHARE = 0.1
#: Texts that a task works on at once, at most.
ROWS = 4096


def _classes() -> np.ndarray:
    """Byte classes: capital, small, digit, beyond ASCII, newline, blank, and each sign its own."""
    out = np.full(256, 3, np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() else 4 if c == "\n" else 5 if b <= 32 else 6 + b % 32
    return out


_CLASS = _classes()
_N = 38
_SLOT = (_stream(_N**3, 31) % np.uint64(GRAMS)).astype(np.int64)


def feature_counts(column: pa.Array) -> np.ndarray:
    """Counts of the WIDTH features for every text."""
    data, offsets = text_bytes(column)
    docs = len(offsets) - 1
    out = np.zeros((docs, WIDTH), np.float32)
    if len(data):
        owner = np.repeat(np.arange(docs), np.diff(offsets))
        c = _CLASS[data]
        gram = _SLOT[(c[:-2] * _N + c[1:-1]) * _N + c[2:]] if len(c) > 2 else np.zeros(0, np.int64)
        same = owner[:-2] == owner[2:] if len(c) > 2 else np.zeros(0, bool)
        where = owner[: len(gram)][same] * GRAMS + gram[same]
        out[:, :GRAMS] = np.bincount(where, minlength=docs * GRAMS).reshape(docs, GRAMS)
    w = hash_words(data, offsets)
    length = np.minimum(w.end - w.start, LENGTHS) - 1
    out[:, GRAMS : GRAMS + LENGTHS] = np.bincount(w.doc * LENGTHS + length, minlength=docs * LENGTHS).reshape(docs, LENGTHS)
    for back in range(1, REPEATS + 1):
        again = (w.hash[back:] == w.hash[:-back]) & (w.doc[back:] == w.doc[:-back])
        out[:, GRAMS + LENGTHS + back - 1] = np.bincount(w.doc[back:][again], minlength=docs)
    word = (w.hash % np.uint64(WORDS)).astype(np.int64)
    out[:, -WORDS:] = np.bincount(w.doc * WORDS + word, minlength=docs * WORDS).reshape(docs, WORDS)
    return out


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of the shares, the word features apart from the trigrams, times rarity."""
    x = counts.copy()
    words = np.maximum(counts[:, GRAMS : GRAMS + LENGTHS].sum(axis=1, keepdims=True), 1)
    x[:, :GRAMS] /= np.maximum(counts[:, :GRAMS].sum(axis=1, keepdims=True), 1)
    x[:, GRAMS:] /= words
    x[:, -WORDS:] *= WORD_SHARE
    return np.sqrt(x) * idf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _binary_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", rows=ROWS):
            rows = [r.tobytes() for r in feature_counts(part.column("text")).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column("label").cast(pa.int32())], ["counts", "label"])


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """The space and the voters from a bounded labelled sample (doc_id, label)."""
    rows = labelled_texts(docs, sample).mapInArrow(_binary_counts, "counts binary, label int").collect()
    rows.sort(key=lambda r: (bytes(r.counts), r.label))
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.float32).reshape(-1, WIDTH)
    labels = np.array([r.label > 0 for r in rows], np.float32)
    idf = (np.log((len(rows) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.5).astype(np.float32)
    x = _unit(_weighted(counts, idf))
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), labels)


def votes(column: pa.Array, m: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The weighted share of label 1 among the nearest voters of every text."""
    if not len(m.labels):
        return np.full(len(column), 0.5)
    v = _unit(_weighted(feature_counts(column), m.idf) @ m.axes)
    out = np.empty(len(v))
    k = min(neighbours, len(m.labels))
    for a in range(0, len(v), 256):
        s = v[a : a + 256] @ m.voters.T
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(s, at, axis=1).astype(np.float64), 1e-6)
        out[a : a + 256] = (w * m.labels[at]).sum(axis=1) / w.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(votes(part.column("text"), m))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Voters are at most ``sample`` labelled rows outside the held-out fold.
    Empty and null texts are scored like any other, by their empty features.
    Null ids are scored and never learned from; repeated rows each come back.
    Without any label every score is 0.5.
    """
    spark = docs.sparkSession
    chosen = labelled_sample(labels, "quality", fold("doc_id", folds) != held, sample)
    shared = spark.sparkContext.broadcast(tuple(fit(docs, chosen)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(shared), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _kept(shared, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text", rows=ROWS):
                yield part.filter(pa.array(votes(part.column("text"), m) >= cut))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, all columns unchanged; one scan, no shuffle."""
    chosen = labelled_sample(labels, "quality", F.lit(True), sample)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(fit(docs, chosen)))
    return docs.mapInArrow(_kept(shared, cut), docs.schema)
