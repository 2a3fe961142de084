"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a trigram binds
(multiplies) its letters' vectors, the first rotated twice and the second once;
a text bundles (adds) the vectors of all its trigrams. Prototypes bundle the unit
vectors of the learned texts of a language, and a text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold
from .textops import _stream, mix64, slices

DIMENSIONS = 1024
#: About so many learned texts of each language, chosen by the hash of their ids.
SAMPLE = 4000
#: Texts that a task works on at once, at most, each with a dense vector and counts.
ROWS = 512
#: Languages up to which their counts are broadcast; beyond, they are joined by shuffling.
BROADCAST_LANGUAGES = 100_000


def _letter_table() -> np.ndarray:
    """Lower-cased code point of every letter of the first plane; 0 for all else."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_tables: dict[str, np.ndarray] = {}


def _symbols(text: str) -> np.ndarray:
    """Letters as numbers with 0 for each run of anything else, and 0 at either end."""
    if "letters" not in _tables:
        _tables["letters"] = _letter_table()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(1, np.int64)
    high = codes >= 1 << 16
    out = _tables["letters"][np.where(high, 0, codes)]
    if high.any():
        there = np.flatnonzero(high)
        out[there] = [c if chr(c).isalpha() else 0 for c in codes[there].tolist()]
    out = np.concatenate([[0], out, [0]])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def _letter_vectors(symbols: np.ndarray, dim: int) -> np.ndarray:
    words = dim // 64
    seeds = _stream(words, 41)[None, :] ^ (symbols.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(mix64(mix64(seeds)).view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).reshape(len(symbols), dim)


def text_vectors(texts: list[str], dim: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and whether each has a letter; a text without has the zero vector."""
    parts = [_symbols(t) for t in texts]
    size = np.array([len(p) for p in parts])
    symbols, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
    has = np.bincount(owner[symbols != 0], minlength=len(parts)) > 0
    alphabet, s = np.unique(symbols, return_inverse=True)
    n = len(alphabet)
    whole = owner[:-2] == owner[2:] if len(owner) > 2 else np.zeros(0, bool)
    if not whole.any():
        return np.zeros((len(parts), dim), np.float32), has
    gram = ((s[:-2] * n + s[1:-1]) * n + s[2:])[whole]
    owner = owner[:-2][whole]
    if n**3 <= 1 << 23:
        there = np.flatnonzero(np.bincount(gram, minlength=n**3))
        number = np.zeros(n**3, np.int64)
        number[there] = np.arange(len(there))
        column = number[gram]
    else:
        there, column = np.unique(gram, return_inverse=True)
    base = _letter_vectors(alphabet, dim)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    out = np.zeros((len(parts), dim), np.float32)
    step = 4096
    order = np.argsort(column, kind="stable") if len(there) > step else None
    if order is not None:
        column, owner = column[order], owner[order]
    for a in range(0, len(there), step):
        b = min(a + step, len(there))
        lo, hi = (np.searchsorted(column, a), np.searchsorted(column, b)) if order is not None else (0, len(column))
        g = there[a:b]
        v = (twice[g // (n * n)] * once[g // n % n] * base[g % n]).astype(np.float32)
        counts = np.bincount(owner[lo:hi] * (b - a) + column[lo:hi] - a, minlength=len(parts) * (b - a))
        out += counts.reshape(len(parts), b - a).astype(np.float32) @ v
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, has


def _profiles(dim: int):
    """Per task: the sum of unit vectors and the number of texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 19, ROWS):
                v, has = text_vectors([t or "" for t in part.column("text").to_pylist()], dim)
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    if has[i]:
                        sums[lang] = sums.get(lang, 0.0) + v[i].astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    return run


def prototypes(docs: DataFrame, allowed, dim: int = DIMENSIONS, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Learned languages, and the unit prototype of each.

    Only per-language sums come back: one row per language, dimension by
    dimension summed by Spark.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("c"))
    known = sizes.limit(BROADCAST_LANGUAGES + 1).collect()
    if len(known) <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in known], "lang string, c long"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < F.lit(1_000_000.0) * sample / F.col("c")
    few = rows.join(sizes, "lang").filter(share).select("lang", "text")
    sums = few.mapInArrow(_profiles(dim), "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    got = sorted(sums.collect(), key=lambda r: r.lang)
    langs = [r.lang for r in got]
    p = np.array([[x.x for x in r.v] for r in got], np.float64).reshape(len(langs), dim)
    return langs, (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _predicted(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 19, ROWS):
                v, has = text_vectors([t or "" for t in part.column("text").to_pylist()], dim)
                if langs:
                    cosine = v @ p.T
                    best = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(v)), best].astype(np.float64), 0.0, 1.0)
                else:
                    has, best, score = np.zeros(len(v), bool), np.zeros(len(v), int), np.zeros(len(v))
                names = [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def language(docs: DataFrame, folds: int = 5, held: int = 0, dim: int = DIMENSIONS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Learned from about ``sample`` texts of each non-null language outside the
    held-out fold, all of them if there are fewer. Null texts and texts without
    a letter get ``und`` and score 0, and so does everything if no language was
    learned. A null id counts as held out; repeated rows each come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prototypes(docs, fold("doc_id", folds) != held, dim, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predicted(shared, dim), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
