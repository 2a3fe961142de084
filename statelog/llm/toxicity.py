"""Toxic passages by maximum-scoring segments of token log-odds.

Model. A token's evidence is found along a chain of ever more specific features:
the word's prefixes of PREFIXES bytes, the word, and the word after the one
before it. Each feature has a Dirichlet prior of STRENGTH pseudo-counts, shared
between toxic and other texts as the feature before it in the chain is; so a
feature of few texts stays near its parent's odds and no threshold is needed.
Counts are numbers of labelled texts, in which near copies of one text count as
one text together. A token's log-odds are those of its last feature that was
counted, against the odds of all texts, less DRIFT.

Scoring. One linear scan over a text finds all maximal segments of positive sum.
Under texts that are not toxic the greatest segment of n tokens is above s with
probability 1 - exp(-K n exp(-lambda s)); lambda and K are fitted by maximum
likelihood. A segment's expected number E = K n exp(-lambda s) makes it
significant below 1, and a text's evidence is the sum of log(1 + 1 / E) over its
segments. A logistic curve turns that into a score between 0 and 1.

Fitting. The labelled sample is halved, near copies on one side, and either half
is scored by the counts of the other; lambda, K and the curve are fitted to
these scores, never to texts that were counted. The final model counts both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import fold, labelled, labelled_texts
from .staging import Stage
from .textops import PUNCTUATION, SEPARATORS, Words, hash_ngrams, hash_words, mix64, slices, text_bytes

#: Bounds of the labelled rows that the model is fitted on: in all, and of toxic ones.
SAMPLE = 12_000
TOXIC_SAMPLE = 3_000
PREFIXES = (4, 5, 6, 7, 8)
STRENGTH = 10.0
DRIFT = 1.0
#: A text counts as one over the number of its near copies, in these units, so that sums are exact.
UNIT = 1 << 20
#: Word pairs that only one text holds are not counted: with this prior they can't matter.
LEAST_PAIR = 2 * UNIT

_U = np.uint64
_BETWEEN = PUNCTUATION.copy()
_BETWEEN[list(SEPARATORS)] = True
_BETWEEN[: ord(" ") + 1] = True
_WORD, _PAIR = len(PREFIXES), len(PREFIXES) + 1


def words_of(column: pa.Array) -> Words:
    """Runs of letters and digits in lower case, with the hashes of their prefixes.

    Characters of U+0080 to U+00BF and U+2000 to U+2FFF (spaces, quotes, dashes,
    signs) separate words as ASCII punctuation does.
    """
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    odd = np.flatnonzero((data == 0xC2) | (data == 0xE2))
    if len(odd):
        data = data.copy()
        data[odd + 1] = np.where(data[odd] == 0xE2, data[odd + 1], 0x20)
        wide = odd[data[odd] == 0xE2]
        data[wide + 1] = data[wide + 2] = 0x20
        data[odd] = 0x20
    return hash_words(data, offsets, sep=_BETWEEN, prefixes=PREFIXES)


def pairs_of(words: Words) -> np.ndarray:
    """The hash of each word together with the one before it; 0 at a text's first word."""
    out = np.zeros(len(words.hash), _U)
    if len(out) > 1:
        same = words.doc[1:] == words.doc[:-1]
        out[1:][same] = mix64(words.hash[:-1] * _U(0x9FB21C651E98DF25) + words.hash[1:])[same]
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last position, score) of one text, in linear time."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    first, end = edge[::2], edge[1::2]
    out: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum up to its end
    for new in zip(first.tolist(), end.tolist(), total[first].tolist(), total[end].tolist(), strict=True):
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                break
            new = (out[j][0], new[1], out[j][2], new[3])
            del out[j:]
        out.append(new)
    return [(a, b - 1, r - l) for a, b, l, r in out]


class Weights(NamedTuple):
    """Log-odds of each level's features, by their ascending hashes."""

    keys: list[np.ndarray]
    odds: list[np.ndarray]


class Model(NamedTuple):
    keys: list[np.ndarray]
    odds: list[np.ndarray]
    lam: float
    k: float
    slope: float
    bias: float


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` are in ``keys``, and whether they are."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def token_scores(words: Words, model: Weights | Model) -> np.ndarray:
    """Log-odds of every token less the drift."""
    _, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    odds = np.zeros(len(at))
    for level in range(_PAIR):
        wanted = words.hash[at] if level == _WORD else words.prefix[level][at]
        where, found = _find(model.keys[level], wanted)
        odds[found] = model.odds[level][where[found]]
    out = odds[back]
    where, found = _find(model.keys[_PAIR], pairs_of(words))
    out[found] = model.odds[_PAIR][where[found]]
    return out - DRIFT


def segments_of(column: pa.Array, model: Weights | Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Number of tokens, and the maximal segments, of every text."""
    words = words_of(column)
    scores = token_scores(words, model)
    ends = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
    return np.diff(ends), [maximal_segments(scores[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def evidence(n: int, segments: list[tuple[int, int, float]], lam: float, k: float) -> float:
    """The sum of log(1 + 1 / E) over the segments of a text of n tokens."""
    floor = math.log(max(k * n, 1e-300)) if n else 0.0
    return float(np.logaddexp(0.0, lam * np.array([s for _, _, s in segments]) - floor).sum()) if segments else 0.0


def shares(parent: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Expected toxic shares of features under a Dirichlet prior at their parents' shares."""
    return (toxic + STRENGTH * parent) / (count + STRENGTH)


def weigh(level: np.ndarray, key: np.ndarray, parent: np.ndarray, other: np.ndarray, toxic: np.ndarray, rate: float) -> Weights:
    """Log-odds of all features from their counts, level by level."""
    keys, found, odds = [], [], []
    base = math.log(rate / (1 - rate))
    for at in range(_PAIR + 1):
        rows = np.flatnonzero((level == at) & (other + toxic > 0))
        rows = rows[np.argsort(key[rows], kind="stable")]
        prior = np.full(len(rows), rate)
        for above in range(at):  # a parent is of the nearest level above that the word is long enough for
            where, has = _find(keys[above], parent[rows])
            prior[has] = found[above][where[has]]
        share = shares(prior, (other + toxic)[rows], toxic[rows])
        keys.append(key[rows])
        found.append(share)
        odds.append((np.log(share / (1 - share)) - base).astype(np.float32))
    return Weights(keys, odds)


def fit_tail(n: np.ndarray, s: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood lambda and K of the greatest segments s of texts of n tokens.

    Texts without a segment say nothing about the tail, and the highest hundredth,
    where mislabelled texts would be, is left out.
    """
    hit = s > 0
    if hit.sum() < 20:
        return 1.0, max(float(hit.sum()), 1.0) / max(float(n.sum()), 1.0)
    hit &= s <= np.quantile(s[hit], 0.99)
    n, s = n[hit], s[hit]
    low, high = 1e-3, 50.0
    for _ in range(60):
        lam = math.sqrt(low * high)
        w = n * np.exp(-lam * (s - s.min()))
        if 1 / lam - s.mean() + (w * s).sum() / w.sum() > 0:
            low = lam
        else:
            high = lam
    return lam, max(float(len(s) / (n * np.exp(-lam * s)).sum()), 1e-12)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, with a weak ridge so that separable data stay finite."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the least hash of their five-word shingles, which near copies nearly always share."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"))
            grams, owner, _ = hash_ngrams(words, 5)
            least = np.zeros(words.n_docs, _U)
            if len(owner):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                least[owner[first]] = np.minimum.reduceat(grams, first)
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("label").cast(pa.int32()), pa.array(least.view(np.int64))], ["text", "label", "copies"])


_FEATURE = "level int, feature long, parent long, half int, other long, toxic long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of every text, once each, with the text's weight; summed within a slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = words_of(part.column("text"))
            nearest = np.zeros(len(words.hash), _U)
            chain = []
            for at, row in enumerate([*words.prefix, words.hash, pairs_of(words)]):
                has = row != 0
                chain.append((np.full(has.sum(), at, np.int32), row[has], (words.hash if at == _PAIR else nearest)[has], words.doc[has]))
                nearest = np.where(has, row, nearest)
            level, key, parent, doc = (np.concatenate(x) for x in zip(*chain, strict=True))
            order = np.lexsort((doc, key))
            level, key, parent, doc = level[order], key[order], parent[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            level, key, parent, doc = level[new], key[new], parent[new], doc[new]
            weight, toxic, half = (np.array(part.column(c).to_numpy(zero_copy_only=False)) for c in ("weight", "label", "half"))
            # Texts of either half and label are summed apart.
            for side in (0, 1):
                mine = half[doc] == side
                k, d = key[mine], doc[mine]
                if not len(k):
                    continue
                at = np.flatnonzero(np.diff(k, prepend=~k[0]))
                w, one = weight[d], toxic[d] > 0
                cols = [level[mine][at], k[at].view(np.int64), parent[mine][at].view(np.int64), np.full(len(at), side, np.int32), np.add.reduceat(np.where(one, 0, w), at), np.add.reduceat(np.where(one, w, 0), at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["level", "feature", "parent", "half", "other", "toxic"])


def _sampled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [Weights(*w) for w in shared.value]
        for batch in batches:
            for part in slices(batch, "text"):
                half = part.column("half").to_numpy()
                n, found = np.zeros(len(half), np.int64), [[] for _ in half]
                for side in (0, 1):
                    at = np.flatnonzero(half == side)
                    if len(at):
                        n[at], got = segments_of(part.column("text").take(pa.array(at)), halves[1 - side])
                        for i, x in zip(at, got, strict=True):
                            found[i] = [s for _, _, s in x]
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(found, pa.list_(pa.float64())), part.column("label"), part.column("weight")], ["n", "scores", "label", "weight"])

    return run


_NO_EVIDENCE = Model([np.zeros(0, _U)] * (_PAIR + 1), [np.zeros(0, np.float32)] * (_PAIR + 1), 1.0, 1e-12, 0.0, -30.0)


def _chosen(labels: DataFrame, allowed, sample: int) -> tuple[DataFrame, np.ndarray]:
    """A bounded sample of the labelled ids, and how many there are of either label."""
    rows = labelled(labels, "toxic", allowed).withColumn("label", (F.col("label") > 0).cast("int"))
    totals = {r["label"]: r["c"] for r in rows.groupBy("label").agg(F.count("*").alias("c")).collect()}
    few = min(totals.get(1, 0), max(TOXIC_SAMPLE * sample // SAMPLE, 1))
    by_hash = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    parts = [rows.filter(F.col("label") == v).orderBy(*by_hash).limit(most) for v, most in ((1, few), (0, sample - few))]
    return parts[0].unionByName(parts[1]), np.array([totals.get(0, 0), totals.get(1, 0)], float)


def fit(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of the labels (doc_id, toxic) that may be learned from."""
    spark = docs.sparkSession
    stage = Stage(spark, "toxicity")
    chosen, totals = _chosen(labels, allowed, sample)
    texts = stage.write(labelled_texts(docs, chosen).mapInArrow(_grouped, "text string, label int, copies long"))
    size = texts.groupBy("copies").agg(F.count("*").alias("size"))
    texts = stage.write(texts.join(F.broadcast(size), "copies").select("text", "label", F.pmod(F.xxhash64("copies"), F.lit(2)).cast("int").alias("half"), (F.lit(UNIT) / F.col("size")).cast("long").alias("weight")))
    sums = {(r["half"], r["label"]): r["w"] for r in texts.groupBy("half", "label").agg(F.sum("weight").alias("w")).collect()}
    rate = [[float(sums.get((h, v), 0)) for v in (0, 1)] for h in (0, 1)]
    if any(sum(r[v] for r in rate) == 0 for v in (0, 1)):
        return _NO_EVIDENCE
    counts = texts.mapInArrow(_counted, _FEATURE).groupBy("level", "feature").agg(F.min("parent").alias("parent"), *(F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("other", "toxic")))
    counts = counts.filter((F.col("level") < _PAIR) | (F.col("other0") + F.col("toxic0") + F.col("other1") + F.col("toxic1") >= LEAST_PAIR)).toArrow()
    level, (key, parent) = counts["level"].to_numpy(), (counts[c].to_numpy().view(_U) for c in ("feature", "parent"))
    half = [[counts[f"{c}{h}"].to_numpy() / UNIT for c in ("other", "toxic")] for h in (0, 1)]
    del counts
    both = sum(rate[0]) + sum(rate[1])
    toxic = (rate[0][1] + rate[1][1]) / both
    sides = [weigh(level, key, parent, *half[h], toxic) for h in (0, 1)]
    shared = spark.sparkContext.broadcast([tuple(w) for w in sides])
    rows = texts.mapInArrow(_sampled(shared), "n long, scores array<double>, label int, weight long").collect()
    shared.destroy()
    size, label, weight = np.array([r.n for r in rows], float), np.array([float(r.label > 0) for r in rows]), np.array([r.weight / UNIT for r in rows])
    top = np.array([max(r.scores, default=0.0) for r in rows])
    lam, k = fit_tail(size[label == 0], top[label == 0])
    x = np.log1p([evidence(r.n, [(0, 0, s) for s in r.scores], lam, k) for r in rows])
    # The sample holds more toxic texts than their share of all labelled ones.
    for v in (0, 1):
        weight[label == v] *= totals[v] / totals.sum() / weight[label == v].sum() * len(rows)
    final = weigh(level, key, parent, half[0][0] + half[1][0], half[0][1] + half[1][1], toxic)
    stage.clear()
    return Model(final.keys, final.odds, lam, k, *fit_logistic(x, label, weight))


def _scored(shared):
    item = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                size, found = segments_of(part.column("text"), m)
                x = np.log1p([evidence(n, s, m.lam, m.k) for n, s in zip(size.tolist(), found, strict=True)])
                scores = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30)))
                spans = [[{"first": a, "last": b, "score": s} for a, b, s in got if m.lam * s > math.log(max(m.k * n, 1e-300))] for n, got in zip(size.tolist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(item))], ["doc_id", "score", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row of ``docs``.

    ``passages`` are the significant segments as first and last word number and
    score. Labels are learned from at most ``sample`` labelled rows outside the
    held-out fold, at most a quarter of them toxic. Null and empty texts get the
    score of no evidence. Null ids are scored and never learned from; repeated
    rows each come back. Without labels of both kinds every score is near 0.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, fold("doc_id", folds) != held, sample)
    shared = spark.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(shared), "doc_id long, score double, passages array<struct<first:long,last:long,score:double>>")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "passages")
