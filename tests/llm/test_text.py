"""Hashing, deduplication and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelog.llm import decontam, minhash, textops
from statelog.llm.decontam import contaminated, uncontaminated
from statelog.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = WORD.findall(lowered(text))
    return ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set()


@given(st.lists(st.text(alphabet=st.sampled_from(list("abAB \t\n\x0b\x0c\ré中\x85 ")), max_size=60), max_size=6), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_words_and_grams(texts, n):
    data, offsets = textops.text_bytes(pa.array(texts, pa.string()))
    w = textops.hash_words(data, offsets)
    found = [[bytes(data[a:b]).decode() for d, a, b in zip(w.doc, w.start, w.end, strict=True) if d == i] for i in range(len(texts))]
    assert found == [WORD.findall(t) for t in texts]
    sets, at = minhash.shingle_sets(pa.array(texts, pa.string()), n)
    assert np.diff(at).tolist() == [len(shingles(t, n)) for t in texts]


@pytest.mark.parametrize("piece", [3, 7, 64])
def test_pieces_do_not_matter(monkeypatch, piece):
    texts = ["", "abcdefghijklm no p", " x ", "qrstuvwxyz" * 5, "a b c d e f g"]
    whole = textops.hash_words(*textops.text_bytes(pa.array(texts)))
    monkeypatch.setattr(textops, "PIECE_BYTES", piece)
    cut = textops.hash_words(*textops.text_bytes(pa.array(texts)))
    assert all((a == b).all() for a, b in zip(whole[:4], cut[:4], strict=True))


def brute(rows, n):
    """Components by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("n", [4, 5])
def test_components(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 20, 60, 120]))]
        for _ in range(rng.choice([1, 2, 25])):
            text = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((len(rows) * 7 % 1000 + g * 1000, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=n).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "HUB_MEMBERS", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice("xyz") if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 4)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = near_duplicates(odd, words=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id if r.n_shingles else r.component_id) for r in got), key=repr) == sorted(brute_alone(rows), key=repr)
    assert near_duplicates(none).count() == 0


def brute_alone(rows):
    """As brute, where rows without shingles stand for themselves."""
    for d, n, c in brute(rows, 4):
        yield (d, n, c if n else d)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.lists(st.integers(0, 3), max_size=12))
@settings(max_examples=200, deadline=None)
def test_alignment(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    best = max(map(max, h))
    score, first, end = decontam.align(np.array(item, np.uint64), np.array(text, np.uint64))
    assert score == best and 0 <= first <= end <= len(text)


def test_leaks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, say(rng.randint(12, 50))) for i in range(30)]
    rows, want = [], set()
    for d in range(300):
        text = say(rng.randint(5, 200))
        if d % 3 == 0:
            i, words = rng.choice(items)
            edited = [rng.choice(vocabulary) if d % 2 and k % 9 == 8 else w for k, w in enumerate(words)]
            text[len(text) // 2 : len(text) // 2] = [w.upper() + rng.choice(["", "!!", "***"]) for w in edited]
            want.add((d, i))
        elif d % 3 == 1:
            text += rng.choice(items)[1][:5]  # a phrase in common is no leak
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want


def test_a_leak_that_every_document_has_is_found(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"own{i} words{i} here{i} {item} and{i} more{i}") for i in range(50)], "doc_id long, text string")
    assert contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 50


@pytest.mark.parametrize("step", [5, 6, 7])
def test_an_edited_leak_that_many_documents_have_is_found(spark, step):
    def local(item, text):
        above, best = [0] * (len(text) + 1), 0
        for a in item:
            row = [0]
            for j, b in enumerate(text):
                row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
            above, best = row, max(best, *row)
        return best / (2 * len(item))

    items = {i: [f"q{i}x{k}" for k in range(40)] for i in range(2)}
    copies = {i: ["edited" if k % step == step - 1 else w for k, w in enumerate(words)] for i, words in items.items()}
    texts = {d: [f"own{d}", f"words{d}", *(copies[d % 3] if d % 3 < 2 else items[0][: step - 1]), f"more{d}"] for d in range(300)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    scores = {(d, i): local(w, t) for d, t in texts.items() for i, w in items.items()}
    want = {k: s for k, s in scores.items() if s >= decontam.LEAST_SCORE}
    assert len(want) == 200
    assert {(r.doc_id, r.item_id): r.score for r in contaminated(docs, bench).collect()} == want


@given(st.lists(st.integers(0, 5), min_size=4, max_size=12), st.lists(st.integers(0, 8), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_no_alignment_is_ruled_out(item, text):
    item, text = np.array(item, np.uint64), np.array(text, np.uint64)
    least = decontam.LEAST_SCORE
    assert decontam.promising(item, text, least) or decontam.align(item, text)[0] < least * decontam.MATCH * len(item)


def test_odd_items(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma"), (None, "alpha beta gamma delta epsilon zeta"), (4, "x" * 5000)], "item_id long, text string")
    got = contaminated(odd, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, None), (2, None), (None, None)}
    assert contaminated(none, bench).count() == 0 == contaminated(odd, bench.limit(0)).count()
    assert contaminated(odd.withColumn("text", F.lit(None).cast("string")), bench).count() == 0


def test_repeated_benchmark_items(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"so {item} it was"), (8, "nothing of it here at all")], "doc_id long, text string")
    got = contaminated(docs, bench).collect()
    assert {r.doc_id for r in got} == {7} and {r.item_id for r in got} == {1, 2, None}
    assert all(r.score == 1.0 for r in got)
    assert [r.doc_id for r in uncontaminated(docs, bench).collect()] == [8]


def test_rows_without_items(spark, data, odd, none):
    docs, bench = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    named = {r.doc_id for r in contaminated(docs, bench).collect()}
    left = uncontaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - named and named
    odd = odd.withColumn("lower", F.lit(1))
    assert sorted(map(repr, uncontaminated(odd, bench).collect())) == sorted(map(repr, odd.collect()))
    assert uncontaminated(none, bench).count() == 0 and uncontaminated(odd, bench.limit(0)).count() == odd.count()
