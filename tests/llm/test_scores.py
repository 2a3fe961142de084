"""Classifiers, language, secrets and token counts."""

import base64
import hashlib
import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statelog.llm import catalog, langid, quality, secrets, tokens, toxicity
from statelog.llm.labels import fold


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    one = np.array(label) == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@given(st.lists(st.integers(-4, 4), max_size=14))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(scores):
    def best(a, b):
        """Recursive definition: a segment of the greatest sum, then the same on both of its sides."""
        top = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if top[0] <= 0:
            return []
        return best(a, top[3]) + [(top[3], top[4] - 1, top[0])] + best(top[4], b)

    want = best(0, len(scores))
    got = toxicity.maximal_segments(np.array(scores, float))
    assert sum(x[2] for x in got) == sum(x[2] for x in want)
    assert max((x[2] for x in got), default=0) == max((x[2] for x in want), default=0)
    # Segments are disjoint, sum to their scores, and no prefix or suffix of one is worth nothing or less.
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    for a, b, s in got:
        assert sum(scores[a : b + 1]) == s
        assert all(sum(scores[a:i]) > 0 and sum(scores[i : b + 1]) > 0 for i in range(a + 1, b + 1))


def planted(texts, kind, seed):
    """The texts with three planted tokens in every eighth, and which these are."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghij")
    if kind == "insults":
        plants = ["loser", "idiot", "moron", "scum", "trash"]
    elif kind == "rare words":
        plants = ["".join(rng.choice(letters, 7)) for _ in range(200)]
    elif kind == "inflected":
        plants = ["zyqev" + "".join(rng.choice(letters, 3)) for _ in range(200)]
    else:  # pairs of words that are common by themselves
        common = ["the", "of", "and", "to", "in", "that", "is", "it"]
        plants = [" ".join(rng.choice(common, 2)) + " " + " ".join(rng.choice(common, 2)) for _ in range(6)]
    out, marks = [], []
    for i, t in enumerate(texts):
        words, mark = t.split(" "), i % 8 == 3
        for _ in range(3 if mark else 0):
            words.insert(rng.integers(len(words) + 1), plants[rng.integers(len(plants))])
        out.append(" ".join(words))
        marks.append(int(mark))
    return out, marks


@pytest.mark.parametrize("kind", ["insults", "rare words", "inflected", "pairs"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_toxicity(spark, data, kind, seed):
    """Whatever the vocabulary, learned from other texts: most planted texts are above nine tenths of the clean ones."""
    import zlib

    texts = [r.text for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/documents.parquet").filter("doc_id % 6 = 1 and lang = 'en' and text is not null").select("text").collect()]
    texts, marks = planted(texts, kind, seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).select("doc_id", "score").collect()}
    held = [i for i in score if zlib.crc32(str(i).encode()) % 4 == 2]
    assert auc([score[i] for i in held], [marks[i] for i in held]) > 0.9


def test_toxicity_brute_force(spark):
    """Weights and scores of a small table, against counting in plain Python."""
    rng = np.random.default_rng(5)
    vocabulary = ["stone", "stones", "river", "rivers", "riverbank", "oak", "elm", "a", "venomous", "venomously"]
    texts = [" ".join(rng.choice(vocabulary[: 8 + 2 * (i % 3 == 0)], 12)) for i in range(90)]
    marks = [int(i % 3 == 0) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    allowed = fold("doc_id", 4) != 2
    model = toxicity.fit(docs, labels, allowed)
    learned = {r.doc_id for r in docs.filter(allowed).collect()}
    rate = sum(marks[i] for i in learned) / len(learned)

    def counted(test):
        held = [i for i in learned if test(texts[i].split())]
        return len(held), sum(marks[i] for i in held)

    def odds(words, at):
        share = rate
        tests = [lambda ws, k=k: any(w.startswith(words[at][:k]) and len(w) > k for w in ws) for k in toxicity.PREFIXES if len(words[at]) > k]
        tests.append(lambda ws: words[at] in ws)
        if at:
            tests.append(lambda ws: (words[at - 1], words[at]) in zip(ws, ws[1:]))
        for level, test in enumerate(tests):
            n, toxic = counted(test)
            if n and (level < len(tests) - 1 or not at or n > 1):
                share = (toxic + toxicity.STRENGTH * share) / (n + toxicity.STRENGTH)
        return np.log(share / (1 - share)) - np.log(rate / (1 - rate)) - toxicity.DRIFT

    import pyarrow as pa

    for i in range(0, 90, 7):
        words = texts[i].split()
        got = toxicity.token_scores(toxicity.words_of(pa.array([texts[i]])), model)
        assert np.allclose(got, [odds(words, j) for j in range(len(words))], atol=1e-5)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    for i, t in enumerate(texts):
        found = toxicity.maximal_segments(toxicity.token_scores(toxicity.words_of(pa.array([t])), model))
        x = np.log1p(sum(np.log1p(np.exp(model.lam * s) / (model.k * 12)) for _, _, s in found))
        assert np.isclose(scores[i], 1 / (1 + np.exp(-(model.slope * x + model.bias))))


def test_held_out_scores(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for name, field, least in (("op4_quality_classifier", "quality", 0.97), ("op2_toxicity", "toxic", 0.97)):
        rows = catalog.QUERIES[name](spark, data).collect()
        assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
        held = [r for r in rows if r.held_out and r.doc_id in labels]
        assert auc([r.score for r in held], [labels[r.doc_id][field] for r in held]) > least
        assert all(0 <= r.score <= 1 for r in rows)


def test_languages(spark, data):
    rows = {r.doc_id: r for r in catalog.QUERIES["op6_language_id"](spark, data.replace("sf0.001", "sf0.01")).collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    held = [d for d, r in rows.items() if r.held_out]
    assert np.mean([rows[d].lang_pred == true[d] for d in held]) > 0.97


def test_language_brute_force(spark, data):
    """Every prediction against bundles that are added up trigram by trigram."""
    import zlib

    dim = langid.DIMENSIONS

    def vector(text):
        letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        runs = "".join(c if c.isalpha() else "\0" for c in letters)
        line = re.sub("\0+", "\0", f"\0{runs}\0")
        grams = {}
        for i in range(len(line) - 2):
            grams[line[i : i + 3]] = grams.get(line[i : i + 3], 0) + 1
        out = np.zeros(dim)
        for g, n in grams.items():
            x, y, z = langid._letter_vectors(np.array([ord(c) for c in g]), dim).astype(float)
            out += n * np.roll(x, 2) * np.roll(y, 1) * z
        return out / max(np.linalg.norm(out), 1e-12)

    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    vectors = {i: vector(r.text or "") for i, r in docs.items()}
    sums = {}
    for i, r in docs.items():
        if r.lang is not None and r.text is not None and any(c.isalpha() for c in r.text) and zlib.crc32(str(i).encode()) % 5:
            sums[r.lang] = sums.get(r.lang, 0.0) + vectors[i]
    names = sorted(sums)
    protos = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for r in catalog.QUERIES["op6_language_id"](spark, data).collect():
        cosine = protos @ vectors[r.doc_id]
        has = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert r.lang_pred == (names[int(cosine.argmax())] if has else "und")
        assert abs(r.score - (max(cosine.max(), 0) if has else 0)) < 1e-4


def test_quality_brute_force(spark, data):
    """Every score against features counted one by one and a full sort of all cosines."""
    import zlib

    from statelog.llm.textops import hash_words, text_bytes

    def features(text):
        import pyarrow as pa

        raw, out = text.encode(), np.zeros(quality.WIDTH)
        c = [int(quality._CLASS[b]) for b in raw]
        for x, y, z in zip(c, c[1:], c[2:]):
            out[quality._SLOT[(x * quality._N + y) * quality._N + z]] += 1
        hashes = hash_words(*text_bytes(pa.array([text]))).hash.tolist()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        assert len(words) == len(hashes)
        for i, (w, h) in enumerate(zip(words, hashes)):
            out[quality.GRAMS + min(len(w), quality.LENGTHS) - 1] += 1
            for back in range(1, quality.REPEATS + 1):
                if i >= back and words[i - back].lower() == w.lower():
                    out[quality.GRAMS + quality.LENGTHS + back - 1] += 1
            out[quality.WIDTH - quality.WORDS + h % quality.WORDS] += 1
        return out

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    counts = {i: features(t) for i, t in docs.items()}
    learned = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs]
    a = np.array([counts[i] for i in learned])
    idf = np.log((len(a) + 1) / ((a > 0).sum(axis=0) + 1)) + 0.5

    def unit(x):
        return x / max(np.linalg.norm(x), 1e-12)

    def weighted(x):
        g, n = quality.GRAMS, max(x[quality.GRAMS : quality.GRAMS + quality.LENGTHS].sum(), 1)
        parts = [x[:g] / max(x[:g].sum(), 1), x[g : -quality.WORDS] / n, quality.WORD_SHARE * x[-quality.WORDS :] / n]
        return unit(np.sqrt(np.concatenate(parts)) * idf)

    rows = np.array([weighted(x) for x in a])
    axes = np.linalg.svd(rows, full_matrices=False)[2][: quality.RANK].T
    voters, marks = np.array([unit(r @ axes) for r in rows]), np.array([labels[i] for i in learned], float)
    off = 0
    for r in catalog.QUERIES["op4_quality_classifier"](spark, data).collect():
        cosine = voters @ unit(weighted(counts[r.doc_id]) @ axes)
        near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-6)
        score = (w * marks[near]).sum() / w.sum()
        # Voters at one distance may be taken in either order.
        tied = np.isclose(np.sort(-cosine)[quality.NEIGHBOURS - 1], np.sort(-cosine)[quality.NEIGHBOURS], atol=1e-5)
        off += not tied and abs(r.score - score) > 1e-3
        assert abs(r.score - score) < 0.1
    assert off == 0


def test_bound_trigrams():
    one, _ = langid.text_vectors(["abc"], 256)
    base = langid._letter_vectors(np.array([0, ord("a"), ord("b"), ord("c")]), 256).astype(int)
    bind = lambda x, y, z: np.roll(base[x], 2) * np.roll(base[y], 1) * base[z]
    want = bind(0, 1, 2) + bind(1, 2, 3) + bind(2, 3, 0)
    assert np.allclose(one[0], want / np.linalg.norm(want))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (8, 1, 0), (None, 1, 1), (7, None, None), (1, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    n = odd.count()
    for f in (toxicity.toxicity, quality.quality):
        got = f(odd, labels).collect()
        assert len(got) == n and all(r.score is not None and 0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert f(none, labels).count() == 0
        assert f(odd, labels.limit(0)).count() == n
    got = langid.language(odd).collect()
    assert len(got) == n
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5))
    assert langid.language(none).count() == 0
    assert {r.lang_pred for r in langid.language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_votes():
    import pyarrow as pa

    texts = ["aaa bbb ccc", "!!! ??? !!!", "aab bba cca", "!?! ?!? !!?"]
    counts = quality.feature_counts(pa.array(texts))
    idf = np.ones(quality.WIDTH, np.float32)
    x = quality._unit(quality._weighted(counts, idf))
    m = quality.Model(idf, np.eye(quality.WIDTH, dtype=np.float32), x[:2], np.array([1.0, 0.0], np.float32))
    s = quality.votes(pa.array(texts), m, neighbours=1)
    assert s.tolist() == [1.0, 0.0, 1.0, 0.0]


# Secrets


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([128 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0), *[number((1 << 200) + i) for i in range(8)])
WRAPPED = der(0x30, number(0), der(0x30, der(6, b"\x2a\x86\x48"), b"\x05\x00"), der(4, RSA))


def pem(data, kind="RSA PRIVATE KEY"):
    text = base64.b64encode(data).decode()
    return f"-----BEGIN {kind}-----\n" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + f"\n-----END {kind}-----"


def token(alg="HS256"):
    enc = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).rstrip(b"=").decode()
    return f"{enc({'alg': alg, 'typ': 'JWT'})}.{enc({'sub': '1234567890'})}.c2lnbmF0dXJlLWJ5dGVz"


def base_spans(text):
    """The base kinds, straight from their statement."""
    out = []
    for k, p in enumerate((r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(p, text):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


@given(st.lists(st.sampled_from(["password", "Token", "SECRET", "api_key", "apikey", "paſſwd", "Key", '"', "'", " ", "  ", ":", "=", "abc", "abcdef12", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "\n", "-", "."]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_base_kinds(parts):
    text = "".join(parts)
    assert [s for s in secrets.scan(text) if s[2] < 3] == base_spans(text)


def test_structure_decides():
    kinds = lambda t: [secrets.KINDS[k] for _, _, k in secrets.scan(t) if k > 2]
    for good in (RSA, WRAPPED):
        assert kinds(f"see {pem(good)} there") == ["pem"]
        assert kinds(f"see {base64.b64encode(good).decode()} there") == ["der"]
        assert kinds(f"see {good.hex()} there") == ["der"]
        bad = good[:-1]
        assert kinds(f"see {pem(bad)} there") == [] == kinds(f"see {base64.b64encode(bad).decode()} there") == kinds(f"see {bad.hex()} there")
    assert kinds(f"a {token()} b") == ["jwt"]
    assert kinds(f"a {token().replace('eyJ', 'eyK', 1)} b") == []
    assert kinds(f"a {token(5)} b") == []
    assert kinds("a " + base64.b64encode(b"just some long text that is not a key at all, really not one").decode()) == []


def test_common_forms_of_keys_and_tokens():
    found = lambda t: [(secrets.KINDS[k], t[a:b]) for a, b, k in secrets.scan(t) if k > 2]
    for good in (RSA, WRAPPED):
        key = base64.b64encode(good).decode()
        assert found(f"PRIVATE_KEY={key}\n") == [("der", key)] == found(f"keys/{key}")
        for escape in ("\\n", "\\r\\n", "\\\\n"):
            block = pem(good).replace("\n", escape)
            assert found(json.dumps({"private_key": "x"}).replace("x", block)) == [("pem", block)]
            assert found(pem(good[:-1]).replace("\n", escape)) == []
    enc = lambda text: base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()
    for head in ('{ "alg": "HS256"}', '{\n  "alg": "HS256"\n}', '{\r\n"alg": "none"}', '{\t"alg": "HS256"}', ' {"alg": "HS256"}', '\n{"alg": "HS256"}'):
        for body in ('{"sub": 1}', '{ "sub": 1 }', "{}", '\r\n{"sub": 1}'):
            made = f"{enc(head)}.{enc(body)}.c2ln"
            assert found(f"token {made} end") == [("jwt", made)]
    assert found(f"{enc('[1, 2, 3, 4]')}.{enc('{}')}.c2ln") == [] == found("Drop.Cat.in Iraq.Cuba.end")


def test_locked_keys():
    kinds = lambda t: [secrets.KINDS[k] for _, _, k in secrets.scan(t) if k > 2]

    def locked(cipher="AES-128-CBC", vector="00112233445566778899AABBCCDDEEFF", size=96, kind="Proc-Type: 4,ENCRYPTED\n"):
        data = base64.b64encode(bytes(range(size))).decode()
        return f"-----BEGIN RSA PRIVATE KEY-----\n{kind}DEK-Info: {cipher},{vector}\n\n{data}\n-----END RSA PRIVATE KEY-----"

    assert kinds(locked()) == ["pem"] == kinds(locked("DES-EDE3-CBC", "0011223344556677", 64))
    for bad in (locked("ROT13"), locked(vector="0011"), locked(size=95), locked(size=3), locked(kind=""), locked("DES-CBC")):
        assert kinds(bad) == []


def test_long_hostile_texts():
    import time

    began = time.perf_counter()
    for piece in ("-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN A ", "eyJ", "eyJh.", "password ", "token:", "MI", "30", "0a", "AKIA", "----", "-----BEGIN PRIVATE KEY-----MIIE-----"):
        secrets.scan(piece * (5_000_000 // len(piece)))
    assert time.perf_counter() - began < 120
    text = ("-----BEGIN RSA PRIVATE KEY-----\n" * 1000 + pem(RSA) + "\n") * 20
    assert [secrets.KINDS[k] for *_, k in secrets.scan(text)] == ["pem"] * 20


def test_redaction(spark, odd, none):
    text = f"é password = hunter22 and {pem(RSA)} end {token()}"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(rows).collect()}
    assert got == {1: "é [assign] and [pem] end [jwt]", 2: None, 3: ""}
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(none).count() == 0
    assert sorted(map(repr, secrets.redact_secrets(odd).collect())) == sorted(map(repr, odd.collect()))


def test_secret_query(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in catalog.QUERIES["op5_secret_scans"](spark, data).collect():
        spans = base_spans(docs[r.doc_id] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for *_, k in spans) for i in range(3))


# Token counts


def test_suffix_sums(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SPAN", 4)
    lengths = [0, 0, 3, 4, 5, 5, 11, 12, 12, 40]
    rows = spark.createDataFrame([(n,) for n in lengths], "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    sums = tokens.suffix_sums(rows)
    for r in sums.collect():
        n = r.n_tokens
        assert r.docs_from == sum(x >= n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.tokens_cut == sum(min(x, n) for x in lengths) and r.rank_below == sum(x < n for x in lengths)
    for limit in (0, 1, 5, 6, 13, 99):
        assert tokens.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    assert tokens.quantile(sums, 0.5) == sorted(lengths)[4]
    assert tokens.suffix_sums(rows.limit(0)).count() == 0


def test_token_lengths(spark, data, odd, none):
    own = tokens.encoding()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.token_lengths(docs).collect():
        assert own.decode(own.encode_ordinary(texts[r.doc_id])) == texts[r.doc_id]
        assert r.n_tokens == len(own.encode_ordinary(texts[r.doc_id]))
    rows = tokens.token_lengths(odd).collect()
    got = {r.doc_id: r.n_tokens for r in rows}
    assert len(rows) == odd.count() and got[3] == got[4] == 0 < got[8] and got[9] == len(own.encode_ordinary("x" * 300_000))
    assert sorted(r.n_tokens for r in rows if r.doc_id is None) == [0, got[1]]
    assert tokens.length_histogram(none).count() == 0


@pytest.mark.parametrize("name", ["op9_token_counts"])
def test_histogram_query(spark, data, name):
    lengths = [r.n_tokens for r in tokens.token_lengths(spark.read.parquet(f"{data}/documents.parquet")).collect()]
    got = {r.n_tokens: r.n_docs for r in catalog.QUERIES[name](spark, data).collect()}
    assert got == {n: lengths.count(n) for n in set(lengths)}
