"""Mixing, main texts, nearest neighbours and the pipeline."""

import random
import re

import numpy as np
import pytest

from statelog.llm import ann, catalog, html, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([("a", 0), (None, 10)]) == [0.0, 15.0]
    assert mixing.targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_shards_add_up():
    totals = [17, 0, 400, 3]
    got = [mixing.shard_counts(totals, s, 50, 1) for s in range(9)]
    assert [sum(c[i] for _, c in got) for i in range(4)] == totals
    assert [sum(c) for _, c in got] == [50] * 8 + [20]
    for (first, counts), (after, _) in zip(got, got[1:], strict=False):
        assert [a + b for a, b in zip(first, counts, strict=True)] == after


def test_large_draws_are_exact():
    """The own draw against numpy's where both can, and its mean and spread beyond."""
    rng = np.random.default_rng(1)
    for good, bad, draws in ((30, 50, 20), (5, 4000, 300), (2000, 3000, 2500), (7, 3, 5), (100_000, 400_000, 1000)):
        own = np.array([mixing._drawn(rng, good, bad, draws) for _ in range(6000)])
        other = rng.hypergeometric(good, bad, draws, 6000)
        cuts = np.unique(np.quantile(other, np.linspace(0, 1, 13)[1:-1], method="nearest"))
        gap = np.abs((own[:, None] <= cuts).mean(axis=0) - (other[:, None] <= cuts).mean(axis=0))
        assert gap.max() < 0.04, (good, bad, draws)
    good, bad, draws = 10**11, 3 * 10**11, 5 * 10**9
    own = np.array([mixing._drawn(rng, good, bad, draws) for _ in range(3000)], float)
    spread = np.sqrt(draws * 0.25 * 0.75 * (1 - draws / 4e11))
    assert abs(own.mean() - draws / 4) < 5 * spread / np.sqrt(3000) and 0.9 < own.std() / spread < 1.1
    assert all(0 <= mixing._hypergeometric(rng, 10**10, 10**11, 5 * 10**9) <= 5 * 10**9 for _ in range(20))


def test_mix_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = catalog.QUERIES["op7_mixing_sources"](spark, data).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    assert {r.doc_id: r["size"] for r in rows} == size
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for s in set(source.values()):
        own = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK_WORDS
    again = catalog.QUERIES["op7_mixing_sources"](spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_blocks_hold_the_taken_words(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"d{i}_{k}" for k in range(rng.randint(0, 150))), rng.choice(["a", "b", None])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs, with_text=True, shard_blocks=7, block_words=16)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    seen: dict[int, int] = {}
    blocks = mix.blocks_out().collect()
    for b in blocks:
        for w in b.text.split(" "):
            seen[int(w[1:].split("_")[0])] = seen.get(int(w[1:].split("_")[0]), 0) + 1
    assert {d: n for d, n in taken.items() if n} == seen
    assert len({(b.shard, b.slot) for b in blocks}) == len(blocks)
    words = {i: t.split() for i, t, _ in rows}
    for b in blocks:
        assert b.doc_ids == sorted(set(b.doc_ids), key=b.doc_ids.index)
        assert {int(w[1:].split("_")[0]) for w in b.text.split(" ")} == set(b.doc_ids)
        assert all(w in words[int(w[1:].split("_")[0])] for w in b.text.split(" "))


def test_block_texts_are_dealt_out_once(spark):
    """One exchange of the pieces and one of the slots, by the keys of their join, and sources by name."""
    docs = spark.createDataFrame([(i, f"one two three {i}", s) for i, s in enumerate(["b", None, "a"] * 30)], "doc_id long, text string, source string")
    out = mixing.mixed_blocks(docs, shard_blocks=7, block_words=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*\bblock#", plan)) == 2
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = out.collect()
    assert {r.source for r in rows} == {"a", "b", None} and all(source[d] == r.source for r in rows for d in r.doc_ids)


def test_odd_mix(odd, none):
    got = mixing.mixed_words(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mixed_words(none).count() == 0
    assert mixing.mixed_words(odd.filter("text is null")).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><article>x";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div class="cookie-banner">We use cookies</div><article class="post"><h1>Title &amp;
 more</h1><p>First <b>bold</b> text<br>line<p>Second &lt;para&gt; &#233;<div class="share">Share</div><!-- x --><ul><li>One<li>Two</ul><section class="comments"><p>Nice post</p></section></article>
<aside>Side</aside><form>Log in</form><footer>Foot</footer></body></html>"""
TEXT = "Title & more\n\nFirst bold text line\n\nSecond <para> é\n\nOne\n\nTwo"


def test_main_text():
    assert html.extract(PAGE, None) == TEXT
    assert html.extract(PAGE[: PAGE.index("<li>Two")], None) == TEXT.removesuffix("\n\nTwo")
    assert html.extract("", None) == "" == html.extract("<p></p>", None)
    assert html.extract("a < b <b>c</b> <i", None) == "a < b c"
    assert html.extract("<p>one</p" + "x" * 10, None) == "one"


def test_template_finds_content_without_names(spark):
    page = lambda i: f"<html><body><div><p>Welcome to this site</p></div><div><p>Story {i} begins here</p><p>Read our daily letter</p><p>and it ends with {i * 7} words more</p></div><div>Imprint</div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.example/x", page(i)) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    assert got == {i: f"Story {i} begins here\n\nand it ends with {i * 7} words more" for i in range(40)}


def test_only_places_are_constant(spark):
    bare = lambda i: f"<body><ul><li>Sports</li><li>Contact</li></ul><div><h1>{'Sports' if i == 3 else f'Title {i}'}</h1><p>Story {i} goes on for {i * 7} words</p><p>{'Contact' if i == 3 else f'End {i}'}</p></div></body>"
    copy = lambda i: f"<body><ul><li>Home</li></ul><article><h1>One title</h1><p>{'Other' if i == 3 else 'Same'} story</p></article><div>Imprint</div></body>"
    rows = [(i, f"http://{h}.example/x", page(i)) for h, page in (("bare", bare), ("copy", copy)) for i in range(20)]
    got = {(r.url[7:11], r.page_id): r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got["bare", i] == ("Sports\n\nStory 3 goes on for 21 words\n\nContact" if i == 3 else f"Title {i}\n\nStory {i} goes on for {i * 7} words\n\nEnd {i}")
        assert got["copy", i] == f"One title\n\n{'Other' if i == 3 else 'Same'} story"


def test_names_that_speak_of_others():
    page = '<body class="has-sidebar header-big"><div class="no-comments"><article class="post with-ads header">x</article></div><div id="related"><article>a longer other text</article></div></body>'
    assert html.extract(page, None) == "x"


def texts_of(spark, *pages):
    rows = [(i, "http://h.example/x", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_headings_and_names_within_an_article(spark):
    page = lambda i: (
        f'<body><article><header class="entry-header"><h1>Title {i}</h1></header><div class="article-notice-board"><p>News {i} of the board</p></div>'
        f'<div class="social-history"><p>How people lived in {1500 + i}</p></div><div class="newsletter-note"><p>Read our daily letter</p></div><div class="share-buttons"><p>Share {i}</p></div><p>The end</p></article></body>'
    )
    want = [f"Title {i}\n\nNews {i} of the board\n\nHow people lived in {1500 + i}\n\nThe end" for i in range(6)]
    assert texts_of(spark, *[page(i) for i in range(6)]) == want
    # A page alone can't tell the notice from content.
    assert html.extract(page(0), None) == want[0].replace("\n\nThe end", "\n\nRead our daily letter\n\nThe end")
    assert html.extract('<article><div class="post-header"><h1>Title</h1></div><p>Text</p></article>', None) == "Title\n\nText"


def test_all_articles_stay(spark):
    page = lambda i: f"<body><nav>Menu</nav><main><article><p>First {i}</p></article><article><p>A second one {i}</p></article></main><aside><article>Teaser</article></aside></body>"
    assert texts_of(spark, *[page(i) for i in range(3)]) == [f"First {i}\n\nA second one {i}" for i in range(3)]


def test_article_elements_that_are_teasers(spark):
    page = lambda i: f"<body><section><article><p>Hot {i}</p></article></section><div><p>Story {i} is told at length in this place, as {i * 7} people know by now</p><p>Read our daily letter</p></div></body>"
    assert texts_of(spark, *[page(i) for i in range(4)]) == [f"Story {i} is told at length in this place, as {i * 7} people know by now" for i in range(4)]


def test_hosts_of_few_pages_and_copies(spark):
    page = lambda i: f"<body><div><p>Welcome</p></div><div><p>Story {i} begins</p></div></body>"
    assert texts_of(spark, page(1), page(2)) == ["Story 1 begins", "Story 2 begins"]
    assert texts_of(spark, page(1)) == ["Welcome\n\nStory 1 begins"]
    assert texts_of(spark, page(1), page(1)) == ["Welcome\n\nStory 1 begins"] * 2


def test_bounded_templates(monkeypatch):
    import random

    draw = random.Random(3)
    trees = []
    for i in range(400):
        odd = "".join(f'<div class="c{draw.randrange(10**9)}"><p>x</p></div>' for _ in range(30))
        trees.append(html.folded(*html.parse(f"<body><div class=menu>Home</div>{odd}<p>Story {i}</p></body>")))
    template = trees[0]
    for t in trees[1:]:
        html.merged(template, t)
    assert html.nodes_in(template) < html.MOST_NODES + 16 * 70
    assert html.Wrapper(template).any_constant and template[1] == 400
    monkeypatch.setattr(html, "MOST_PAIRS", 0)
    one, two = (html.folded(*html.parse("<body>" + "".join(f"<{t}>{t}</{t}>" for t in tags) + "</body>")) for tags in (["h2", "p", "div", "p"], ["p", "div", "section", "p"]))
    assert html.match(one[4][0], two[4][0], {}) == (4, [(1, 0), (2, 1), (3, 3)])


@pytest.mark.parametrize("n", [20, 300])
def test_long_lists_are_matched_as_well_as_short_ones(n, monkeypatch):
    """Four pages of n headings and lines, with a part that is first on some of them and last on others."""
    lines = lambda i: "".join(f"<h2>Title {i} {k}</h2><p>Read on</p>" for k in range(n))
    part = lambda i: f"<section>Part {i}</section>"
    pages = [f"<body>{part(i) + lines(i) if i % 2 else lines(i) + part(i)}</body>" for i in range(4)]
    trees = [html.folded(*html.parse(p)) for p in pages]
    size, pairs = html.match(trees[0][4][0], trees[1][4][0], {})
    assert (size, pairs) == (1 + 2 * n, [(k, k + 1) for k in range(2 * n)])
    monkeypatch.setattr(html, "MOST_PAIRS", 3 * n)
    assert html.match(trees[0][4][0], trees[1][4][0], {}) == (size, pairs)
    for t in trees[1:]:
        html.merged(trees[0], t)
    texts = [html.extract(p, html.Wrapper(trees[0])).split("\n\n") for p in pages]
    assert texts == [[f"Part {i}"] * (i % 2) + [f"Title {i} {k}" for k in range(n)] + [f"Part {i}"] * (1 - i % 2) for i in range(4)]


def test_template_merge_counts():
    trees = [html.folded(*html.parse(f"<body><div class=a>x{i % 2}</div><p>{i}</p></body>")) for i in range(6)]
    for t in trees[1:]:
        html.merge(trees[0], t)
    root = trees[0]
    body = root[4][0]
    assert root[1] == 6 and body[4][0][3] and sum(body[4][0][3].values()) == 6


def test_joined_templates_give_the_same(spark, data, monkeypatch):
    one = sorted(map(repr, catalog.QUERIES["op8_html_extraction"](spark, data).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, catalog.QUERIES["op8_html_extraction"](spark, data).collect())) == one


def test_page_query(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = catalog.QUERIES["op8_html_extraction"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "::bad", PAGE), (2, "http://a/", ""), (2, "http://a/", ""), (3, "https://u@B.example:80/x", PAGE), (4, "x", "<div>" * 900 + "deep")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = html.main_texts(pages).collect()
    assert len(got) == 6 and {r.text for r in got} == {"", TEXT, "deep"}
    assert html.main_texts(pages.limit(0)).count() == 0


def exact(rows, every, k):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows]
    for q, x in good:
        if q % every == 0:
            near = sorted((-float(x @ y), i) for i, y in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_neighbours_with_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(200)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    odd = [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] + [1.0] * 7), (5060, [float("inf")] + [1.0] * 7), (5080, [None] + [1.0] * 7), (5100, []), (None, [1.0] * 8), (5120, [1.0] * 3)]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, node int")
    got: dict[int, list] = {}
    for r in ann.nearest(table, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = [(i, np.array(v, np.float32)) for i, v in rows]
    want = exact(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
        cut = want[q][-1][1]
        assert [i for i, s in got[q] if s > cut + 1e-9] == [i for i, s in want[q] if s > cut + 1e-9] or sorted(i for i, _ in got[q]) == sorted(i for i, _ in want[q])
    hot = [i for i, _ in got[1000]]
    assert hot == sorted(hot)
    few = table.filter("vec_id < 3 or vec_id = 20")
    assert ann.nearest(few, 20).count() == 2 * 3
    assert ann.nearest(table.limit(0), 20).count() == 0


def test_recall_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2 * ann.BLOCK + 900, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = ann.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20)
    assert index.rounds >= 3
    got: dict[int, set] = {}
    for r in index.search(spark.range(0, len(rows), 100).withColumnRenamed("id", "query_id")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::100] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 100)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[100 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)]) > 0.95


def test_recall_on_the_embeddings(spark, data):
    """Also tables of one block are searched by rounds over small first groups."""
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    index = ann.Index(table, k=20)
    assert index.rounds >= 1 and index.size > ann.START_BLOCK
    got: dict[int, set] = {}
    for r in index.search(index.rows.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows, 20, 20)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) > 0.95


def test_steps_go_on_until_nothing_changes(spark):
    # A path that starts at the far end of a line of nodes takes many steps.
    line = ann.Index(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>"), k=4)
    at = {int(r.v[1]): r.idx for r in line.nodes.collect()}
    lists = sorted((at[i], [at[j] for j in (i - 1, i + 1) if 0 <= j < 30]) for i in range(30))
    ends = np.cumsum([0, *(len(x) for _, x in lists)])
    near = np.array([j for _, x in lists for j in x])
    row = (0, *(bytearray(x.tobytes()) for x in (ends.astype(np.int64), near.astype(np.int64), np.zeros(len(near), np.int8), np.zeros(30, np.float32))))
    line.near = spark.createDataFrame([row], "b long, ends binary, near binary, new binary, least binary")
    found = line.search(spark.createDataFrame([(1,)], "query_id long"), beam=12).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [29, 28, 27, 26]


def test_rows_that_share_an_id(spark):
    kinds = "vec_id long, embedding array<double>, rank int, score double, idx long, node long, r int, v array<double>"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (1, [0.9, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0])]
    got = ann.nearest(spark.createDataFrame([(*r, 0, 0.0, 0, 0, 0, [0.0]) for r in rows], kinds), 20, k=3).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rank):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert lists[0] == [(1, 0.9), (1, 0.9), (1, 0.5)]
    # The other equal row of id 20 answers, the query's own doesn't: once for each of its two vectors.
    assert sorted(lists[20]) == sorted([(20, 2.0), (20, 2.0), (0, 0.0), (20, 4.0), (20, 2.0), (0, 0.0)])


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_text import brute

    from statelog.llm.decontam import contaminated

    docs = spark.read.parquet(f"{data}/documents.parquet")
    steps = dict(pipeline.STAGES)
    good = spark.createDataFrame(steps["quality"](spark, docs, data).collect(), docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.collect()}
    assert all((d in ids) == bool(q) for d, q in labels.items())
    once = spark.createDataFrame(steps["near_dedup"](spark, good, data).collect(), docs.schema)
    want = {c for _, n, c in brute([(r.doc_id, r.text) for r in good.collect()], 5) if n} | {r.doc_id for r in good.collect() if not WORD.search(r.text or "")}
    assert {r.doc_id for r in once.collect()} == want
    clean = spark.createDataFrame(steps["decontaminate"](spark, once, data).collect(), docs.schema)
    leaked = {r.doc_id for r in contaminated(once, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect()} - leaked
    blank = steps["blank_secrets"](spark, clean, data)
    assert blank.columns == docs.columns and blank.count() == clean.count()
    mixed = pipeline.run(spark, data).collect()
    texts = {r.doc_id: r.text for r in blank.collect()}
    assert {i for r in mixed for i in r.doc_ids} <= set(texts)
    for r in mixed:
        words = [w for i in r.doc_ids for w in WORD.findall(texts[i])]
        at = next(i for i in range(len(words)) if words[i : i + len(r.text.split(" "))] == WORD.findall(r.text))
        assert at < len(WORD.findall(texts[r.doc_ids[0]]))
    folder = spark.conf.get("spark.checkpoint.dir")
    import os

    left = [os.listdir(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("pipeline-")]
    assert left and all(x == ["mix"] for x in left)


def test_pipeline_on_odd_rows(spark, odd, data):
    """One stage after another over nulls, empty and long texts, repeated rows and clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd
    for _, stage in pipeline.STAGES[:-1]:
        made = stage(spark, docs, data)
        assert made.columns == odd.columns
        docs = spark.createDataFrame(made.collect(), odd.schema)
    assert pipeline.mix(spark, docs, data).count() >= 0
    empty = odd.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_near_dedup_of_rows_with_equal_ids(spark, odd, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    near_dedup = dict(pipeline.STAGES)["near_dedup"]
    got = near_dedup(spark, odd.coalesce(1), data).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert [r.text for r in got if r.doc_id is None] == [None]
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "red green blue white black grey"), (None, "red green blue white black grey"), (None, "up down left right in out")]
    got = near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), data).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows[:3] + rows[4:])
    bench = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    rows = [(1, "a text of its own that holds nothing"), (1, f"here it is: {bench} and more"), (None, bench), (None, None)]
    got = dict(pipeline.STAGES)["decontaminate"](spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in spark.createDataFrame([rows[0], rows[3]], "doc_id long, text string").collect()]))
