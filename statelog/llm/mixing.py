"""Mixing sources to target weights by index.

The words of each source, document after document, are packed into blocks of
BLOCK_WORDS. A source's target is a number of block slots. Output shards take
SHARD_BLOCKS slots each; how many of a shard's slots go to which source is drawn
at random, given the totals: multinomial counts under the condition that they
add up. They are drawn down a binary tree of shards, each node splitting its
parent's counts by a hypergeometric draw seeded by its place, so any task can
work out any shard's counts and the slots before it, without the others. Slot j
of a source then takes the block that a keyed permutation of the source's block
numbers gives for j modulo their number, so a block is used a second time only
after all were used once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage
from .textops import mix64, slices

BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
#: Documents of a source in one of the groups that word offsets are summed in.
GROUP_DOCS = 4_000
WORD = r"[^\x20\x09-\x0D]+"
#: Totals up to which numpy draws; larger ones are drawn here, as exactly.
_DRAW_LIMIT = 900_000_000
#: Sources up to which their table is broadcast.
MOST_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and U+0009 to U+000D, in the JVM."""
    blank = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(blank) == 0, 0).otherwise(F.size(F.split(blank, " +"))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Each source's target: ``share`` of all sizes by weight, at most ``most`` times its size.

    Sources are in order, their weights repeat; an excess goes to the others by
    weight until none is above its bound.
    """
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    left, out, open_ = share * sum(n for _, n in sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        full = {i for i in open_ if left * weight[i] / total > most * sizes[i][1]}
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = most * sizes[i][1]
            left -= out[i]
        open_ -= full
        left = max(left, 0.0)
    return out


def _log_gamma_rise(n: float, by: float) -> float:
    """log(gamma(n + by) / gamma(n)) to full relative precision for large n."""
    if n < 100 or n + by < 100:
        return math.lgamma(n + by) - math.lgamma(n)
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3)
    return (n - 0.5) * math.log1p(by / n) + by * math.log(n + by) - by + tail(n + by) - tail(n)


def _drawn(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact hypergeometric draw of any size, by the ratio of uniforms around the mode.

    A point under the curve sqrt(p(k) / p(mode)) is drawn from a box that holds
    it; p(k) / p(mode) is a product of gamma ratios, each taken as a difference.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    p = good / total
    spread = math.sqrt(max(draws * p * (1 - p) * (total - draws) / (total - 1), 0.0) + 0.5)

    def log_ratio(k: int) -> float:
        d = k - mode
        return -(_log_gamma_rise(mode + 1, d) + _log_gamma_rise(good - mode + 1, -d) + _log_gamma_rise(draws - mode + 1, -d) + _log_gamma_rise(bad - draws + mode + 1, d))

    # The curve is below 1, and u * |x| below 2.2 times the spread for it and all flatter tails.
    reach = 2.2 * spread + 2
    while True:
        u, v = 1.0 - rng.random(), (2 * rng.random() - 1) * reach
        k = mode + round(v / u)
        if low <= k <= high and 2 * math.log(u) <= log_ratio(k):
            return k


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good == 0 or draws == 0:
        return 0
    if bad == 0:
        return draws
    return int(rng.hypergeometric(good, bad, draws)) if good + bad <= _DRAW_LIMIT else _drawn(rng, good, bad, draws)


def split(counts: list[int], draws: int, seed: tuple[int, ...]) -> list[int]:
    """How many of each source are among ``draws`` of all these slots."""
    rng = np.random.default_rng(seed)
    rest, out = sum(counts), []
    for c in counts:
        rest -= c
        got = _hypergeometric(rng, c, rest, draws)
        out.append(got)
        draws -= got
    return out


def shard_counts(totals: list[int], shard: int, shard_blocks: int, seed: int) -> tuple[list[int], list[int]]:
    """(each source's first slot in this shard, its number of slots there)."""
    slots = sum(totals)
    lo, hi = 0, -(-slots // shard_blocks)
    first, counts = [0] * len(totals), list(totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(counts, (mid - lo) * shard_blocks, (seed, lo, hi))
        if shard < mid:
            counts, hi = left, mid
        else:
            first = [a + b for a, b in zip(first, left, strict=True)]
            counts, lo = [a - b for a, b in zip(counts, left, strict=True)], mid
    return first, counts


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): four rounds on halves of the bits, repeated until inside."""
    if n <= 1:
        return np.zeros_like(index)
    half = (max(2, int(n - 1).bit_length()) + 1) // 2
    mask, x = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            a, b = b, a ^ (mix64(b + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _slots(totals: list[int], blocks: list[int], shard_blocks: int, seed: int):
    """(source number, block, shard, slot of the shard) for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first, counts = shard_counts(totals, shard, shard_blocks, seed)
                src = np.repeat(np.arange(len(counts)), counts)
                block = [permuted(np.arange(a, a + c) % max(n, 1), n, seed * 1_000_003 + i) for i, (a, c, n) in enumerate(zip(first, counts, blocks, strict=True))]
                place = np.random.default_rng((seed, shard, 1)).permutation(len(src))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(src.astype(np.int32)), pa.array(np.concatenate(block) if block else np.zeros(0, np.int64)), pa.array(np.full(len(src), shard)), pa.array(place.astype(np.int64))],
                    ["src", "block", "shard", "slot"],
                )

    return run


class Mix:
    """A mix of ``docs``: its sources, packed documents and slots.

    ``sources``: per source (in order of code points, null last) its name,
    number, size, target and slots; read by the driver, since the weights are
    given per source. ``packed``: (row columns, src, size, start), where start
    is the row's first word in its source's order. ``slots``: (src, block,
    shard, slot), every slot of the output. Null texts have size 0; null ids and
    repeated rows are rows like others, and are spread by their texts. Other
    columns are not looked at. Reruns agree.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights: tuple[float, ...] = (3, 1, 2),
        share: float = 1.5,
        most: float = 2.0,
        block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS,
        seed: int = 17,
        with_text: bool = False,
    ):
        spark = docs.sparkSession
        self.stage, self.block_words = Stage(spark, "mix"), block_words
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tkey"), *([text.alias("text")] if with_text else []))
        rows = self.stage.write(rows, "sizes")
        found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
        want = targets([(r.source, r.n) for r in found], weights, share, most)
        self.blocks = [-(-r.n // block_words) for r in found]
        totals = [round(t * b / r.n) if r.n else 0 for t, b, r in zip(want, self.blocks, found, strict=True)]
        groups = [max(1, -(-r.docs // GROUP_DOCS)) for r in found]
        kinds = "source string, src int, source_size long, target double, slots long, groups int"
        table = [(r.source, i, r.n, w, s, g) for i, (r, w, s, g) in enumerate(zip(found, want, totals, groups, strict=True))]
        self.sources, self.count = spark.createDataFrame(table, kinds), len(table)
        self.packed = self._offsets(rows)
        shards = -(-sum(totals) // shard_blocks)
        n = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        ids = spark.range(0, shards, 1, n)
        self.slots = ids.mapInArrow(_slots(totals, self.blocks, shard_blocks, seed), "src int, block long, shard long, slot long")

    def _offsets(self, rows: DataFrame) -> DataFrame:
        """Each row's first word in its source's order: by group, then id, then size and text."""
        s = F.broadcast(self.sources) if self.count <= MOST_BROADCAST else self.sources
        rows = rows.join(s, rows.source.eqNullSafe(self.sources.source)).drop(self.sources.source)
        rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "tkey", F.lit(3)), F.col("groups")).cast("int"))
        sums = rows.groupBy("src", "grp").agg(F.sum("size").alias("in_group"))
        before = Window.partitionBy("src").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("src").alias("s"), F.col("grp").alias("g"), F.coalesce(F.sum("in_group").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("src", "grp").orderBy("doc_id", "size", "tkey").rowsBetween(Window.unboundedPreceding, -1)
        keys = [c for c in rows.columns if c not in ("slots", "groups", "grp", "tkey")]
        rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        rows = rows.join(sums, (F.col("src") == F.col("s")) & (F.col("grp") == F.col("g")))
        return rows.select(*keys, (F.col("base") + F.col("inner")).alias("start"))

    def parts(self) -> DataFrame:
        """(row columns, block, words of it): a row for every block that a document overlaps."""
        b, first, last = self.block_words, F.col("start"), F.col("start") + F.col("size")
        rows = self.packed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(first / b), F.floor((last - 1) / b))))
        words = F.least(last, (F.col("block") + 1) * b) - F.greatest(first, F.col("block") * b)
        return rows.withColumn("words", words)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every row: words of it in the mix, repeats counted."""
        packed = self.stage.write(self.packed.withColumn("row", F.monotonically_increasing_id()), "packed")
        self.packed = packed
        # Written, so that its true size decides how it is joined.
        used = self.stage.write(self.slots.groupBy("src", "block").agg(F.count("*").alias("times")), "used")
        sums = self.parts().join(used, ["src", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        out = packed.join(sums, "row", "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def blocks_out(self) -> DataFrame:
        """The mix itself, needs ``with_text``: (shard, slot, source, block, doc_ids, text).

        A block's words are joined by blanks; ``doc_ids`` are those of the
        documents that it has words of, in order, null ids left out.
        """
        kinds = "src int, source string, block long, start long, doc_id long, w string"
        pieces = self.packed.filter("size > 0").select("src", "source", "start", "doc_id", "text").mapInArrow(_pieces(self.block_words), kinds)
        # Grouped by just the keys of the join, so that the text isn't dealt out once more for it.
        packed = pieces.groupBy("src", "block").agg(F.max("source").alias("source"), F.sort_array(F.collect_list(F.struct("start", "doc_id", "w"))).alias("p"))
        ids = F.array_compact(F.transform("p", lambda x: x["doc_id"]))
        packed = packed.select("src", "source", "block", ids.alias("doc_ids"), F.array_join(F.transform("p", lambda x: x["w"]), " ").alias("text"))
        # Slots compress so well that their shuffle looks small enough to broadcast; it grows with the mix.
        return self.slots.hint("shuffle_merge").join(packed, ["src", "block"]).select("shard", "slot", "source", "block", "doc_ids", "text")


_WORD = re.compile(WORD)


def _pieces(block_words: int):
    """Every text cut where blocks of words end, in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src", "source", "block", "start", "doc_id", "w"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for src, source, start, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("src", "source", "start", "doc_id", "text")), strict=True):
                    words = _WORD.findall(text or "")
                    at = 0
                    while at < len(words):
                        block = (start + at) // block_words
                        to = min(len(words), (block + 1) * block_words - start)
                        out.append((src, source, block, start + at, doc_id, " ".join(words[at:to])))
                        at = to
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, size, source_size, target, taken)."""
    return Mix(docs, **options).taken()


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """The mix of whole documents as blocks of words: (shard, slot, source, block, doc_ids, text)."""
    return Mix(docs, with_text=True, **options).blocks_out()
