"""Near-duplicate classes by min-max hashing, confirmed on full shingle sets.

Under each of ``permutations`` random orders of the shingles both the smallest
and the largest one are kept, so a hash evaluation yields two signature values,
each of which agrees for two documents with probability equal to their Jaccard
similarity. Values are kept to 16 bits; a band is two orders (four values, eight
bytes), and documents that agree in any band are candidates. With 64 orders
there are 32 bands: two documents of similarity 0.8 share none with probability
(1 - 0.8 ** 4) ** 32, about 5e-8.

Candidates are never expanded into all pairs of a bucket. Documents with equal
shingle sets form a class first. Each bucket then links its classes to its
smallest one (a star), those links are checked on the full sets, and components
are formed. Links inside a component cannot change the result, so only buckets
that still hold several components, and more than the one pair a star covers,
are looked at again: pairs of different components that the signatures don't
rule out join their classes to a family, of which a bucket passes on a spanning
forest only. Families are then compared on full sets, two blocks of bounded size
at a time, and again only links that join components are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage
from .textops import _stream, hash_ngrams, hash_words, mix64, slices, text_bytes

PERMUTATIONS = 64
BAND_BYTES = 8
HUB_MEMBERS = 128
BLOCK = 512
BLOCK_BYTES = 16 << 20
WIDTH = 4096
#: A candidate of estimated similarity below the threshold less this is ruled out. Six standard deviations of the estimate.
MARGIN = 0.22


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and n + 1 offsets."""
    data, offsets = text_bytes(column)
    found = hash_words(data, offsets)
    grams, owner, _ = hash_ngrams(found, words)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(column) + 1))


def set_digests(grams: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set; None for the empty one."""
    out: list[bytes | None] = [None] * (len(at) - 1)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        first = at[full]
        pair = np.empty((len(full), 2), ">u8")
        pair[:, 0] = np.add.reduceat(mix64(grams + np.uint64(0x1F83D9ABFB41BD6B)), first)
        pair[:, 1] = np.add.reduceat(mix64(grams ^ np.uint64(0x5BE0CD19137E2179)), first)
        for i, p in zip(full.tolist(), pair, strict=True):
            out[i] = p.tobytes()
    return out


def signatures(grams: np.ndarray, at: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """For every non-empty set the low 16 bits of its least and greatest value under each order."""
    full = np.flatnonzero(at[1:] > at[:-1])
    scale = (_stream(permutations, 21) | np.uint64(1)).astype(np.uint32)[:, None]
    shift = _stream(permutations, 22).astype(np.uint32)[:, None]
    h = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(full), permutations, 2), "<u2")
    for k, i in enumerate(full.tolist()):
        low = high = None
        for a in range(at[i], at[i + 1], WIDTH):
            v = scale * h[a : min(a + WIDTH, at[i + 1])]
            v += shift
            lo, hi = v.min(axis=1), v.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        out[k, :, 0], out[k, :, 1] = low.astype("<u2"), high.astype("<u2")
    return out


def _signed(words: int, permutations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), words)
                names = set_digests(grams, at)
                sigs = iter(signatures(grams, at, permutations))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("tkey"),
                        pa.array(np.diff(at).astype(np.int64)),
                        pa.array(names, pa.binary()),
                        pa.array([None if d is None else next(sigs).tobytes() for d in names], pa.binary()),
                    ],
                    ["doc_id", "tkey", "n_shingles", "digest", "sig"],
                )

    return run


def _with_nodes(words: int):
    """(node, text) of texts whose own set is the wanted node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names = set_digests(*shingle_sets(part.column("text"), words))
                keep = pa.array([a == b for a, b in zip(names, part.column("digest").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("text")], ["node", "text"]).filter(keep)

    return run


def _confirm(words: int, share: tuple[int, int]):
    """Rows sorted by hub with the hub's own text (no member) before its members': the links that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = -1, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), words)
                a, b = [], []
                for i, (h, m) in enumerate(zip(part.column("hub").to_pylist(), part.column("member").to_pylist(), strict=True)):
                    own = grams[at[i] : at[i + 1]]
                    if m is None:
                        hub, hub_set = h, own.copy()
                        continue
                    assert h == hub, "a hub's text comes before its members"
                    low, high = sorted((len(own), len(hub_set)))
                    if share[1] * low < share[0] * high:
                        continue
                    where = np.searchsorted(hub_set, own)
                    where[where == len(hub_set)] = 0
                    both = int(np.count_nonzero(hub_set[where] == own))
                    if share[1] * both >= share[0] * (low + high - both):
                        a.append(h)
                        b.append(m)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["hub", "member"])

    return run


def confirmed_links(pairs: DataFrame, texts: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (hub, member) whose full sets are similar enough.

    A hub's text goes once to each group of about HUB_MEMBERS of its members, so
    a hub with very many members is spread over many tasks.
    """
    salt = (F.xxhash64("member").bitwiseAND(F.lit(0x7FFFFFFF)) % F.col("parts")).cast("int")
    sized = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(sized, "hub").select("hub", "member", salt.alias("salt"))
    hubs = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    hubs = hubs.join(texts, hubs.hub == texts.node).select("hub", F.lit(None).cast("long").alias("member"), "salt", "text")
    members = dealt.join(texts, dealt.member == texts.node).select("hub", "member", "salt", "text")
    rows = hubs.unionByName(members)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return rows.select("hub", "member", "text").mapInArrow(_confirm(words, share), "hub long, member long")


def components(links: DataFrame, stage: Stage, a: str = "hub", b: str = "member") -> DataFrame:
    """(node, comp): the smallest node reachable, for every node with a link.

    Each round takes the least label among a node's neighbours and then that
    label's own label, which halves the way that is left; the tables stay
    distributed, and one count per round comes back.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct()
    edges = stage.write(both, "edges")
    labels = written = stage.write(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("comp")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("comp").alias("best"))
        pulled = labels.join(near, labels.node == near.x).select("node", F.least("comp", "best").alias("new"), F.col("comp").alias("old"))
        root = labels.select(F.col("node").alias("r"), F.col("comp").alias("up"))
        jumped = pulled.join(root, pulled.new == root.r, "left").select("node", F.least("new", "up").alias("comp"), "old")
        after = stage.write(jumped, "labels")
        moved = after.filter(F.col("comp") != F.col("old")).limit(1).count()
        stage.drop(written)
        written, labels = after, after.select("node", "comp")
        if not moved:
            return labels


def _buckets(classes: DataFrame, permutations: int) -> DataFrame:
    """(node, bucket) for each band; buckets whose hashes collide are one, which only adds candidates."""
    bands = range(permutations * 4 // BAND_BYTES)
    keys = [F.xxhash64(F.lit(i), F.substring("sig", i * BAND_BYTES + 1, BAND_BYTES)) for i in bands]
    return classes.select("node", F.explode(F.array(*keys)).alias("bucket"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by ``keys``, each whole, one at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values = list(zip(*(table[k].to_pylist() for k in keys), strict=True))
        at = 0
        for i, v in enumerate(values):
            if v != last:
                if i > at:
                    held.append(table.slice(at, i - at))
                if held:
                    yield pa.concat_tables(held)
                held, at, last = [], i, v
        if at < len(values):
            held.append(table.slice(at))
    if held:
        yield pa.concat_tables(held)


def _plausible(sig: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Those of the others that neither size nor signature rules out as a link of i."""
    small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
    others = others[share[1] * small >= share[0] * large]
    return others[(sig[others] == sig[i]).mean(axis=1) >= share[0] / share[1] - MARGIN] if len(others) else others


def _block_links(keys: list[str], share: tuple[int, int], exact: bool):
    """For each pair of blocks: links between different components that join what was apart so far.

    Without ``exact`` a plausible pair counts as a link and joins two nodes, so
    that every node with a plausible pair is reached; with it, full sets decide
    and a link joins two components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, keys):
            side, size = np.array(table["side"]), np.array(table["n"])
            node = table["node"].to_pylist()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(len(node), -1)
            sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()] if exact else None
            comp = np.unique(np.array(table["comp"]), return_inverse=True)[1]
            joined = comp.copy() if exact else np.arange(len(node))
            right, a, b = np.flatnonzero(side != 0), [], []
            for i in np.flatnonzero(side != 1).tolist():
                others = right[(comp[right] != comp[i]) & (joined[right] != joined[i])]
                for j in _plausible(sig, size, i, others, share).tolist():
                    if joined[i] == joined[j]:
                        continue
                    if exact:
                        where = np.searchsorted(sets[j], sets[i])
                        where[where == len(sets[j])] = 0
                        common = int(np.count_nonzero(sets[j][where] == sets[i]))
                        if share[1] * common < share[0] * (len(sets[i]) + len(sets[j]) - common):
                            continue
                    joined[joined == joined[j]] = joined[i]
                    if exact:
                        a.append(node[i])
                        b.append(node[j])
            if not exact:  # each group's least node with the others, which most buckets agree on
                least: dict[int, int] = {}
                for x, g in zip(node, joined.tolist(), strict=True):
                    least[g] = min(x, least.get(g, x))
                a, b = zip(*((least[g], x) for x, g in zip(node, joined.tolist(), strict=True) if least[g] != x), strict=True) if len(least) < len(node) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["hub", "member"])

    return run


def _paired_blocks(rows: DataFrame, keys: list[str], share: tuple[int, int], exact: bool) -> DataFrame:
    """Links between the rows of each key, whose number of blocks is in ``blocks``."""
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("blk", own).withColumn("oth", other)
    side = F.when(F.col("oth") == F.col("blk"), 2).when(F.col("blk") < F.col("oth"), 0).otherwise(1)
    have = ["node", "n", "comp", "sig", *(["grams"] if exact else [])]
    rows = rows.select(*keys, F.least("blk", "oth").alias("b0"), F.greatest("blk", "oth").alias("b1"), side.alias("side"), *have)
    keys = [*keys, "b0", "b1"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_block_links(keys, share, exact), "hub long, member long")


def _node_grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), words)
                sets = pa.array([grams[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "grams"])

    return run


def _cross_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, stage: Stage, words: int, share: tuple[int, int]) -> DataFrame | None:
    """Links between different components that share a bucket; None if no bucket has several."""
    lab = labels.select(F.col("node").alias("ln"), "comp")
    rows = buckets.join(lab, buckets.node == lab.ln, "left").withColumn("comp", F.coalesce("comp", "node")).drop("ln")
    many = rows.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members"))
    many = many.filter("c0 != c1 and members > 2").select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    sigs = classes.select(F.col("node").alias("sn"), "n", "sig")
    mixed = rows.join(many, "bucket")
    mixed = mixed.join(sigs, mixed.node == sigs.sn).drop("sn")
    near = stage.write(_paired_blocks(mixed, ["bucket"], share, False).distinct(), "near")
    if near.limit(1).count() == 0:
        return None
    family = components(near, stage).withColumnRenamed("comp", "family")
    member = family.join(classes.select("node", "n", "sig"), "node").join(lab, F.col("node") == F.col("ln"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("ln")
    sized = member.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES)).cast("int").alias("blocks"))
    grams = texts.join(family.select("node"), "node", "left_semi").mapInArrow(_node_grams(words), "node long, grams binary")
    whole = member.join(sized, "family").join(grams, "node")
    return stage.write(_paired_blocks(whole, ["family"], share, True), "links")


def _joined(labels: DataFrame, links: DataFrame, stage: Stage) -> DataFrame:
    """The labels after further links, by the components of the graph of components."""
    for end in ("hub", "member"):
        lab = labels.select(F.col("node").alias("ln"), "comp")
        links = links.join(lab, links[end] == lab.ln, "left").withColumn(end, F.coalesce("comp", end)).drop("ln", "comp")
    over = components(links.filter("hub != member"), stage).select(F.col("node").alias("on"), F.col("comp").alias("oc"))
    known = labels.union(over.select("on", F.col("on"))).distinct()
    return known.join(over, known.comp == over.on, "left").select("node", F.coalesce("oc", "comp").alias("comp"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
    permutations: int = PERMUTATIONS,
) -> DataFrame:
    """Near-duplicate component of every document: (doc_id, n_shingles, component_id, kept).

    A document's set holds its distinct shingles of ``words`` words, A-Z
    lower-cased; with fewer words, the whole sequence. Documents are linked if
    ``threshold[1] * intersection >= threshold[0] * union``; component_id is the
    smallest id reachable, and kept says that it is the document's own.

    Null or wordless texts have no shingles and stay alone. Rows with a null id
    take part; their component_id is the smallest id there, or null, and they
    are kept only in the latter case. Repeated rows each come back, in one
    component. Columns other than the two named are not looked at.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near-duplicates")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", F.xxhash64("text"))
    kinds = "doc_id long, tkey long, n_shingles long, digest binary, sig binary"
    signed = stage.write(rows.mapInArrow(_signed(words, permutations), kinds), "signed")
    classes = (
        signed.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "tkey")).alias("rep"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    )
    classes = stage.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # Every class in a bucket with others is there as the bucket's smallest or paired with it.
    buckets = _buckets(classes, permutations)
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1").select("bucket", "hub")
    pairs = buckets.join(hubs, "bucket").filter("hub != node").select("hub", F.col("node").alias("member")).distinct()
    pairs = stage.write(pairs, "pairs")
    wanted = pairs.select(F.col("hub").alias("node")).union(pairs.select("member")).distinct()
    near = stage.write(classes.join(wanted, "node"), "near")
    wanted = near.select("node", "digest", F.col("rep.doc_id").alias("wid"), F.col("rep.tkey").alias("wkey"))
    texts = rows.join(wanted, (F.col("tkey") == F.col("wkey")) & F.col("doc_id").eqNullSafe(F.col("wid"))).select("node", "digest", "text")
    texts = stage.write(texts.mapInArrow(_with_nodes(words), "node long, text string"), "texts")

    links = stage.write(confirmed_links(pairs, texts, words, threshold), "links")
    labels = components(links, stage)
    more = _cross_links(_buckets(near, permutations), labels, near, texts, stage, words, threshold)
    if more is not None:
        labels = _joined(labels, more, stage)

    named = classes.select("node", "digest", "min_id").join(labels, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"), "min_id")
    least = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    by_set = named.join(least, "comp").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
