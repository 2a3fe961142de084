"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors form one node. Nodes are numbered in the order of the signs of
fixed random projections, so that near nodes tend to have near numbers, and
BLOCK consecutive ones are a block; a block's edges are one row of packed arrays.
Small groups, of neighbours in that order and of random nodes, give the first
edges. A round then joins neighbours of neighbours: around every node, its
neighbours and the nodes that it is a neighbour of are compared with each other,
unless both were so compared before, and what beats a node's worst neighbour is
passed on. Rounds end when hardly any edge is new. A task holds one block, for
which it gets every vector once: at most BLOCK * (DEGREE + REVERSE) vectors,
whatever the number of rows, and nothing depends on the number of cores. A block
asks other blocks for vectors, and each answers with one row of those it has.

A query starts at its own node and expands the nodes of its beam, the BEAM
nearest that were seen, until all of them are expanded. The nearest of the beam
are ranked by the exact inner product, in double precision, of the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import Stage

DEGREE = 32
REVERSE = 32
#: Rounds end when at most this share of all edges is new.
CHANGED = 0.01
START_BLOCK = 256
BLOCK = 4096
#: Best partners that each comparison around one node passes on per node.
PASSED = 4
BEAM = 192
QUERY_BLOCK = 512
#: Vectors that a task of the search may need at most, which bounds the queries it takes.
TASK_VECTORS = 500_000
#: Signs in the order of the nodes.
SIGNS = 16

_EDGES = "b long, old int, u binary, c binary, s binary, f binary"
_AROUND = "b long, ends binary, near binary, new binary, least binary"
_STATE = "qb long, idx long, vec binary, near binary, sim binary, todo binary"
_ASKED = "owner long, asker long, ids binary"
_VECTORS = "asker long, ids binary, vec binary, least binary"
_NEAR = "asker long, ids binary, ends binary, near binary"


def _blob(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _packed_edges(u: np.ndarray, c: np.ndarray, s: np.ndarray, f: np.ndarray) -> pa.Table:
    """Edges of any nodes as one row for each block that they start in."""
    order = np.argsort(u // BLOCK, kind="stable")
    u, c, s, f = u[order], c[order], s[order], f[order]
    block = u // BLOCK
    at = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    parts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    blobs = [pa.array([x[i:j].tobytes() for i, j in parts], pa.binary()) for x in ((u % BLOCK).astype(np.int32), c.astype(np.int64), s.astype(np.float32), f.astype(np.int8))]
    return pa.table([pa.array(block[at[:-1]], pa.int64()), pa.array([0] * len(parts), pa.int32()), *blobs], ["b", "old", "u", "c", "s", "f"])


def _unpacked_edges(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Node within its block, partner, similarity, flag, and whether the row is the graph's own."""
    u, c, s, f = (_blob(table[n], k) for n, k in (("u", np.int32), ("c", np.int64), ("s", np.float32), ("f", np.int8)))
    own = [np.full(len(x), old > 0) for x, old in zip(u, table["old"].to_pylist(), strict=True)]
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (u, c, s, f, own))


def _first_edges(degree: int):
    """The nearest ``degree`` of each node within its group of a few."""

    def run(table: pa.Table) -> pa.Table:
        idx, sub, x = np.array(table["idx"]), np.array(table["sub"]), _matrix(table["vec"])
        order = np.lexsort((idx, sub))
        idx, sub, x = idx[order], sub[order], x[order]
        at = np.flatnonzero(np.diff(sub, prepend=-1, append=-1))
        us, cs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            k = min(degree, b - a - 1)
            if k < 1:
                continue
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, -np.inf)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            us.append(np.repeat(idx[a:b], k))
            cs.append(idx[a:b][best].ravel())
            ss.append(np.take_along_axis(s, best, axis=1).ravel())
        u, c, s = np.concatenate(us), np.concatenate(cs), np.concatenate(ss)
        return _packed_edges(u, c, s, np.ones(len(u), np.int8))

    return run


def _merged(degree: int):
    """A block's edges after those found are added: the nearest ``degree`` of each node."""

    def run(table: pa.Table) -> pa.Table:
        block = table["b"][0].as_py()
        u, c, s, f, own = _unpacked_edges(table)
        f = np.where(own, 0, 1)  # what was there has been compared with all others
        order = np.lexsort((f, c, u))
        u, c, s, f = u[order], c[order], s[order], f[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
        u, c, s, f = u[new], c[new], s[new], f[new]
        order = np.lexsort((c, -s, u))
        u, c, s, f = u[order], c[order], s[order], f[order]
        top = np.arange(len(u)) - np.searchsorted(u, u) < degree
        u, c, s, f = u[top], c[top], s[top], f[top]
        out = _packed_edges(block * BLOCK + u.astype(np.int64), c, s, f)
        out = out.set_column(1, "old", pa.array([1] * out.num_rows, pa.int32()))
        return out.append_column("fresh", pa.array([int(f.sum())] * out.num_rows, pa.int64())).append_column("edges", pa.array([len(f)] * out.num_rows, pa.int64()))

    return run


def _reversed(batches):
    """Every edge from its other end."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(i, 1)])
            u, c, s, f, _ = _unpacked_edges(row)
            yield from _packed_edges(c, row["b"][0].as_py() * BLOCK + u.astype(np.int64), s, f).to_batches()


def _around(degree: int, reverse: int):
    """For each node of a block: its neighbours, the nearest that it is a neighbour of, and its worst similarity."""

    def run(table: pa.Table) -> pa.Table:
        u, c, s, f, own = _unpacked_edges(table)
        n = int(u.max()) + 1 if len(u) else 0
        count = np.bincount(u[own], minlength=n)
        least = np.full(n, np.inf, np.float32)
        np.minimum.at(least, u[own], s[own])
        least[count < degree] = -np.inf
        order = np.lexsort((c, -s, u, own))
        u, c, f, own = u[order], c[order], f[order], own[order]
        back = int((~own).sum())
        rank = np.arange(back) - np.searchsorted(u[:back], u[:back])
        keep = np.concatenate([rank < reverse, np.ones(len(u) - back, bool)])
        u, c, f = u[keep], c[keep], f[keep]
        order = np.lexsort((-f, c, u))
        u, c, f = u[order], c[order], f[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
        u, c, f = u[new], c[new], f[new]
        ends = np.searchsorted(u, np.arange(n + 1)).astype(np.int64)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ends, c, f.astype(np.int8), least)]
        return pa.table([pa.array([table["b"][0].as_py()], pa.int64()), *blobs], ["b", "ends", "near", "new", "least"])

    return run


def _lists(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[n][0].as_py(), k) for n, k in (("ends", np.int64), ("near", np.int64), ("new", np.int8), ("least", np.float32)))


def _asking(asker: int, ids: np.ndarray) -> pa.RecordBatch:
    """What one block asks of each other: one row for each block that has some of these nodes."""
    owner = ids // BLOCK
    at = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    blobs = [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(owner[at[:-1]], pa.int64()), pa.array([asker] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["owner", "asker", "ids"])


def _asks(asked: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Every asker with all nodes that it asked of a block."""
    asker, ids = np.array(asked["asker"]), _blob(asked["ids"], np.int64)
    for a in np.unique(asker).tolist():
        yield a, np.unique(np.concatenate([ids[i] for i in np.flatnonzero(asker == a).tolist()]))


def _wanted(batches):
    """What each block asks for: the nodes around its nodes that have anything new around them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = pa.Table.from_batches([batch.slice(i, 1)])
            ends, near, new, _ = _lists(row)
            active = np.add.reduceat(np.append(new, 0).astype(np.int64), ends[:-1]) * (np.diff(ends) > 0) if len(ends) > 1 else np.zeros(0)
            yield _asking(row["b"][0].as_py(), np.unique(near[np.repeat(active > 0, np.diff(ends))]))


def _answers(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)


def _vectors_of(asked: pa.Table, block: pa.Table) -> pa.Table:
    """A block's answers: the vectors asked for and, where the block has them, their nodes' worst similarities."""
    out = []
    if block.num_rows and asked.num_rows:
        start = block["b"][0].as_py() * BLOCK
        x = np.frombuffer(block["vec"][0].as_py(), np.float32).reshape(block["n"][0].as_py(), -1)
        least = block["least"][0].as_py()
        worst = np.full(len(x), -np.inf, np.float32)
        if least is not None:
            worst[: len(least) // 4] = np.frombuffer(least, np.float32)
        out = [(a, ids.tobytes(), x[ids - start].tobytes(), worst[ids - start].tobytes()) for a, ids in _asks(asked)]
    return _answers(out, ["asker", "ids", "vec", "least"])


def _near_of(asked: pa.Table, block: pa.Table) -> pa.Table:
    """A block's answers: the lists of the nodes asked for; a node alone has none."""
    out = []
    if asked.num_rows:
        start = asked["owner"][0].as_py() * BLOCK
        ends, near = _lists(block)[:2] if block.num_rows else (np.zeros(1, np.int64), np.zeros(0, np.int64))
        for a, ids in _asks(asked):
            lists = [near[ends[i] : ends[i + 1]] if i + 1 < len(ends) else near[:0] for i in (ids - start).tolist()]
            out.append((a, ids.tobytes(), np.cumsum([0, *map(len, lists)]).astype(np.int64).tobytes(), np.concatenate(lists).tobytes()))
    return _answers(out, ["asker", "ids", "ends", "near"])


def _answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All answered nodes in order, their vectors and worst similarities."""
    ids = np.concatenate([np.zeros(0, np.int64), *_blob(table["ids"], np.int64)])
    if not len(ids):
        return ids, np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
    x = np.concatenate(_blob(table["vec"], np.float32)).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], x[order], np.concatenate(_blob(table["least"], np.float32))[order]


def _local_join(passed: int, degree: int):
    """Around each node of a block, its members' best partners that beat their worst neighbour."""

    def run(around: pa.Table, members: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not around.num_rows or not members.num_rows:
            return _packed_edges(none, none, none, none).drop_columns("old")
        ends, near, new, _ = _lists(around)
        idx, x, least = _answered(members)
        sizes = np.diff(ends)
        active = np.flatnonzero(np.add.reduceat(np.append(new, 0).astype(np.int64), ends[:-1]) * (sizes > 0) > 0)
        width = int(sizes[active].max(initial=0))
        us, cs, ss = [none], [none], [np.zeros(0, np.float32)]
        for a in range(0, len(active), 256):
            v = active[a : a + 256]
            at = ends[v][:, None] + np.arange(width)
            there = np.arange(width) < sizes[v][:, None]
            at = np.minimum(at, len(near) - 1)
            m = np.minimum(np.searchsorted(idx, near[at]), len(idx) - 1)
            fresh = (new[at] > 0) & there
            part = x[m]
            s = np.matmul(part, part.transpose(0, 2, 1))
            s[~((fresh[:, :, None] | fresh[:, None, :]) & there[:, :, None] & there[:, None, :])] = -np.inf
            s[:, np.arange(width), np.arange(width)] = -np.inf
            s[s <= least[m][:, :, None]] = -np.inf
            k = min(passed, width)
            best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            value = np.take_along_axis(s, best, axis=2)
            i, j, l = np.nonzero(value > -np.inf)
            us.append(m[i, j])
            cs.append(m[i, best[i, j, l]])
            ss.append(value[i, j, l])
        u, c, s = np.concatenate(us), np.concatenate(cs), np.concatenate(ss)
        _, first = np.unique(u * len(idx) + c, return_index=True)
        u, c, s = u[first], c[first], s[first]
        order = np.lexsort((c, -s, u))
        u, c, s = u[order], c[order], s[order]
        top = np.arange(len(u)) - np.searchsorted(u, u) < degree
        return _packed_edges(idx[u[top]], idx[c[top]], s[top], np.ones(int(top.sum()), np.int8)).drop_columns("old")

    return run


def _expanded(beam: int):
    """One step of every query of a block: all nodes of its beam that are to do are expanded."""

    def run(lists: pa.Table, vectors: pa.Table) -> pa.Table:
        idx, x, _ = _answered(vectors)
        kind, node = np.array(lists["kind"]), lists["idx"].to_pylist()
        near = _blob(lists["near"], np.int64)
        adjacent = {}
        for i in np.flatnonzero(kind == 1).tolist():
            ids, ends = (np.frombuffer(lists[c][i].as_py(), np.int64) for c in ("ids", "ends"))
            where = np.searchsorted(idx, near[i])
            adjacent.update({v: where[a:b] for v, a, b in zip(ids.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)})
        rows = np.flatnonzero(kind == 0)
        sims, todos, vecs = (lists[n].take(pa.array(rows)).to_pylist() for n in ("sim", "todo", "vec"))
        out = []
        for i, sim, todo, vec in zip(rows.tolist(), sims, todos, vecs, strict=True):
            have, sim, todo = near[i], np.frombuffer(sim, np.float32), np.frombuffer(todo, np.int8)
            seen = np.zeros(len(idx), bool)
            for v in have[todo > 0].tolist():
                seen[adjacent[v]] = True
            where = np.searchsorted(idx, have)
            where[where == len(idx)] = 0
            seen[where[idx[where] == have] if len(idx) else where[:0]] = False
            at = np.flatnonzero(seen)
            new = x[at] @ np.frombuffer(vec, np.float32)
            have, sim = np.concatenate([have, idx[at]]), np.concatenate([sim, new])
            todo = np.concatenate([np.zeros(len(todo), np.int8), np.ones(len(at), np.int8)])
            order = np.lexsort((have, -sim))[:beam]
            out.append((have[order].tobytes(), sim[order].tobytes(), todo[order].tobytes()))
        near, sim, todo = zip(*out, strict=True) if out else ((), (), ())
        blobs = [pa.array(list(c), pa.binary()) for c in (vecs, near, sim, todo)]
        block = lists["qb"].take(pa.array(rows)).cast(pa.int64())
        return pa.table([block, pa.array([node[i] for i in rows.tolist()], pa.int64()), *blobs], ["qb", "idx", "vec", "near", "sim", "todo"])

    return run


def _begun(batches):
    """Each query's beam before the first step: its own node, to be expanded."""
    for batch in batches:
        idx, vec = np.array(batch.column("idx")), batch.column("vec")
        x = _matrix(vec) if len(idx) else np.zeros((0, 1), np.float32)
        blobs = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (idx.astype(np.int64), (x * x).sum(axis=1), np.ones(len(idx), np.int8))]
        yield pa.RecordBatch.from_arrays([batch.column("qb"), batch.column("idx"), vec, *blobs], ["qb", "idx", "vec", "near", "sim", "todo"])


def _asked_by(blocks: np.ndarray, near: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in np.unique(blocks).tolist():
        yield _asking(b, np.unique(np.concatenate([near[i] for i in np.flatnonzero(blocks == b).tolist()])))


def _fringe(batches):
    """What each block of queries asks for: the lists of the nodes to do."""
    for batch in batches:
        near = [x[t > 0] for x, t in zip(_blob(batch.column("near"), np.int64), _blob(batch.column("todo"), np.int8), strict=True)]
        yield from _asked_by(np.array(batch.column("qb")), near)


def _candidates(batches):
    """What each block of queries asks for: the vectors of all nodes in the lists."""
    for batch in batches:
        yield from _asked_by(np.array(batch.column("asker")), _blob(batch.column("near"), np.int64))


def _whole_blocks(table: pa.Table) -> pa.Table:
    x = _matrix(table["vec"])[np.argsort(np.array(table["idx"]))]
    return pa.table([pa.array([table["b"][0].as_py()], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["b", "n", "vec"])


def _nearest_of(count: int):
    def run(batches):
        for batch in batches:
            near = [x[:count] for x in _blob(batch.column("near"), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column("idx")), [len(x) for x in near]), pa.int64()), pa.array(np.concatenate([*near, np.zeros(0, np.int64)]), pa.int64())], ["start", "cand"])

    return run


def _with_signs(batches):
    for batch in batches:
        v = batch.column("v")
        x = np.asarray(v.flatten()).reshape(len(v), -1).astype(np.float32)
        plane = np.random.default_rng(17).standard_normal((x.shape[1], SIGNS)).astype(np.float32)
        code = ((x @ plane) > 0) @ (1 << np.arange(SIGNS - 1, -1, -1))
        yield pa.RecordBatch.from_arrays([v, pa.array([r.tobytes() for r in x], pa.binary()), pa.array(code, pa.int64())], ["v", "vec", "code"])


class Index:
    """A neighbour graph over the vectors of ``table``.

    A vector that is null, empty, zero, or holds a null or non-finite component
    takes no part, nor does a null id; vectors not of the most frequent length
    take no part. Every row is an entry of its own, rows that share an id too.
    """

    def __init__(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, degree: int = DEGREE, changed: float = CHANGED):
        self.spark, self.k, self.degree = table.sparkSession, k, degree
        self.stage = stage = Stage(self.spark, "ann")
        rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
        usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").limit(1).collect()
        self.rows = rows.filter(F.size("v") == (usual[0].d if usual else 0))
        # A node keeps its k + 1 smallest ids, which is all that any list of k can hold.
        place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        members = stage.write(self.rows.withColumn("r", place).filter(F.col("r") <= k + 1), "members")
        nodes = members.filter("r = 1").select("v").mapInArrow(_with_signs, "v array<double>, vec binary, code long")
        self.nodes, self.size = self._numbered(nodes, "nodes", "code", "v")
        self.vectors = stage.write(self.nodes.select("idx", "vec"), "vectors")
        rows = self.vectors.select(F.floor(F.col("idx") / BLOCK).alias("b"), "idx", "vec")
        self.blocks = stage.write(rows.groupBy("b").applyInArrow(_whole_blocks, "b long, n int, vec binary"), "blocks")
        own = members.join(self.nodes.select("v", "idx"), "v").select("idx", "vec_id", "r")
        self.members = stage.write(own.withColumn("copy", F.row_number().over(Window.partitionBy("idx", "vec_id").orderBy("r"))).drop("r"), "members")
        stage.drop(members)
        self.rounds = 0
        graph, fresh, edges = self._start()
        around = self._gathered(graph)
        while fresh > changed * edges:
            graph, fresh, edges = self._round(graph, around)
            around = self._gathered(graph)
            self.rounds += 1
        self.near = around

    def _numbered(self, df: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
        """The rows with their place ``idx`` in an order, and how many there are; one number per task comes back."""
        sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
        written = self.stage.write(sorted_.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
        sizes = sorted((r.part, r.n) for r in written.groupBy("part").agg(F.count("*").alias("n")).collect())
        bases, total = [], 0
        for part, n in sizes:
            bases.append((part, total))
            total += n
        bases = self.spark.createDataFrame(bases, "part int, base long")
        return written.join(F.broadcast(bases), "part").withColumn("idx", F.col("at") + F.col("base")).drop("part", "at", "base"), total

    def _start(self) -> tuple[DataFrame, int, int]:
        """The first edges, from two divisions of the nodes into small groups."""
        per = BLOCK // START_BLOCK
        buckets = per * max(1, -(-self.size // BLOCK))
        near = self.vectors.select(F.lit(0).alias("way"), F.floor(F.col("idx") / BLOCK).alias("key"), F.floor(F.col("idx") / START_BLOCK).alias("sub"), "idx", "vec")
        sub = F.pmod(F.xxhash64("idx"), F.lit(buckets))
        mixed = self.vectors.select(F.lit(1).alias("way"), F.floor(sub / per).alias("key"), sub.alias("sub"), "idx", "vec")
        found = near.unionByName(mixed).groupBy("way", "key").applyInArrow(_first_edges(self.degree // 2), _EDGES)
        return self._graph(found)

    def _graph(self, edges: DataFrame) -> tuple[DataFrame, int, int]:
        """The graph of packed edges, how many of its edges are new, and how many it has."""
        out = self.stage.write(edges.groupBy("b").applyInArrow(_merged(self.degree), f"{_EDGES}, fresh long, edges long"), "graph")
        fresh, edges = out.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.coalesce(F.sum("edges"), F.lit(0))).first()
        return out.drop("fresh", "edges"), fresh, edges

    def _gathered(self, graph: DataFrame) -> DataFrame:
        rows = graph.unionByName(graph.mapInArrow(_reversed, _EDGES))
        return self.stage.write(rows.groupBy("b").applyInArrow(_around(self.degree, REVERSE), _AROUND), "around")

    def _round(self, graph: DataFrame, around: DataFrame) -> tuple[DataFrame, int, int]:
        blocks = self.blocks.join(around.select("b", "least"), "b", "left")
        members = self._vectors(around.mapInArrow(_wanted, _ASKED), blocks)
        found = around.groupBy("b").cogroup(members.groupBy("asker")).applyInArrow(_local_join(PASSED, self.degree), "b long, u binary, c binary, s binary, f binary")
        return self._graph(graph.unionByName(found.withColumn("old", F.lit(0)).select("b", "old", "u", "c", "s", "f")))

    def _vectors(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        return asked.groupBy("owner").cogroup(blocks.groupBy("b")).applyInArrow(_vectors_of, _VECTORS)

    def _beams(self, ask: DataFrame, beam: int) -> DataFrame:
        """(idx, near, ...) of every node that is asked for, once all nodes of its beam are expanded."""
        stage = self.stage
        starts, count = self._numbered(ask.select(F.col("idx").alias("start")).distinct(), "starts", "start")
        most = QUERY_BLOCK if self.size <= TASK_VECTORS else max(1, TASK_VECTORS // (beam * (self.degree + REVERSE)))
        starts = starts.select(F.col("start").alias("idx"), F.floor(F.col("idx") / most).alias("qb"))
        state = stage.write(starts.join(self.vectors, "idx").select("qb", "idx", "vec").mapInArrow(_begun, _STATE), "beam")
        blocks = self.blocks.withColumn("least", F.lit(None).cast("binary"))
        ended, left = None, count
        while left:
            asked = state.select("qb", "near", "todo").mapInArrow(_fringe, _ASKED)
            lists = stage.write(asked.groupBy("owner").cogroup(self.near.groupBy("b")).applyInArrow(_near_of, _NEAR), "lists")
            vectors = self._vectors(lists.select("asker", "near").mapInArrow(_candidates, _ASKED), blocks)
            none = F.lit(None).cast("binary")
            both = state.select(F.lit(0).alias("kind"), "qb", "idx", none.alias("ids"), none.alias("ends"), "vec", "near", "sim", "todo")
            both = both.unionByName(lists.select(F.lit(1).alias("kind"), F.col("asker").alias("qb"), F.lit(None).cast("long").alias("idx"), "ids", "ends", none.alias("vec"), "near", none.alias("sim"), none.alias("todo")))
            after = stage.write(both.groupBy("qb").cogroup(vectors.groupBy("asker")).applyInArrow(_expanded(beam), _STATE), "beam")
            stage.drop(lists)
            open_ = F.instr(F.hex("todo"), "01") > 0
            done = after.filter(~open_)
            ended = done if ended is None else ended.unionByName(done)
            state = after.filter(open_)
            left = state.count()
        return state if ended is None else ended

    def search(self, queries: DataFrame, beam: int = BEAM) -> DataFrame:
        """(query_id, rank, vec_id, score) for the rows of the index whose ids are in ``queries.query_id``.

        An id of several rows is asked once for each of its different vectors.
        """
        k, stage = self.k, self.stage
        ask = self.rows.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").distinct()
        ask = stage.write(ask.join(self.nodes.select("v", "idx"), "v").select(F.col("vec_id").alias("query_id"), "idx"), "ask")
        # Similarities in single precision decide on twice the nodes that are wanted, the exact product on their order.
        pairs = self._beams(ask, max(beam, 2 * (k + 1))).mapInArrow(_nearest_of(2 * (k + 1)), "start long, cand long")
        one = self.nodes.select(F.col("idx").alias("start"), F.col("v").alias("sv"))
        other = self.nodes.select(F.col("idx").alias("cand"), "v")
        product = F.aggregate(F.zip_with("sv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        scored = pairs.join(one, "start").join(other, "cand").select("start", "cand", product.alias("score"))
        best = Window.partitionBy("start").orderBy(F.desc("score"), "vec_id")
        rows = scored.join(self.members.withColumnRenamed("idx", "cand"), "cand").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
        rows = stage.write(rows.select("start", "cand", "vec_id", "copy", "score"), "nearest")
        # Of equal rows with one id, one is the query's own.
        full = ask.join(rows, ask.idx == rows.start).filter((F.col("vec_id") != F.col("query_id")) | (F.col("cand") != F.col("idx")) | (F.col("copy") > 1))
        order = Window.partitionBy("query_id", "idx").orderBy(F.desc("score"), "vec_id")
        return full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int, k: int = 20) -> DataFrame:
    """The k nearest other rows, by inner product, of every row whose id is divisible by ``every``.

    Rows without id or without a usable vector (null, empty, zero, null or
    non-finite components) neither ask nor answer. Rows that share an id each
    answer, and each different vector of a query's id is asked. Columns other
    than the two are not looked at; an empty table gives no rows.
    """
    index = Index(table, k=k)
    return index.search(index.rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")))
