"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Equal vectors are one node, which keeps its smallest ids: as many as any answer can need. Nodes are
dealt into shards by a hash; each shard gets a graph, and a query searches each of them. Inside a
shard vectors are scaled by the greatest norm and get one more component that makes all of them as
long, so that the largest inner product is the nearest point.

Nodes enter a graph in batches, in random order. A greedy search over what is there proposes
neighbours; of these, from the nearest on, each that stays drops those that are ``relax`` times
nearer to it than to the new node, so that edges go in diverse directions. Every edge is offered the
other way too, and a node with too many is pruned alike. Parts that no edge reaches from the entry
points get an entry point of their own. A search keeps a beam of the best nodes found and expands
them in turn; the searches of a batch go in step, as operations on arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestfold.storage import written

DEGREE, SLACK, BEAM, RELAX = 32, 48, 64, 1.2
#: A shard has about SPREAD times the square root of all nodes, so that the work of all searches grows as the power 1.5 of their number, up to LARGEST, for its memory.
SPREAD, LARGEST = 48, 200_000
BLOCK = 4096  # queries that search a shard in one task
_STEP, _EXPAND = 1024, 3


class Graph:
    """Vectors of one shard (rows of equal length 1 in ``x``), the edges of each (-1: none), and where searches enter."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        v = vectors.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", v, v))
        v = v / max(norms.max(initial=0.0), 1e-300)
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", v, v)))
        self.x = np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)
        self.edges = np.full((len(v), SLACK), -1, np.int32) if edges is None else edges
        self.entries = np.zeros(min(1, len(v)), np.int64) if entries is None else entries

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, products) of the best ``width`` nodes that greedy searches find for each row of ``q``, the best first; -1 where there are fewer."""
        n, out = len(q), (np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf, np.float32))
        alive = np.arange(n)
        start = self.entries[None, :].repeat(n, 0)
        product = q @ self.x[self.entries].T
        order = np.argsort(-product, axis=1)[:, :width]
        pad = max(0, width - order.shape[1])
        node = np.pad(np.take_along_axis(start, order, 1), ((0, 0), (0, pad)), constant_values=-1)
        product = np.pad(np.take_along_axis(product, order, 1), ((0, 0), (0, pad)), constant_values=-np.inf)
        open_ = node >= 0
        while len(alive):
            # the best that are not expanded yet stand first, as rows are in order
            rank = np.cumsum(open_, axis=1)
            now = open_ & (rank <= _EXPAND)
            going = now.any(axis=1)
            if not going.all():
                ended = ~going
                out[0][alive[ended]], out[1][alive[ended]] = node[ended], product[ended]
                alive, node, product, open_, now, rank, q = alive[going], node[going], product[going], open_[going], now[going], rank[going], q[going]
                if not len(alive):
                    break
            i, j = np.nonzero(now)
            asked = np.full((len(alive), _EXPAND), -1, np.int64)
            asked[i, rank[i, j] - 1] = node[i, j]
            open_ &= ~now
            near = np.where(asked[:, :, None] >= 0, self.edges[asked], -1).reshape(len(alive), -1).astype(np.int64)
            used = int((near >= 0).sum(axis=1).max(initial=0))
            near = -np.sort(-near, axis=1)[:, :used]
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == node[:, None, :]).any(axis=2)] = -1
            found = np.matmul(self.x[near], q[:, :, None])[:, :, 0]
            found[near < 0] = -np.inf
            node, product, open_ = (np.concatenate(x, axis=1) for x in ((node, near), (product, found), (open_, near >= 0)))
            best = np.argsort(-product, axis=1)[:, :width]
            node, product, open_ = (np.take_along_axis(x, best, 1) for x in (node, product, open_))
        return out

    def pruned(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """(nodes, DEGREE): of the candidates in each row of ``near`` those that relaxed pruning keeps, the nearest first, then -1."""
        product = np.matmul(self.x[near], self.x[nodes][:, :, None])[:, :, 0]
        bad = (near < 0) | (near == nodes[:, None])
        product[bad] = -np.inf
        order = np.argsort(-product, axis=1)
        near, product = np.take_along_axis(near, order, 1), np.take_along_axis(product, order, 1)
        alive = product > -np.inf
        alive[:, 1:] &= near[:, 1:] != near[:, :-1]
        points = self.x[near]
        # squared distances on the unit sphere are 2 - 2 x the product
        drop = RELAX * RELAX * (1 - np.matmul(points, points.transpose(0, 2, 1))) <= (1 - product)[:, None, :]
        out, count = np.full((len(nodes), DEGREE), -1, np.int32), np.zeros(len(nodes), np.int64)
        for c in range(near.shape[1]):
            stays = np.flatnonzero(alive[:, c] & (count < DEGREE))
            out[stays, count[stays]] = near[stays, c]
            count[stays] += 1
            alive[stays] &= ~drop[stays, c]
        return out

    def _offer(self, to: np.ndarray, source: np.ndarray) -> None:
        """Edges from ``to`` to ``source``; nodes that have no room are pruned."""
        product = np.einsum("ij,ij->i", self.x[to], self.x[source])
        order = np.lexsort((-product, to))
        to, source = to[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate([first, [len(to)]])))
        nodes, have = to[first], (self.edges[to[first]] >= 0).sum(axis=1)
        row = np.cumsum(place == 0) - 1
        kept = place < SLACK
        wide = np.full((len(nodes), 2 * SLACK), -1, np.int64)
        wide[:, :SLACK] = self.edges[nodes]
        wide[row[kept], have[row[kept]] + place[kept]] = source[kept]
        full = (wide >= 0).sum(axis=1) > SLACK
        self.edges[nodes[~full]] = wide[~full, :SLACK]
        for lo in range(0, int(full.sum()), _STEP):
            some = np.flatnonzero(full)[lo : lo + _STEP]
            self.edges[nodes[some]] = -1
            self.edges[nodes[some], :DEGREE] = self.pruned(nodes[some], wide[some])

    def build(self, seed: int = 7) -> Graph:
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        self.entries = order[:1].astype(np.int64)
        done = min(1, n)
        while done < n:
            nodes = order[done : done + min(_STEP, done)]
            near, _ = self.beam(self.x[nodes], BEAM)
            # those that come together see each other too, in part
            beside = np.stack([np.roll(nodes, k) for k in range(1, min(len(nodes), 8))], axis=1) if len(nodes) > 1 else nodes[:, None]
            kept = self.pruned(nodes, np.concatenate([near, beside], axis=1))
            self.edges[nodes, :DEGREE] = kept
            i, j = np.nonzero(kept >= 0)
            self._offer(kept[i, j].astype(np.int64), nodes[i])
            done += len(nodes)
        if n:
            self.entries = np.array([int(np.argmax(self.x @ self.x.mean(axis=0)))])
            self._enter_everywhere()
        return self

    def _enter_everywhere(self) -> None:
        seen = np.zeros(len(self.x), bool)
        ask = self.entries
        entries = self.entries.tolist()
        while True:
            seen[ask] = True
            while len(ask):
                found = np.unique(self.edges[ask])
                ask = found[(found >= 0) & ~seen[found]]
                seen[ask] = True
            if seen.all():
                break
            entries.append(int(np.argmin(seen)))
            ask = np.array(entries[-1:])
        self.entries = np.array(entries, np.int64)


def fit_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part, one for each id: of a repeated id the smallest vector.

    Left out: null ids, vectors that are null, empty or zero or hold null or non-finite components,
    and those of another length than most (of equally frequent lengths, the greatest counts).
    """
    v = F.col("vector")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.where(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    if rows.groupBy("vec_id").count().where("count > 1").take(1):
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows


def index(rows: DataFrame, most: int = 21) -> DataFrame:
    """(shard, node, members, vector, links, entry) of (vec_id, vector): a written table, a row for each different vector.

    members: its ``most`` smallest ids, which no other ids of the same vector can come before.
    """
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= most)
    nodes = written(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "vectors")
    n = nodes.count()
    each = min(LARGEST, max(256, math.ceil(SPREAD * math.sqrt(n))))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(max(1, math.ceil(n / each)))).cast("int"))

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        members = part.column("members").combine_chunks()
        order = pa.array(np.argsort(members.flatten().take(members.offsets[:-1]).to_numpy(), kind="stable"))
        part = part.take(order)
        graph = Graph(_matrix(part.column("vector"))).build()
        counts = (graph.edges >= 0).sum(axis=1)
        links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(graph.edges[graph.edges >= 0], pa.int32()))
        entry = np.isin(np.arange(len(part)), graph.entries)
        return pa.table([part.column("shard"), pa.array(np.arange(len(part)), pa.int32()), part.column("members"), part.column("vector"), links, pa.array(entry)], ["shard", "node", "members", "vector", "links", "entry"])

    made = dealt.groupBy("shard").applyInArrow(run, "shard int, node int, members array<long>, vector array<double>, links array<int>, entry boolean")
    return written(made, "graphs")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    one = column.combine_chunks()
    return one.flatten().to_numpy().reshape(len(one), -1)


def search(found: DataFrame, queries: DataFrame, k: int = 20, beam: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``queries`` (vec_id, vector) the ``k`` rows of the largest inner product that searches of all shards found, but itself.

    ``found`` is what ``index`` gives, for ``most`` over ``k``. score is the inner product of the
    vectors as given, in double precision; of equal scores the smaller id comes first. Shards of up
    to ``beam`` nodes are compared in full, so where there are fewer than k others all are given.
    """
    spark = found.sparkSession
    shards = found.select("shard").distinct().count()
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    there = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(q: pa.Table, part: pa.Table) -> pa.Table:
        rows = []
        if len(q) and len(part):
            part = part.sort_by("node")
            vectors, ids, asks = _matrix(part.column("vector")), part.column("members").to_pylist(), _matrix(q.column("vector"))
            links, edges = part.column("links").combine_chunks(), np.full((len(part), SLACK), -1, np.int32)
            counts = np.diff(links.offsets.to_numpy())
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            edges[np.repeat(np.arange(len(part)), counts), at] = links.flatten().to_numpy()
            graph = Graph(vectors, edges, np.flatnonzero(part.column("entry").to_numpy(zero_copy_only=False)))
            wide = np.concatenate([asks, np.zeros((len(asks), 1))], axis=1)
            wide = (wide / np.abs(wide).max(axis=1, keepdims=True)).astype(np.float32)
            for lo in range(0, len(asks), _STEP):
                some = asks[lo : lo + _STEP]
                near = np.arange(len(part))[None, :].repeat(len(some), 0) if len(part) <= beam else graph.beam(wide[lo : lo + _STEP], beam)[0]
                for query, own, v in zip(q.column("query_id")[lo : lo + _STEP].to_pylist(), near, some, strict=True):
                    own = own[own >= 0]
                    best = sorted(((-s, i) for s, node in zip((vectors[own] * v).sum(axis=1).tolist(), own.tolist(), strict=True) for i in ids[node] if i != query))[:k]
                    rows.append((query, [i for _, i in best], [-s for s, _ in best]))
        names = ["query_id", "ids", "scores"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), kinds, strict=True)], names)

    got = asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(run, "query_id long, ids array<long>, scores array<double>")
    each = got.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("o")).select("query_id", "o.vec_id", "o.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
