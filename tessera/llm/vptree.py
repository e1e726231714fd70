"""Nearest neighbours by vantage-point trees, one tree for each shard.

Largest inner product becomes smallest distance: with M the largest norm, a vector x gets the extra component
sqrt(M^2 - |x|^2) and a query 0, so distance^2 = |q|^2 + M^2 - 2 q x. Pivots (a bounded, documented number of
vectors with the smallest hashes, not more than there are shards) cut the space: every vector goes to its nearest pivot, and a
pivot's vectors, copies and hot regions alike, are dealt by hash to shards of about ``shard_rows`` (by default 16 MB of
vectors). Every shard gets a tree, stored as one row of a table in the shared folder: all vectors are indexed.

A query first searches the shards of its nearest pivot. With the distance r of its k-th hit so far it then searches
every other shard whose ring of pivot distances [a, b] can hold something nearer: by the triangle inequality nothing
is nearer than max(a - d, d - b), d being its own distance to the pivot. Inside a tree a vantage point prunes alike.
The bound is multiplied by ``factor`` before it is compared: one is exact, more prunes more and may miss. Queries
travel in blocks as large as shards, each to the shards it needs, and walk a tree together, first each to its nearest leaf, then
all through the nodes where they may find more; hits are merged by rank, at most k for each query and shard, in the second
round only those that reach the k-th of the first.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components
take no part. Ties go to the smaller id. Repeated ids are vectors of their own, a query never meets rows of its own id, and
the hits of queries with the same id are merged. Null ids take no part. Fewer than k candidates: all of them. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS, LEAF, LEAF_QUERIES = 32, 1024, 1024
#: Bytes of vectors in a shard and in a block of queries.
TILE_BYTES = 16 << 20
#: Slack for rounding when distances are compared.
EPS = 1e-9
#: Squared norms up to this lose digits and count as this.
TINY = 1e-280
#: Products of unit vectors that differ by less are told apart in double precision only, as single precision has none so small.
LEAST = 1e-30


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    v = v.filter(fine)
    width = v.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return v.filter(F.size("v") == (width["w"] if width else 0))


class Tree:
    """A vantage-point tree in flat arrays: vectors in node order, so every subtree is a slice."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 5):
        self.order: list[np.ndarray] = []
        self.nodes: list[list] = []  # [vantage row, radius, smallest and largest distance inside, same outside, left, right] or leaf slice
        self.x, self.ids = x, ids
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)), rng)
        order = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        self.ids, self.x = ids[order], x[order]
        self.order = []

    def _place(self, rows: np.ndarray) -> int:
        at = sum(len(o) for o in self.order)
        self.order.append(rows)
        return at

    def _build(self, rows: np.ndarray, rng) -> int:
        stack = [(rows, None, 0)]
        while stack:
            part, parent, side = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            if len(part) <= LEAF:
                self.nodes.append(["leaf", self._place(part), len(part)])
                continue
            pick = part[rng.integers(0, len(part), 8)]
            probe = part[rng.integers(0, len(part), 64)]
            spread = [np.var(np.linalg.norm(self.x[probe] - self.x[p], axis=1)) for p in pick]
            vantage = pick[int(np.argmax(spread))]
            d = np.linalg.norm(self.x[part] - self.x[vantage], axis=1)
            order = np.argsort(d, kind="stable")
            half = len(part) // 2
            near, far = order[:half], order[half:]
            self.nodes.append(["node", self.x[vantage], (d[near].min(), d[near].max()), (d[far].min(), d[far].max()), -1, -1])
            stack.append((part[far], me, 5))
            stack.append((part[near], me, 4))
        return 0

    def search(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, product) of the at most k best here for each query that reach its ``least``, all queries walking together.

        A leaf is one matrix product in single precision that gives upper bounds, as each row carries the most that rounding
        can take from a product with it; pairs whose bound reaches the query's k-th so far are summed in double precision and ranked.
        """
        n = len(q_ids)
        best_p = np.full((n, k), -np.inf)
        best_i = np.full((n, k), np.iinfo(np.int64).max)
        qn = (q * q).sum(axis=1)
        far = EPS * (1 + np.sqrt(qn) + np.sqrt(self.m2))
        width = q.shape[1] - 1
        slack = 2 * np.finfo(np.float32).eps * (width + 8)
        scale_q, scale_x = np.sqrt(np.maximum(qn, TINY)), np.sqrt(max(self.m2, TINY))
        norm = np.sqrt(np.maximum((self.x[:, :-1] ** 2).sum(axis=1), TINY)) / scale_x
        above = np.concatenate([self.x[:, :-1] / scale_x, slack * norm[:, None]], axis=1).astype(np.float32)
        unit = np.concatenate([q[:, :-1] / scale_q[:, None], np.ones((n, 1))], axis=1).astype(np.float32)
        twice = (2 * slack * norm).astype(np.float32)  # from an upper to a lower bound
        pairs = max(1, TILE_BYTES // (8 * width))
        floor = least.copy()

        def reach(of: np.ndarray) -> np.ndarray:
            """Distances beyond which nothing reaches the floors."""
            return np.sqrt(np.maximum(qn[of] + self.m2 - 2 * floor[of], 0))

        bound = reach(np.arange(n))
        own_q, own_x = self._own(q_ids)
        place = np.empty(n, np.int64)

        def scan(node: list, who: np.ndarray) -> None:
            start, end = node[1], node[1] + node[2]
            x, ids = self.x[start:end], self.ids[start:end]
            mine = slice(*np.searchsorted(own_x, [start, end]))
            for one in range(0, len(who), LEAF_QUERIES):
                some = who[one : one + LEAF_QUERIES]
                rough = unit[some] @ above[start:end].T
                if mine.start < mine.stop:
                    place.fill(-1)
                    place[some] = np.arange(len(some))
                    row, col = place[own_q[mine]], own_x[mine] - start
                    rough[row[row >= 0], col[row >= 0]] = -np.inf
                enough = (floor[some] / scale_q[some] / scale_x - LEAST).astype(np.float32)
                new = np.isneginf(enough)
                if new.any() and len(x) > k:
                    enough[new] = np.partition(rough[new] - twice[start:end], len(x) - k, axis=1)[:, len(x) - k]
                i, j = np.divmod(np.flatnonzero(rough >= enough[:, None]), len(x))
                fine = ~np.isneginf(rough[i, j])
                i, j = i[fine], j[fine]
                if len(i):
                    cuts = range(0, len(i), pairs)
                    p = np.concatenate([np.einsum("ij,ij->i", q[some[i[c : c + pairs]], :-1], x[j[c : c + pairs], :-1]) for c in cuts])  # the same sum for equal vectors wherever they stand
                    self._merge(best_p, best_i, some, i, p, ids[j])
                    hit = some[np.unique(i)]
                    floor[hit] = np.maximum(floor[hit], best_p[hit, -1])
                    bound[hit] = reach(hit)

        def sides(node: list, who: np.ndarray) -> list[tuple[int, np.ndarray]]:
            """The node's sides with the distance below which they hold nothing."""
            d = np.linalg.norm(q[who] - node[1], axis=1)
            return [(to, np.maximum(np.maximum(ring[0] - d, d - ring[1]), 0)) for ring, to in ((node[2], node[4]), (node[3], node[5]))]

        home = np.full(n, -1)
        down: list[tuple[int, np.ndarray]] = [(0, np.arange(n))] if self.nodes and n and k > 0 else []
        while down:  # every query once, to the leaf that is nearest by the rings: a first floor
            at, who = down.pop()
            if self.nodes[at][0] == "leaf":
                scan(self.nodes[at], who)
                home[who] = at
                continue
            near, far_side = sides(self.nodes[at], who)
            nearer = near[1] <= far_side[1]
            down += [(to, who[m]) for to, m in ((near[0], nearer), (far_side[0], ~nearer)) if m.any()]
        stack: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(n), np.zeros(n))] if self.nodes and n and k > 0 else []
        while stack:  # then every node once, with all queries that may find something in it
            at, who, low = stack.pop()
            keep = (low * factor <= bound[who] + far[who]) & (home[who] != at)
            who, low = who[keep], low[keep]
            if not len(who):
                continue
            if self.nodes[at][0] == "leaf":
                scan(self.nodes[at], who)
                continue
            stack += [(to, who, np.maximum(low, x)) for to, x in sorted(sides(self.nodes[at], who), key=lambda side: -side[1].mean())]
        i, j = np.nonzero((best_p >= least[:, None]) & ~np.isneginf(best_p))
        return i, best_i[i, j], best_p[i, j]

    def _own(self, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, row here) of equal ids, ordered by the row here."""
        order = np.argsort(self.ids, kind="stable")
        first, last = (np.searchsorted(self.ids[order], q_ids, side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, x = np.repeat(np.arange(len(q_ids)), n), order[at]
        by = np.argsort(x, kind="stable")
        return q[by], x[by]

    @staticmethod
    def _merge(best_p: np.ndarray, best_i: np.ndarray, some: np.ndarray, i: np.ndarray, p: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (place in ``some``, ascending; product; id) go into the ranked rows of their queries."""
        k = best_p.shape[1]
        held, n = np.unique(i, return_counts=True)
        row = np.repeat(np.arange(len(held)), n)
        col = k + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        allp = np.full((len(held), k + n.max()), -np.inf)
        alli = np.full(allp.shape, np.iinfo(np.int64).max)
        allp[:, :k], alli[:, :k] = best_p[some[held]], best_i[some[held]]
        allp[row, col], alli[row, col] = p, ids
        o = np.lexsort((alli, -allp), axis=1)[:, :k]
        best_p[some[held]], best_i[some[held]] = np.take_along_axis(allp, o, 1), np.take_along_axis(alli, o, 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def tile_rows(width: int) -> int:
    """Vectors of ``width`` components in a shard or in a block of queries."""
    return max(1, TILE_BYTES // (8 * (width + 1)))


def build(points: DataFrame, pivots: int = PIVOTS, shard_rows: int | None = None) -> tuple[DataFrame, np.ndarray, float]:
    """(index table: shard, pivot, low, high, n, tree), pivots and M^2 of the valid points (id, v)."""
    m2, n, width = points.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")), F.count(F.lit(1)), F.max(F.size("v"))).first()
    m2 = (m2 or 0.0) * (1 + 1e-12)
    shard_rows = shard_rows or tile_rows(width or 1)
    pivots = max(1, min(pivots, -(-n // shard_rows)))  # no more than shards are needed: each tree a query meets costs a row of it and its hits
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    base = np.array([r["v"] for r in chosen])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    centres = lifted(base) if len(chosen) else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = lifted(_matrix(b.column(1)))
                d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d.argmin(axis=1).astype(np.int32))], names=["id", "v", "pivot"])

    assigned = materialize(points.mapInArrow(assign, "id bigint, v array<double>, pivot int"), "vectors")
    sizes = {r["pivot"]: r["count"] for r in assigned.groupBy("pivot").count().collect()}  # one row a pivot
    parts = F.element_at(F.create_map(*[F.lit(x) for p, c in (sizes or {0: 1}).items() for x in (p, -(-c // shard_rows))]), F.col("pivot"))
    dealt = assigned.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts).cast("int"))

    def plant(key, table):
        t = table.sort_by("id")
        x = lifted(_matrix(t["v"].combine_chunks()))
        tree = Tree(t["id"].to_numpy(), x)
        tree.m2 = m2
        d = np.linalg.norm(x - centres[key[0].as_py()], axis=1)
        return pa.table({"shard": [key[0].as_py() * (1 << 32) + key[1].as_py()], "pivot": pa.array([key[0].as_py()], pa.int32()), "low": [d.min()], "high": [d.max()], "n": [len(x)], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    index = dealt.groupBy("pivot", "part").applyInArrow(plant, "shard bigint, pivot int, low double, high double, n bigint, tree binary")
    return materialize(index, "vp-index"), centres, m2


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of ``vectors`` found for each row of ``queries`` but those of its id."""
    points, asked = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    index, centres, m2 = build(points, pivots, shard_rows)
    directory = [tuple(r) for r in index.select("shard", "pivot", "low", "high").collect()]  # one row for each shard of thousands of vectors
    shard = np.array([r[0] for r in directory], np.int64)
    owner = np.array([r[1] for r in directory], np.int64)
    low, high = np.array([r[2] for r in directory], float), np.array([r[3] for r in directory], float)
    block_rows = shard_rows or tile_rows(max(1, centres.shape[1] - 1))

    def route(second: bool):
        """Rows (shard, id, v, least) of the shards a query needs, ``least`` being its k-th product so far: in the first round those of its nearest pivot."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(shard):
                    continue
                q = np.concatenate([_matrix(b.column(1)), np.zeros((b.num_rows, 1))], axis=1)
                d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * q @ centres.T, 0))
                home = np.where(np.isin(np.arange(len(centres)), owner), d, np.inf).argmin(axis=1)
                mine = owner[None, :] == home[:, None]
                least = np.full(b.num_rows, -np.inf)
                if second:
                    least = b.column(2).to_numpy(zero_copy_only=False)
                    qn = (q * q).sum(axis=1)
                    radius = np.sqrt(np.maximum(qn + m2 - 2 * least, 0))
                    dp = d[:, owner]
                    mine = ~mine & (np.maximum(np.maximum(low - dp, dp - high), 0) * factor <= (radius + 1e-6 * (1 + np.sqrt(qn) + np.sqrt(m2)))[:, None])
                i, j = np.nonzero(mine)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(shard[j]), b.column(0).take(take), b.column(1).take(take), pa.array(least[i])], names=["shard", "id", "v", "least"])

        return run

    def look(key, left, right):
        out_q, out_i, out_p = [], [], []
        for packed in right["tree"].to_pylist():
            tree = pickle.loads(packed)
            if left.num_rows:
                q = np.concatenate([_matrix(left["v"].combine_chunks()), np.zeros((left.num_rows, 1))], axis=1)
                ids = left["id"].to_numpy()
                j, i, p = tree.search(ids, q, left["least"].to_numpy(), k, factor)
                out_q.append(ids[j])
                out_i.append(i)
                out_p.append(p)
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table({"query_id": join(out_q, pa.int64()), "id": join(out_i, pa.int64()), "score": join(out_p, pa.float64())})

    def searched(routed: DataFrame, label: str) -> DataFrame:
        """Queries in blocks against the trees they need; a shard's tree goes to each of its blocks."""
        counts = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
        counts, again = (materialize(counts, "query-blocks") for _ in range(2))  # two relations, as both sides of the cogroup use it
        trees = index.select("shard", "tree").join(again, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = routed.join(counts, "shard").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        found = dealt.groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInArrow(look, "query_id bigint, id bigint, score double")
        return materialize(found, label)

    asked = materialize(asked, "queries")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    routed = materialize(asked.mapInArrow(route(False), "shard bigint, id bigint, v array<double>, least double"), "routed")
    first = searched(routed, "first-round")
    kth = first.withColumn("r", F.row_number().over(rank)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")).distinct()
    bounded = asked.join(kth, "id", "left").select("id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    second = materialize(bounded.mapInArrow(route(True), "shard bigint, id bigint, v array<double>, least double"), "routed")
    hits = first.unionByName(searched(second, "second-round"))
    ranked = hits.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
