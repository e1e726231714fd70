"""SimHash near copies by the general pigeonhole principle.

A text becomes a 64-bit fingerprint of its word shingles (XXH64, seed 42, of the space-joined words). Fingerprints
that differ in at most ``radius`` bits are linked, and texts in one connected component form a group.

Search over the distinct fingerprints, which stand for all their copies:

1. Bit co-occurrence counts of all fingerprints give correlations; correlated bits are put into the same of ``m``
   partitions, so that partitions are as unlike each other as possible.
2. If x and y differ in at most ``radius`` bits and thresholds t_1..t_m (each -1 or more, -1: never probed) add up
   to radius - m + 1, they differ in at most t_i bits in some partition i. Each fingerprint gets its own thresholds
   by dynamic programming: the allocation with the fewest expected candidates plus probes. Expectations come from
   histograms of half partitions over all fingerprints.
3. Every fingerprint is filed under its own value in each partition and probes all values within t_i bits. Probe and
   file rows meet in one shuffle by (partition, value); a value filed very often is cut into blocks, and its
   probes go to each block. Candidates are verified in full, and a task hands on a spanning forest of the links it
   finds, never all pairs of a group.
4. Components of the forest by alternating large-star and small-star steps, each written to the shared folder.

Defined results: null text = empty text = fingerprint zero, linked like any other. A null id keeps its row; it is
the component's id only where all ids are null. Repeated rows stay and share their component. An empty table gives
an empty table. Extra columns are ignored unless kept by the caller.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

SEED = 42
#: File rows of one partition value in one block; more are cut into blocks.
BLOCK = 4096
PAIRS = 1 << 20
PARTITIONS = 3
#: Weight of a probe row against a candidate check in the cost that the thresholds minimise.
PROBE_COST = 4.0


def shingles(text: str, words: int = 4) -> np.ndarray:
    """Hashes of the word shingles in order; of all words, if there are fewer than a shingle has."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))] if w else [], dtype=">u8")


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits; a bit is 1 if it is set in more than half of the shingle hashes."""
    return majority(shingles(text, words))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``: the fingerprint as a signed 64-bit integer."""

    def setup():
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return map_texts(docs, keep, text_col, "fp bigint", setup)


# ---------------------------------------------------------------------------------------------- partition plan


def _sums(fps: DataFrame, schema: str, part) -> dict:
    """Sum over all fingerprints of small integer tables made per batch: {(table, cell): sum}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            t = part(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total = t if total is None else total + t
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r["cell"]: r["n"] for r in rows}  # at most 4096 or 64 * 2048 / 11 cells


def correlations(fps: DataFrame) -> tuple[np.ndarray, int]:
    """Absolute correlation of each pair of bits over all fingerprints, and their number."""

    def part(x: np.ndarray) -> np.ndarray:
        bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        out = np.zeros(64 * 64 + 1, np.int64)
        out[:-1] = np.rint(bits.T @ bits).astype(np.int64).ravel()
        out[-1] = len(x)
        return out

    sums = _sums(fps, "cell bigint, n bigint", part)
    n = int(sums.get(4096, 0))
    both = np.array([sums.get(i, 0) for i in range(4096)], float).reshape(64, 64) / max(n, 1)
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread)), n


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of nearly equal width; each starts with a free bit and takes the bits most correlated with it."""
    free, out = set(range(64)), []
    for k in range(m):
        width = (len(free) + (m - k) - 1) // (m - k)
        first = max(sorted(free), key=lambda b: sum(corr[b, c] for c in free))
        chosen = [first]
        free.remove(first)
        while len(chosen) < width:
            best = max(sorted(free), key=lambda b: sum(corr[b, c] for c in chosen))
            chosen.append(best)
            free.remove(best)
        out.append(sorted(chosen))
    return out


def gather(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint as one number."""
    out = np.zeros(len(x), np.uint64)
    for i, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def halves(bits: list[int]) -> list[list[int]]:
    """A partition's bits in runs of at most 11."""
    k = (len(bits) + 10) // 11
    return [bits[i * len(bits) // k : (i + 1) * len(bits) // k] for i in range(k)]


class Plan:
    """Partitions and, for each run of bits, how many fingerprints lie at each distance from each of its values."""

    def __init__(self, groups: list[list[int]], n: int, radius: int, near: list[list[np.ndarray]]):
        self.groups, self.n, self.radius, self.near = groups, n, radius, near
        m, total = len(groups), radius - len(groups) + 1
        self.top = total + m - 1  # the others at -1
        self.masks = []
        for bits in groups:
            by_distance = []
            for e in range(self.top + 1):
                by_distance.append(np.array([sum(1 << c for c in cs) for cs in itertools.combinations(range(len(bits)), e)], np.uint64) if e <= 2 else None)
            self.masks.append(by_distance)
        self.most = [2] * m  # no partition is probed further than two bits
        self.total = total

    def expected(self, x: np.ndarray, i: int) -> np.ndarray:
        """Cost of thresholds -1, 0, 1, 2 in partition i for each fingerprint: probes and expected candidates."""
        share = None
        for bits, near in zip(halves(self.groups[i]), self.near[i]):
            d = near[gather(x, bits).astype(np.int64)] / max(self.n, 1)
            if share is None:
                share = d
            else:
                share = np.stack([sum(share[:, a] * d[:, e - a] for a in range(e + 1)) for e in range(3)], axis=1)
        candidates = np.cumsum(share, axis=1) * self.n
        probes = np.cumsum([len(self.masks[i][e]) if e < len(self.masks[i]) else 0 for e in range(3)])
        out = np.full((len(x), 4), np.inf)
        out[:, 0] = 0
        for t in range(3):
            if t <= self.top:
                out[:, t + 1] = candidates[:, t] + PROBE_COST * probes[t]
        return out

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        """The cheapest allocation of each fingerprint, by dynamic programming over partitions and the sum so far."""
        m = len(self.groups)
        size = self.total + 3 * m + 1  # sums -m .. total + 2 m, shifted by m
        best = np.full((len(x), size), np.inf)
        best[:, m] = 0
        came = np.zeros((m, len(x), size), np.int8)
        for i in range(m):
            cost, nxt = self.expected(x, i), np.full((len(x), size), np.inf)
            for t in range(-1, 3):
                for s in range(size):
                    if 0 <= s - t < size:
                        c = best[:, s - t] + cost[:, t + 1]
                        better = c < nxt[:, s]
                        nxt[better, s] = c[better]
                        came[i, better, s] = t
            best = nxt
        out, s = np.zeros((len(x), m), np.int8), np.full(len(x), self.total + m)
        for i in range(m - 1, -1, -1):
            out[:, i] = came[i, np.arange(len(x)), s]
            s = s - out[:, i]
        return out

    def rows(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(partition, values, fingerprints, kind): kind 0 files, kind 1 probes, kind 2 files and probes its own value."""
        t = self.thresholds(x)
        for i, bits in enumerate(self.groups):
            value = gather(x, bits)
            yield i, value, x, np.where(t[:, i] >= 0, 2, 0).astype(np.int8)
            for e in (1, 2):
                who = t[:, i] >= e
                if who.any():
                    masks = self.masks[i][e]
                    for a in range(0, int(who.sum()), max(1, (1 << 20) // len(masks))):
                        xs, vs = x[who][a : a + (1 << 20) // len(masks)], value[who][a : a + (1 << 20) // len(masks)]
                        yield i, (vs[:, None] ^ masks).ravel(), np.repeat(xs, len(masks)), np.ones(len(xs) * len(masks), np.int8)


def plan_search(fps: DataFrame, radius: int) -> Plan:
    """Statistics over all distinct fingerprints, and the partitions they call for.

    The number of partitions depends on the radius alone: three, or as many as thresholds of two bits need. Fewer
    partitions are wider, so a value is shared by fewer strangers, at the price of more probes.
    """
    corr, n = correlations(fps)
    groups = group_bits(corr, max(PARTITIONS, radius // 3 + 1))
    runs = [(i, j, bits) for i, g in enumerate(groups) for j, bits in enumerate(halves(g))]

    def part(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(gather(x, bits).astype(np.int64), minlength=2048) for _, _, bits in runs])

    sums = _sums(fps, "cell bigint, n bigint", part)
    near: list[list[np.ndarray]] = [[] for _ in groups]
    for k, (i, _, bits) in enumerate(runs):
        count = np.array([sums.get(k * 2048 + v, 0) for v in range(1 << len(bits))], float)
        v = np.arange(len(count))
        at = [count, sum(count[v ^ (1 << a)] for a in range(len(bits))), sum((count[v ^ (1 << a) ^ (1 << b)] for a, b in itertools.combinations(range(len(bits)), 2)), np.zeros(len(count)))]
        near[i].append(np.stack(at, axis=1))
    return Plan(groups, n, radius, near)


# ------------------------------------------------------------------------------------------------------- search


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b): every other member and the smallest member."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


class _Links:
    """Links found by a task, held as a forest of bounded size."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)

    def take(self) -> pa.RecordBatch | None:
        if not self.n:
            return None
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _verify(radius: int):
    """Batch function over rows sorted by (partition, block, value, kind descending): links of each value's probes and files."""

    def pairs(probe: np.ndarray, start: np.ndarray, count: np.ndarray, files: np.ndarray, links: _Links) -> None:
        ends = np.cumsum(count)
        a = 0
        while a < len(probe):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            c = count[a:b]
            p = np.repeat(probe[a:b], c)
            j = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[a:b], c)
            q = files[j]
            near = (np.bitwise_count(p ^ q) <= radius) & (p != q)
            links.add(p[near].view(np.int64), q[near].view(np.int64))
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _Links()
        key, filed = None, np.zeros(0, np.uint64)  # the value whose rows continue, and what is filed under it
        for batch in batches:
            if not batch.num_rows:
                continue
            part, block, value, fp, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            fp = fp.view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (value[1:] != value[:-1])
            new[0] = key != (part[0], block[0], value[0])
            group = np.cumsum(new) - new[0]  # index of each row's value in this batch; with a continued one first
            is_file, is_probe = kind != 1, kind != 0
            carried = filed if not new[0] else np.zeros(0, np.uint64)
            files = np.concatenate([carried, fp[is_file]])
            n_groups = int(group[-1]) + 1
            per = np.bincount(group[is_file], minlength=n_groups)
            per[0] += len(carried)
            first = np.cumsum(per) - per
            # probes meet what is filed; files come first within a value, and a file row in a later batch meets the earlier ones by its own probe
            g = group[is_probe]
            some = per[g] > 0
            pairs(fp[is_probe][some], first[g][some], per[g][some], files, links)
            if len(carried) and per[0] > len(carried):  # file rows that came after carried ones: the carried ones probed before them
                later = files[len(carried) : per[0]]
                pairs(later, np.zeros(len(later), np.int64), np.full(len(later), len(carried)), files, links)
            filed = files[first[-1] : first[-1] + per[-1]]
            key = (part[-1], block[-1], value[-1])
            if links.n > PAIRS:
                yield links.take()
        if (rest := links.take()) is not None:
            yield rest

    return run


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    spark = fps.sparkSession
    plan = spark.sparkContext.broadcast(plan_search(fps, radius))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, value, x, kind in plan.value.rows(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                for a in range(0, len(x), 1 << 17):
                    s = slice(a, a + (1 << 17))
                    n = len(x[s])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, i, np.int32)), pa.array(value[s].view(np.int64)), pa.array(x[s].view(np.int64)), pa.array(kind[s].astype(np.int32))],
                        names=["part", "value", "fp", "kind"],
                    )

    rows = fps.select("fp").mapInArrow(emit, "part int, value bigint, fp bigint, kind int")
    # Values filed more than BLOCK times: counted from the fingerprints alone, a few rows for each.
    bits = plan.value.groups

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, g in enumerate(bits):
                v, n = np.unique(gather(x, g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], names=["part", "value", "n"])

    often = (
        fps.select("fp").mapInArrow(filed, "part int, value bigint, n bigint")
        .groupBy("part", "value").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK)
        .select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    often = materialize(often, "often")
    own = (F.xxhash64("fp") % F.col("blocks")).cast("int")
    own = F.when(own < 0, own + F.col("blocks")).otherwise(own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # kind 2 in its own block stays 2; in the other blocks it only probes
    dealt = (
        rows.join(often, ["part", "value"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("kind") == 0, F.array(own)).otherwise(every)))
        .withColumn("kind", F.when((F.col("kind") == 2) & (F.col("block") != own), F.lit(1)).otherwise(F.col("kind")))
        .select("part", "block", "value", "fp", "kind")
    )
    sorted_ = dealt.repartition("part", "block", "value").sortWithinPartitions("part", "block", "value", (F.col("kind") == 1))
    return sorted_.mapInArrow(_verify(radius), "a bigint, b bigint")


# --------------------------------------------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component."""
    both = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = materialize(both, "links")
    mark = None
    while True:
        # large star: neighbours above a node move to its smallest neighbour
        sides = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        # small star: a node and its neighbours below move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        star = materialize(small, "small-star")
        sums = star.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(sums) == mark:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(sums)


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """``keep``, id, ``fp`` and ``component_id`` (smallest id of the component) of every row."""
    marked = materialize(fingerprints(docs, words, text_col, [id_col, *keep]), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("__first")), "distinct-fingerprints")
    found = components(links(distinct, radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "__first", F.coalesce("root", "fp").alias("__root"))
    names = rooted.groupBy("__root").agg(F.min("__first").alias("component_id"))
    named = rooted.join(names, "__root").select("fp", "component_id")
    return marked.drop(*[c for c in ("component_id",) if c in marked.columns]).join(named, "fp", "left")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, columns unchanged.

    It is the row with the smallest id (null ids last), of these the one with the smallest hash over all columns, so
    ids that stand for several texts neither lose a component nor make reruns differ.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))]  # no name of the caller meets one of the operator
    id_own, text_own = own[docs.columns.index(id_col)], own[docs.columns.index(text_col)]
    rows = docs.toDF(*own).withColumn("__row", F.xxhash64(F.struct(*own)))
    marked = materialize(fingerprints(rows, words, text_own, [id_own, "__row"]), "fingerprints")
    distinct = materialize(marked.select("fp").distinct(), "distinct-fingerprints")
    return _survivors(rows, marked, "fp", components(links(distinct, radius)), id_own).toDF(*docs.columns)


def _survivors(rows: DataFrame, marked: DataFrame, key: str, found: DataFrame, id_col: str) -> DataFrame:
    """The first row of each component: ``marked`` has the id, ``__row`` and node (``key``) of each row, ``found`` (node, root)."""
    named = found.select(F.col("node").alias(key), F.col("root").alias("__root"))
    rooted = marked.join(named, key, "left").withColumn("__root", F.coalesce("__root", key))
    order = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    first = rooted.groupBy("__root").agg(F.min(order).alias("x")).select(F.col("x.row").alias("__row"))
    return rows.join(first, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
