"""Mixing sources to target weights, with DataFrame functions only.

Sources are ranked by code point (null last) and weigh as the repeating pattern of weights says. They share the size
of the whole corpus by weight; a target stops at ``cap`` times its source's size and the excess is shared again by
weight (water filling, solved in one sorted pass over the sources).

The words of each source, its documents in hash order, are packed into blocks of ``block_words`` words; a document
may span blocks and a block may hold several documents; the last block of a source may be shorter. A source gets a
slot for every block in each whole pass of its target, and for the rest the nearest number of blocks, so its words are
within one and a half blocks of its target and no block is read more than ``cap`` times. Each slot is dealt to an output shard by a
hash, so the counts of the sources in a shard are multinomial with the target shares, given the totals. The k-th
slot of a source reads, in its pass k div blocks, the block at a pseudorandom permutation of k mod blocks: passes
differ, and no block is read again before all others have been. Slots and blocks are joined by index.

Positions within a source come from sums in two levels (4096 hash chunks per source, then the chunks), so the largest
source is never in one task. The window over sources holds one row per source.

Defined results: null text = empty text = size 0; such rows take 0 words. Repeated rows are rows of their own. With
all sizes 0 every target is 0. An empty table gives an empty table. Runs agree: nothing depends on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
CHUNK_BITS = 12
#: Slots generated by one row of a task, such rows in a task on average, and the most tasks.
SEGMENT, SEGMENTS, TASKS = 1 << 13, 16, 20_000
#: Steps of the permutation's cycle walk; each ends with a chance of one half at least, so few need more than ``SHORT_WALK``.
WALK, SHORT_WALK = 64, 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, weight, rank, target) of a table (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    full = F.col("source_size") * float(cap)
    order = Window.orderBy(full / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = weighed.withColumn("__level", level).withColumn("__n", F.row_number().over(order))
    # the first source, by cap to weight, that stays below its cap sets the level for all that do
    filled = filled.withColumn("__open", F.when(F.col("__level") * F.col("weight") <= full, F.struct("__n", "__level")))
    filled = filled.withColumn("__final", F.coalesce(F.min("__open").over(everything)["__level"], F.lit(0.0)))
    return filled.select("source", "source_size", "weight", "rank", F.least(full, F.col("__final") * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 (n up to 2^40) by ``key``: rounds of multiply and shift on the next power
    of two, walked until the value falls below n."""
    bits = F.greatest(F.lit(1), F.length(F.bin(n - 1)))
    made = F.struct(
        x.alias("x"), n.alias("n"), (F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long") - 1).alias("m"), ((bits + 1) / 2).cast("int").alias("s"),
        F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: (F.xxhash64(key, i).bitwiseAND(F.lit((1 << 20) - 1)) * 2 + 1)).alias("a"),
        F.xxhash64(key, F.lit("shift")).bitwiseAND(F.lit((1 << 40) - 1)).alias("c"),
    )

    def step(y: Column, p: Column) -> Column:
        def turn(t: Column, a: Column) -> Column:
            z = (t * a + p["c"]).bitwiseAND(p["m"])
            return z.bitwiseXOR(F.call_function("shiftright", z, p["s"]))

        return F.aggregate(p["a"], y, turn)

    def go(y: Column, steps: int, p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y, lambda z, _: F.when(z < p["n"], z).otherwise(step(z, p)))

    def walk(p: Column) -> Column:
        def rest(y: Column) -> Column:
            end = F.transform(F.array(go(y, WALK - SHORT_WALK, p)), lambda z: F.when(z < p["n"], z).otherwise(F.raise_error(F.lit("permutation walk did not end")).cast("long")))[0]
            return F.when(y < p["n"], y).otherwise(end)

        return F.transform(F.array(go(step(p["x"], p), SHORT_WALK, p)), rest)[0]

    return F.transform(F.array(made), walk)[0]


@dataclass
class Mix:
    """``documents``: one row per input row with ``rank``, ``chunk``, ``row`` (its key), ``size`` and ``from`` (its first
    word's place in its source); ``sources``: targets, blocks and slots; ``slots``: (rank, slot, shard, block)."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int

    @property
    def pieces(self) -> DataFrame:
        """(rank, chunk, row, size, block, skip, words): the part of a row that lies in a block; a row of size 0 has one without a block."""
        b = self.block_words
        start, end = F.col("from"), F.col("from") + F.col("size")
        rows = self.documents.select("rank", "chunk", "row", "size", "from", F.when(F.col("size") > 0, F.sequence(F.floor(start / b), F.floor((end - 1) / b))).alias("blocks"))
        cut = rows.withColumn("block", F.explode_outer("blocks"))
        low, high = F.greatest(start, F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
        return cut.select("rank", "chunk", "row", "size", "block", (low - start).alias("skip"), (high - low).alias("words"))

    def times(self) -> DataFrame:
        """Pieces with the number of slots that read their block."""
        read = self.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
        # the planner takes generated slots for a handful of rows and would broadcast their counts: they grow with the corpus
        return self.pieces.join(read.hint("merge"), ["rank", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """(rank, chunk, row, taken): the words the mix takes of each row, repeats counted."""
        return self.times().groupBy("rank", "chunk", "row").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 32, shards: int = 64, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep=()) -> Mix:
    """The mix of all rows of ``docs``; ``keep`` columns stay in ``documents`` under their names."""
    base = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), size_of(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, *keep])]).alias("kept"),
    )
    base = materialize(base, "sizes")
    by_block = F.ceil(F.col("source_size") / block_words).cast("long")
    sources = targets(base.select(F.col("__source").alias("source"), "size"), weights, cap)
    sources = sources.withColumn("blocks", by_block).withColumn(
        "__passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    rest = F.least(F.rint((F.col("target") - F.col("__passes") * F.col("source_size")) / block_words), F.col("blocks")).cast("long")
    sources = sources.withColumn("slots", F.col("__passes") * F.col("blocks") + rest).drop("__passes")
    sources = materialize(sources, "sources")
    ranked = base.join(sources.select("source", "rank"), base["__source"].eqNullSafe(F.col("source"))).drop("source")
    ranked = ranked.withColumn("chunk", F.shiftrightunsigned("hash", 64 - CHUNK_BITS))
    sums = ranked.groupBy("rank", "chunk").agg(F.sum("size").alias("n"))
    bases = sums.select("rank", "chunk", (F.sum("n").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("n")).alias("base"))
    w = Window.partitionBy("rank", "chunk").orderBy("hash", "__id")
    placed = ranked.withColumn("row", F.row_number().over(w)).withColumn("__run", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    documents = placed.join(bases.hint("merge"), ["rank", "chunk"]).select("rank", "chunk", "row", "size", (F.col("base") + F.col("__run")).alias("from"), "kept")
    documents = materialize(documents, "placed")
    segments = sources.filter("slots > 0").select("rank", "blocks", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SEGMENT))).alias("segment"))
    # a stated number of tasks: adaptive execution would put these few small rows into one task, which then draws every slot
    n_segments = sources.agg(F.coalesce(F.sum(F.ceil(F.col("slots") / SEGMENT)), F.lit(0))).first()[0]
    segments = segments.repartition(max(1, min(TASKS, -(-int(n_segments) // SEGMENTS))), "rank", "segment")
    last = F.least((F.col("segment") + 1) * SEGMENT, F.col("slots")) - 1
    drawn = segments.select("rank", "blocks", F.explode(F.sequence(F.col("segment") * SEGMENT, last)).alias("slot"))
    slots = drawn.select(
        "rank", "slot", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "rank", "slot"), F.lit(shards)).cast("int").alias("shard"),
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("rank"), F.floor(F.col("slot") / F.col("blocks")))).alias("block"),
    )
    return Mix(documents, sources, slots, block_words)


def accounts(mixed: Mix) -> DataFrame:
    """Per input row: id, size, source_size, target, taken."""
    known = mixed.documents.select("rank", "chunk", "row", "size", "kept.*")
    return known.join(mixed.taken().hint("merge"), ["rank", "chunk", "row"]).join(mixed.sources.select("rank", "source_size", "target"), "rank")


def block_texts(mixed: Mix, text: str = "text") -> DataFrame:
    """(shard, rank, slot, text): the words of every slot's block; needs ``text`` among the kept columns."""
    words = F.expr("filter(split(coalesce(t, ''), '" + BLANK.replace("\\", "\\\\") + "'), w -> w != '')")
    texts = mixed.documents.select("rank", "chunk", "row", F.col(f"kept.{text}").alias("t"))
    cut = mixed.pieces.filter("words > 0").join(texts.hint("merge"), ["rank", "chunk", "row"])
    cut = cut.select("rank", "block", "chunk", "row", F.slice(words, (F.col("skip") + 1).cast("int"), F.col("words").cast("int")).alias("w"))
    joined = cut.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("chunk", "row", "w"))).alias("p"))
    joined = joined.select("rank", "block", F.expr("array_join(flatten(transform(p, x -> x.w)), ' ')").alias("text"))
    return mixed.slots.join(joined.hint("merge"), ["rank", "block"]).select("shard", "rank", "slot", "text")


def remixed(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """``docs`` as the mix takes it, same columns: a row is repeated for every time that all its blocks are read, and once
    more with the words of the blocks that are read once more (joined by blanks, length column renewed). Rows of size 0
    and rows without a block read are left out."""
    columns = docs.columns
    mixed = mix(docs, text_col=text_col, keep=columns, **options)
    per = mixed.times().filter("words > 0").groupBy("rank", "chunk", "row").agg(
        F.min("times").alias("full"), F.collect_list(F.struct("skip", "words", "times")).alias("parts")
    ).withColumn("parts", F.expr("array_sort(filter(parts, p -> p.times > full))")).filter("full > 0 or size(parts) > 0")
    rows = mixed.documents.select("rank", "chunk", "row", "kept").join(per.hint("merge"), ["rank", "chunk", "row"])
    copies = F.expr("filter(sequence(0, cast(full as int)), i -> i > 0 or size(parts) > 0)")  # 0: the partial repeat
    out = rows.withColumn("__copy", F.explode(copies))
    words = "filter(split(coalesce(kept.`" + text_col + "`, ''), '" + BLANK.replace("\\", "\\\\") + "'), w -> w != '')"
    part = F.expr(f"transform(array({words}), ws -> array_join(flatten(transform(parts, p -> slice(ws, cast(p.skip as int) + 1, cast(p.words as int)))), ' '))[0]")
    out = out.withColumn("__text", F.when(F.col("__copy") > 0, F.col(f"kept.`{text_col}`")).otherwise(part))
    made = []
    for c in columns:
        if c == text_col:
            made.append(F.col("__text").alias(c))
        elif c == chars_col:
            made.append(F.when(F.col("__copy") > 0, F.col(f"kept.`{c}`")).otherwise(F.length("__text").cast(dict(docs.dtypes)[c])).alias(c))
        else:
            made.append(F.col(f"kept.`{c}`").alias(c))
    return out.select(*made)
