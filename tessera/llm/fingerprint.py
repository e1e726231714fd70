"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text is cut into paragraphs: runs up to the end of a line or sentence, long ones cut every ``UNIT`` characters from
their start, so an edit leaves what stands before it alone. The set of their XXH64 digests is sketched in ``CELLS``
cells; each digest falls into one cell of each of three rows, and a cell holds a count and the XORs of digests and
of check hashes. The cells in hexadecimal are the fingerprint.

Two versions are compared by subtracting their cells: what they share cancels, and peeling cells that hold a single
digest recovers the paragraphs in which they differ. If peeling gets stuck, the sketch is made again larger: digests
are dealt by hash to about one block of cells for two digests; a block that fails is cut into four, and so on; what
is left after four cuts (two digests alike in all hashes) is counted by set difference. Likeness is shared / all digests.

Everything works within a row except finding the next document: rows are cut into chunks by id (quantiles over all
ids, 256 at least), each with a copy of the first row of the next chunk, and a window looks one row ahead.

Defined results: null text = empty text = no paragraphs; two empty sketches are alike (1.0). Rows come in ascending id,
null ids last, equal ids by text hash; the row after the last is the first. Repeated rows are rows of their own; rows of
one id stay in one chunk. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of cells, and bits of a digest that choose a cell of a row: of a fingerprint, and of a block of a larger sketch.
ROWS, ROW_BITS = 3, 3
BLOCK_ROWS, BLOCK_BITS = 3, 2
CELLS = ROWS << ROW_BITS
#: The most characters of a paragraph.
UNIT = 160
CHUNKS = 256
LOAD = 2.0
LEVELS = 4

def _check(x: str) -> str:
    return f"(xxhash64({x}) & 4294967295L)"


def _empty(rows: int, bits: int, shift: int) -> str:
    """SQL: the cells of an empty sketch. Row t takes ``bits`` bits of a digest: it falls where (digest & m) = v."""
    cells = (f"named_struct('m', {((1 << bits) - 1) << at}L, 'v', {k << at}L)" for at in range(shift, shift + rows * bits, bits) for k in range(1 << bits))
    return f"array({', '.join(cells)})"


def _inside(digests: str) -> str:
    return f"filter({digests}, x -> (x & c.m) = c.v)"


def _cell(n: str, held: str) -> str:
    return f"named_struct('m', c.m, 'v', c.v, 'n', {n}, 'id', aggregate({held}, 0L, (s, x) -> s ^ x), 'ck', aggregate({held}, 0L, (s, x) -> s ^ {_check('x')}))"


def paragraphs(text: str) -> str:
    """SQL: distinct digests of a text's paragraphs."""
    pattern = f"[^\\\\n.!?]{{1,{UNIT}}}[.!?]*|[.!?]+"
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), u -> xxhash64(u)))"


def sketch(digests: str) -> str:
    """SQL: the cells of a set of digests, which is evaluated once."""
    cells = f"transform({_empty(ROWS, ROW_BITS, 0)}, c -> transform(array({_inside('q')}), h -> {_cell('size(h)', 'h')})[0])"
    return f"transform(array({digests}), q -> {cells})[0]"


def difference_sketch(a: str, b: str, level: int) -> str:
    """SQL: the cells of a less those of b, for a block; every level looks at other bits."""
    both = f"named_struct('a', {_inside(a)}, 'b', {_inside(b)})"
    return f"transform({_empty(BLOCK_ROWS, BLOCK_BITS, 8 + 8 * level)}, c -> transform(array({both}), h -> {_cell('size(h.a) - size(h.b)', 'concat(h.a, h.b)')})[0])"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (c, d) -> named_struct('m', c.m, 'v', c.v, 'n', c.n - d.n, 'id', c.id ^ d.id, 'ck', c.ck ^ d.ck))"


def peeled(cells: str, most: str) -> str:
    """SQL: the digests recovered from subtracted cells with their signs, or null if peeling gets stuck. Without a pure cell it is over: later steps do nothing."""
    pure = f"filter(acc.cells, c -> abs(c.n) = 1 and {_check('c.id')} = c.ck)"
    without = f"transform(acc.cells, c -> if((p[0].id & c.m) = c.v, named_struct('m', c.m, 'v', c.v, 'n', c.n - p[0].n, 'id', c.id ^ p[0].id, 'ck', c.ck ^ p[0].ck), c))"
    over = "named_struct('cells', acc.cells, 'found', acc.found, 'over', true)"
    step = f"transform(array({pure}), p -> if(size(p) = 0, {over}, named_struct('cells', {without}, 'found', concat(acc.found, array(named_struct('sign', p[0].n, 'id', p[0].id))), 'over', false)))[0]"
    start = f"named_struct('cells', {cells}, 'found', cast(array() as array<struct<sign:int,id:bigint>>), 'over', false)"
    return f"aggregate(sequence(1, greatest({most}, 1)), {start}, (acc, i) -> if(acc.over, acc, {step}), acc -> if(forall(acc.cells, c -> c.n = 0 and c.id = 0 and c.ck = 0), acc.found, null))"


def _number(found: str) -> str:
    """SQL: how many digests were recovered; -1 if peeling got stuck."""
    return f"transform(array({found}), f -> if(f is null, -1, size(f)))[0]"


def _split(g: str, salt: int, parts: str, k: str) -> str:
    pick = lambda side: f"filter({g}.{side}, x -> pmod(xxhash64(x, {salt}), {parts}) = {k})"
    return f"named_struct('a', {pick('a')}, 'b', {pick('b')})"


def _in_block(g: str, level: int) -> str:
    """SQL: digests in which the sides of block g differ, cut into four where peeling fails. Nothing cancels where a side is empty."""
    found = _number(peeled(difference_sketch(g + ".a", g + ".b", level), f"size({g}.a) + size({g}.b)"))
    if level == LEVELS:
        again = f"size(array_except({g}.a, {g}.b)) + size(array_except({g}.b, {g}.a))"
    else:
        h, k = f"g{level}", f"k{level}"
        again = f"aggregate(sequence(0, 3), 0, (n{level}, {k}) -> n{level} + transform(array({_split(g, 10 + level, '4', k)}), {h} -> {_in_block(h, level + 1)})[0])"
    return f"if(size({g}.a) = 0 or size({g}.b) = 0, size({g}.a) + size({g}.b), transform(array({found}), d{level} -> if(d{level} >= 0, d{level}, {again}))[0])"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: the number of digests in which sets a and b (with their cells) differ, by peeling at growing sizes."""
    small = peeled(subtract(cells_a, cells_b), f"least({CELLS}, size({a}) + size({b}))")
    side = f"cast(ceil(sqrt((size({a}) + size({b})) / {LOAD})) as int)"
    inner = f"aggregate(sequence(0, g.s - 1), 0, (m, k) -> m + transform(array({_split('g', 2, 'g.s', 'k')}), h -> {_in_block('h', 1)})[0])"
    outer = f"named_struct('a', filter({a}, x -> pmod(xxhash64(x, 1), s) = i), 'b', filter({b}, x -> pmod(xxhash64(x, 1), s) = i), 's', s)"
    larger = f"transform(array({side}), s -> aggregate(sequence(0, s - 1), 0, (n, i) -> n + transform(array({outer}), g -> {inner})[0]))[0]"
    return f"transform(array({_number(small)}), d -> if(d >= 0, d, {larger}))[0]"


def likeness(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """Shared over all digests of two sets, 1.0 for two empty ones."""
    d = difference("z.a", "z.b", "z.ca", "z.cb")
    found = f"transform(array({d}), d -> if(z.n = 0, 1D, cast(z.n - d as double) / (z.n + d)))[0]"
    return F.expr(f"transform(array(named_struct('a', {a}, 'b', {b}, 'ca', {cells_a}, 'cb', {cells_b}, 'n', size({a}) + size({b}))), z -> {found})[0]")


def as_text(cells: str) -> Column:
    """Cells in hexadecimal: count, digests and check hashes of each."""
    return F.expr(f"lower(array_join(transform({cells}, c -> concat(lpad(hex(c.n), 6, '0'), lpad(hex(c.id), 16, '0'), lpad(hex(c.ck), 8, '0'))), ''))")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, hash, digests, cells) of every row."""
    return _sketched(_texts(docs, id_col, text_col))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("hash", F.xxhash64("t"))


def _sketched(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digests", F.expr(paragraphs("t"))).withColumn("cells", F.expr(sketch("digests")))


def with_next_first(rows: DataFrame, chunks: int) -> DataFrame:
    """``rows`` (id, t, hash) with ``chunk`` (by quantiles of the ids) and ``copy``: 1 in the copies of each chunk's first row, which
    stand in the chunk before (those of the first chunk in the last)."""
    wanted = rows.filter("id is not null").agg(F.percentile_approx("id", [i / chunks for i in range(1, chunks)], 10_000).alias("q")).first()
    cuts = sorted(set(wanted["q"] or []))
    inside = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("id") >= c)) if cuts else F.lit(0)
    placed = rows.withColumn("chunk", F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(inside)).withColumn("copy", F.lit(0))
    order = F.struct(F.col("id").isNull(), F.coalesce(F.col("id"), F.lit(0)), F.col("hash"))
    first = placed.groupBy("chunk").agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    by_chunk = Window.orderBy("chunk")  # one row a chunk
    everything = by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    copies = first.withColumn("to", F.coalesce(F.lag("chunk").over(by_chunk), F.max("chunk").over(everything)))
    return placed.unionByName(copies.select("r.*", F.col("to").alias("chunk"), F.lit(1).alias("copy")))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """Per row: id, its text and the text whose last quarter gives way to the beginning of the next, cells of both, and likenesses."""
    # as many tasks as chunks: the work after this exchange is far more than its bytes suggest
    rows = _sketched(with_next_first(_texts(docs, id_col, text_col), chunks)).repartition(chunks, "chunk")
    w = Window.partitionBy("chunk").orderBy("copy", F.col("id").asc_nulls_last(), "hash")
    rows = rows.withColumn("next", F.lead(F.struct("t", "digests", "cells")).over(w)).filter("copy = 0")
    rows = rows.withColumn("n_chars", F.length("t").cast("long")).withColumn("edited", F.expr("concat(substring(t, 1, cast(n_chars - n_chars div 4 as int)), substring(next.t, 1, cast(n_chars div 4 as int)))"))
    rows = rows.withColumn("digests2", F.expr(paragraphs("edited"))).withColumn("cells2", F.expr(sketch("digests2")))
    return rows.select(
        F.col("id").alias(id_col), "t", "edited", "n_chars", "cells", "cells2",
        likeness("digests", "digests2", "cells", "cells2").alias("near_edited"), likeness("digests", "next.digests", "cells", "next.cells").alias("near_next"),
    )
