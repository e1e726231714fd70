"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: Characters of text handed to one call of a batch function; longer batches are cut by rows.
BATCH_CHARS = 8_000_000


def with_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The text column with null as the empty text; other columns as they are."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def slices(batch: pa.RecordBatch, text_index: int, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each piece holds about ``limit`` bytes of text (one row at least)."""
    lengths = pc.binary_length(batch.column(text_index)).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lengths):
        n = n or 0
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(
    df: DataFrame, keep: Iterable[str], text_col: str, added: str, setup: Callable[[], Callable[[list[str]], list[pa.Array]]], keep_text: bool = False
) -> DataFrame:
    """``keep`` columns of ``df`` and the ``added`` columns (a DDL string) that a batch function makes of the texts.

    ``setup`` runs once per task and returns the batch function, which takes the texts of some rows (null: empty)
    and returns one Arrow array per added column. An added column replaces a kept one of the same name.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    extra = T.StructType.fromDDL(added)
    new = {f.name for f in extra}
    keep = [c for c in dict.fromkeys(keep) if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    held = [source.schema[c] for c in keep]
    schema = T.StructType([*held, *extra])
    arrow = to_arrow_schema(schema)
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for whole in batches:
            for batch in slices(whole, n_kept):
                made = work(batch.column(n_kept).to_pylist())
                columns = [*(batch.column(i) for i in range(n_kept)), *made]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


__all__ = ["BATCH_CHARS", "map_texts", "materialize", "slices", "with_text"]
