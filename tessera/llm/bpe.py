"""Byte-level BPE with the tiktoken library: encoding to ids and decoding to raw bytes.

The rank file is a local file on every machine (base64 token and rank per line). Texts over ``piece_chars``
characters are cut where the pre-splitting pattern cannot match across: before a blank or line feed that
follows a character that is no white space. The ids of the parts joined are those of the whole text, and one
match of the pattern is never longer than the part it stands in.

Defined results: null text = empty text = no ids, zero tokens, empty decoded bytes. Repeated rows give repeated
rows. An empty table gives an empty table. Only ``keep`` columns are carried; a kept column called ``ids`` or
``decoded`` is replaced by the operator's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

PIECE_CHARS = 1 << 16


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, once per process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of about ``piece_chars``; a stretch without one stays whole."""
    start = 0
    while len(text) - start > piece_chars:
        cut = start + piece_chars
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(enc, text: str, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    parts = [np.array(enc.encode_ordinary(p), dtype="<u4") for p in safe_parts(text, piece_chars)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: Iterable[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` (binary: little-endian unsigned 32-bit ids), ``n_tokens`` and, when asked, ``decoded`` bytes."""

    def setup():
        enc = encoding(rank_file, pattern)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = [encode_text(enc, t) for t in texts]
            made = [pa.array([a.tobytes() for a in ids], pa.binary()), pa.array([len(a) for a in ids], pa.int64())]
            if decoded:
                made.append(pa.array([enc.decode_bytes(a.tolist()) for a in ids], pa.binary()))
            return made

        return work

    return map_texts(docs, keep, text_col, "ids binary, n_tokens bigint" + ", decoded binary" * decoded, setup)


def decode(rows: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``: the raw bytes of packed ids (null ids: no bytes)."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = [c for c in dict.fromkeys(keep) if c != "decoded"]
    source = rows.select(*keep, ids_col)
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("decoded", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(out, pa.binary())], schema=arrow)

    return source.mapInArrow(run, schema)
