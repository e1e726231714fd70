"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often ids meet.

A (a byte-level BPE file of the tokenizers library) encodes blank + text, B (a sentencepiece model, which adds the
blank itself) the text, both without special tokens. Tokens have byte ends; where an A and a B token end together a
group ends. The two end arrays are walked by diagonal run skipping: while they agree at the current index shift, runs of
one-to-one tokens are compared in stretches of doubling length, which shrink again at the first that differs; the
irregular group there is resolved by itself, token by token, which gives its links and the next shift.

A link is a pair of token occurrences whose bytes overlap. Its count is how many links of the corpus have the same ids.

1. Batches of texts (about ``CHUNK_BYTES``) are aligned. A batch becomes one row of its documents' figures and, for each
   of ``buckets`` hash buckets of id pairs, one row with the distinct (pair, document, times) of the bucket, packed.
2. The rows are read once for the counts: summed in the task, then by (A id, B id) in a shuffle.
3. Counts and packed rows meet in a shuffle by bucket. A task reads a bucket's counts, then its packed rows one after
   another, and gives each the sums of its documents. No more is held than one bucket's counts and one batch.
4. The sums of a batch meet its documents' row.

What a document's links cost is thus a few packed bytes each, however common their ids; the hottest pair has one entry a
document. Counts of a bucket are bounded by the product of the vocabularies over ``buckets``; raise that with the data.

Defined results: null and empty texts, and texts whose A or B tokens do not spell blank + text byte by byte, have no
tokens: zeros and no groups (''). Long texts are aligned whole. Equal counts are all highest. Repeated rows are documents
of their own and count each. An empty table gives an empty table. Of other columns only those of ``keep`` are
carried; one named like a made column is replaced by it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import safe_parts
from .common import materialize, slices

CHUNK_BYTES = 4_000_000
BUCKETS = 32
HELD = 4_000_000  # pairs that a counting task holds before it hands them on
MADE = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"

# ---------------------------------------------------------------------------------------------------------- tokenizers


class ByteLevel:
    """Ids and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        data = json.loads(self.library.to_str())
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        entries = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if all(c in byte_of for c in token)}
        special = {t["id"]: t["content"].encode() for t in data["added_tokens"]}
        self.bytes = [entries.get(i, special.get(i, b"")) for i in range(max([*entries, *special]) + 1)]
        # where merge i makes id 256 + i, ids are ranks, and the tiktoken library gives the same ids in a quarter of the time
        split = data["pre_tokenizer"] or {}
        plain = data["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        made = (vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges)
        self.fast = None
        if plain and all(i == 256 + n for n, i in enumerate(made)) and not data["model"].get("ignore_merges"):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the split of the byte-level kind
            ranks = {entries[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        one = self.fast.encode_ordinary
        return [one(t) if len(t) < 1 << 16 else [i for part in safe_parts(t) for i in one(part)] for t in texts]


class Pieces:
    """Ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a_file: str, b_file: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_file), Pieces(b_file)


# ----------------------------------------------------------------------------------------------------------- alignment


def walk(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """The irregular groups of two end arrays (int32, same last end): links' A and B indices, groups' last A and B indices.

    All other tokens are one to one.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    na, nb = len(a), len(b)
    link_a: list[int] = []
    link_b: list[int] = []
    last_a: list[int] = []
    last_b: list[int] = []
    i = j = 0
    while i < na and j < nb:
        if a[i] == b[j]:
            i, j, width, growing = i + 1, j + 1, 1, True
            while width:
                width = min(width, na - i, nb - j)
                if width and raw_a[4 * i : 4 * (i + width)] == raw_b[4 * j : 4 * (j + width)]:
                    i, j = i + width, j + width
                    width = 2 * width if growing else width // 2
                else:
                    growing, width = False, width // 2
            continue
        x, y = a[i], b[j]
        while x != y:
            link_a.append(i)
            link_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        link_a.append(i)
        link_b.append(j)
        last_a.append(i)
        last_b.append(j)
        i += 1
        j += 1
    return link_a, link_b, last_a, last_b


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = tokenizers(a_file, b_file)
        self.size_a = np.array([len(t) for t in self.a.bytes], np.int32)
        self.size_b = np.array([len(t) for t in self.b.bytes], np.int32)
        self.b_bits = max(1, (len(self.b.bytes) - 1).bit_length())
        va, vb = len(self.a.bytes), len(self.b.bytes)
        self.offset_b = 2 * va  # names of an A id before "," and "|", then of a B id before "," and ";"
        self.names = np.array([f"{i}{s}" for i in range(va) for s in ",|"] + [f"{i}{s}" for i in range(vb) for s in ",;"], object)

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links' A and B ids, and which A and B tokens are the last of their group."""
        link_a, link_b, end_a, end_b = walk(np.cumsum(self.size_a[ids_a], dtype=np.int32), np.cumsum(self.size_b[ids_b], dtype=np.int32))
        last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        at_a, at_b = np.array(link_a, np.int64), np.array(link_b, np.int64)
        last_a[at_a] = last_b[at_b] = False
        pairs_a = np.concatenate([ids_a[last_a], ids_a[at_a]])
        pairs_b = np.concatenate([ids_b[last_b], ids_b[at_b]])
        last_a[end_a] = last_b[end_b] = True
        return pairs_a, pairs_b, last_a, last_b

    def text_of(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        ends_a, ends_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        before = np.concatenate([[0], ends_b[:-1] + 1])  # B tokens in the groups before
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out[np.arange(len(ids_a)) + before[group_a]] = 2 * ids_a + last_a
        out[np.arange(len(ids_b)) + ends_a[group_b] + 1] = self.offset_b + 2 * ids_b + last_b
        return "".join(self.names[out].tolist())[:-1]

    def __call__(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int, str], np.ndarray | None]]:
        """For each text (n_a, n_b, n_groups, n_links, digest of the groups) and its links as A id << bits | B id."""
        spaced = [" " + t for t in texts]
        bytes_a, bytes_b = self.a.bytes, self.b.bytes
        for text, whole, one, two in zip(texts, spaced, self.a(spaced), self.b(texts)):
            spelled = whole.encode()
            if not text or b"".join([bytes_a[i] for i in one]) != spelled or b"".join([bytes_b[i] for i in two]) != spelled:
                yield (0, 0, 0, 0, ""), None
                continue
            ids_a, ids_b = np.array(one, np.int64), np.array(two, np.int64)
            pairs_a, pairs_b, last_a, last_b = self.align(ids_a, ids_b)
            digest = hashlib.sha256(self.text_of(ids_a, ids_b, last_a, last_b).encode()).hexdigest()
            yield (len(ids_a), len(ids_b), int(last_a.sum()), len(pairs_a), digest), pairs_a << self.b_bits | pairs_b


# ----------------------------------------------------------------------------------------------------------- packed rows


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit integers, byte planes apart, compressed."""
    import zstandard

    head = np.array([len(columns), *map(len, columns)], "<u4").tobytes()
    planes = [np.ascontiguousarray(np.asarray(c, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    out, at = [], 4 * (n + 1)
    for length in raw[4:at].view("<u4").tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * length].reshape(4, length).T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * length
    return out


def bucket_of(pair, b_bits: int, buckets: int):
    """The bucket of an id pair; numbers, arrays and columns alike."""
    mixed = (pair % (1 << b_bits)) * 31 + (pair - pair % (1 << b_bits)) / (1 << b_bits) * 17
    return mixed % buckets


def packed(links: list[tuple[int, np.ndarray]], b_bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, pairs, documents of each pair, documents, times) of the links of some documents."""
    if not links:
        return
    keys = np.concatenate([pairs << 24 | doc for doc, pairs in links])
    keys, times = np.unique(keys, return_counts=True)
    pairs = keys >> 24
    where = bucket_of(pairs, b_bits, buckets).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for bucket in range(buckets):
        at = order[cuts[bucket] : cuts[bucket + 1]]
        if len(at):
            distinct, docs = np.unique(pairs[at], return_counts=True)
            yield bucket, pack(distinct, docs, keys[at] & 0xFFFFFF, times[at])


def aligned(docs: DataFrame, a_file: str, b_file: str, text_col: str, keep: list[str], buckets: int) -> DataFrame:
    """(chunk, bucket, docs, blob): per batch one row (bucket -1) with its documents' figures and packed rows."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    held = [source.schema[c] for c in keep]
    one = T.StructType([*held, *T.StructType.fromDDL(MADE)])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("docs", T.ArrayType(one)), T.StructField("blob", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = Aligner(a_file, b_file), TaskContext.get().partitionId() << 32
        kind = arrow.field("docs").type
        for whole in batches:
            for batch in slices(whole, n, CHUNK_BYTES):
                figures, links = [], []
                for i, (made, pairs) in enumerate(aligner(batch.column(n).to_pylist())):
                    figures.append(made)
                    if pairs is not None:
                        links.append((i, pairs))
                columns = [*(batch.column(i) for i in range(n)), *(pa.array(c) for c in zip(*figures))]
                fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
                structs = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], fields=fields)
                blobs = list(packed(links, aligner.b_bits, buckets))
                starts = np.array([0, len(structs)] + [len(structs)] * len(blobs), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), structs, type=kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * (1 + len(blobs)), pa.int64()), pa.array([-1, *(b for b, _ in blobs)], pa.int32()), lists, pa.array([None, *(x for _, x in blobs)], pa.binary())],
                    schema=arrow,
                )
                chunk += 1

    return source.mapInArrow(run, schema)


# --------------------------------------------------------------------------------------------------------------- counts


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair of ids. A task sums what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums, held = [], [], 0

        def merged():
            keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            return keys, total

        def out(keys, total):
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), pa.array(total[a : a + 100_000])], names=["pair", "n"])

        for batch in batches:
            for blob in batch.column(0):
                distinct, docs, _, times = unpack(blob.as_py())
                pairs.append(distinct)
                sums.append(np.add.reduceat(times, np.cumsum(docs) - docs))
                held += len(distinct)
                if held > HELD:
                    keys, total = merged()
                    if len(keys) > HELD // 2:
                        yield from out(keys, total)
                        pairs, sums, held = [], [], 0
                    else:
                        pairs, sums, held = [keys], [total], len(keys)
        if pairs:
            yield from out(*merged())

    found = rows.filter("bucket >= 0").select("blob").mapInArrow(run, "pair bigint, n bigint")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def document_sums(rows: DataFrame, counts: DataFrame, b_bits: int, buckets: int) -> DataFrame:
    """(chunk, blob): for the documents of a batch, packed, their links with a highest count and the sums of counts, of one bucket."""
    by_b = Window.partitionBy((F.col("pair") % (1 << b_bits)).alias("b"))  # at most as many rows as A has ids
    best = counts.withColumn("best", F.col("n") == F.max("n").over(by_b))
    known = best.select(bucket_of(F.col("pair"), b_bits, buckets).cast("int").alias("bucket"), F.lit(0).alias("kind"), "pair", "n", "best")
    both = known.unionByName(rows.filter("bucket >= 0").select("bucket", F.lit(1).alias("kind"), "chunk", "blob"), allowMissingColumns=True)
    both = both.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ready = None, [], None
        for batch in batches:
            bucket, kind = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
                if a == e:
                    continue
                if bucket[a] != now:
                    now, parts, ready = bucket[a], [], None
                if kind[a] == 0:
                    parts.append([batch.column(i).slice(a, e - a).to_numpy(zero_copy_only=False) for i in (2, 3, 4)])
                    continue
                if ready is None:
                    pair, n, top = (np.concatenate(c) for c in zip(*parts))
                    order = np.argsort(pair)
                    ready, parts = (pair[order].astype(np.int64), n[order].astype(np.int64), top[order].astype(bool)), []
                for i in range(a, e):
                    distinct, docs, doc, times = unpack(batch.column(6)[i].as_py())
                    at = np.repeat(np.searchsorted(ready[0], distinct), docs)
                    names, place = np.unique(doc, return_inverse=True)
                    sums, tops = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                    np.add.at(sums, place, ready[1][at] * times)
                    np.add.at(tops, place, ready[2][at] * times)
                    blob = pack(names, tops, sums & 0xFFFFFFFF, sums >> 32)
                    yield pa.RecordBatch.from_arrays([batch.column(5).slice(i, 1), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    return both.select("bucket", "kind", "pair", "n", "best", "chunk", "blob").mapInArrow(run, "chunk bigint, blob binary")


def align(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text", keep: Iterable[str] = ("doc_id",), buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(documents: ``keep``, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; counts: a_id, b_id, n of all linked pairs)."""
    new = {f.name for f in T.StructType.fromDDL(MADE)} | {"n_best", "count_sum"}
    keep = [c for c in dict.fromkeys(keep) if c not in new]
    b_bits = Aligner(a_file, b_file).b_bits
    rows = materialize(aligned(docs, a_file, b_file, text_col, keep, buckets), "aligned")
    counts = materialize(pair_counts(rows), "pair-counts")
    sums = document_sums(rows, counts, b_bits, buckets)
    schema = T.StructType([*rows.schema["docs"].dataType.elementType, *T.StructType.fromDDL("n_best bigint, count_sum bigint")])
    arrow = to_arrow_schema(schema)

    def joined(table: pa.Table) -> pa.Table:
        parts, tops, sums = None, None, None
        for row in np.argsort(table.column("docs").is_null().to_numpy(), kind="stable"):  # the documents first
            if parts is None:
                parts = table.column("docs")[int(row)].values
                tops, sums = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
                continue
            doc, top, low, high = unpack(table.column("blob")[int(row)].as_py())
            tops[doc] += top
            sums[doc] += low + (high << 32)
        return pa.Table.from_arrays([*parts.flatten(), pa.array(tops), pa.array(sums)], schema=arrow)

    meta = rows.filter("bucket = -1").select("chunk", "docs")
    both = meta.unionByName(sums, allowMissingColumns=True)
    found = both.groupBy("chunk").applyInArrow(joined, schema)
    low = F.col("pair") % (1 << b_bits)
    return found, counts.select(((F.col("pair") - low) / (1 << b_bits)).cast("int").alias("a_id"), low.cast("int").alias("b_id"), "n")
