"""Token id files: all ids of a shard in one array, document boundaries Elias-Fano coded, with a select directory.

File format (little endian), one file per shard, documents in ascending id (null ids last, then by text hash)::

    8 bytes   magic "EFIDS02\\n"
    u64 x 5   documents, ids, documents without an id, smallest document id (as two's complement), bytes of an id
    3 coded sequences: boundaries (documents + 1 values, 0 .. ids), document ids less the smallest, as below
              (the third is reserved and empty)
    ids       2 bytes each where the vocabulary has at most 65,536 entries, else 4

A coded sequence of n non-decreasing values up to u: u64 n, u64 l, u64 bytes of lows, u64 bytes of highs; the low l
bits of every value, packed; the high parts as unary gaps; and for every 64 bytes of those the number of ones before
it (u32), with which ``select`` finds the i-th value without a table of 64-bit offsets. That is about 2 + log2(u / n)
bits a document.

Encoding takes the tokenizers library. It drops white space, so a text is encoded by its chunks between white space,
and a task remembers the ids of up to ``CACHE`` chunks. Texts with the strings of added tokens, and those with the control
characters U+001C to U+001F, which Python but not the library takes for white space, are encoded whole.

Files go to a folder that all executors reach, through the file system of its URI. A file is written under another
name and moved, and its content follows from the rows alone, so a task that runs again writes the same file.

Defined results: null text = empty text: the end id alone. Null document ids come last and stay null. Repeated rows
are documents of their own. An empty table writes no file. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

from .common import materialize, slices

MAGIC = b"EFIDS02\n"
SHARD_IDS = 1 << 22
CACHE = 1_000_000
#: Characters whose form, case or class is left to the library; U+0130 becomes two when lower-cased.
OTHER = re.compile("[^\x21-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]")


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    BLOCK = 64  # bytes of highs for each directory entry

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes):
        self.n, self.low_bits = n, low_bits
        self.lows = np.frombuffer(lows, np.uint8)
        self.highs = np.frombuffer(highs, np.uint8)
        pad = np.zeros(-len(self.highs) % self.BLOCK, np.uint8)
        self.blocks = np.concatenate([self.highs, pad]).reshape(-1, self.BLOCK)
        ones = np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])[:-1].astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = b""
        if low_bits:
            bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
        highs = np.zeros(n + (top >> low_bits) + 1 if n else 0, np.uint8)
        if n:
            highs[(v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, lows, np.packbits(highs, bitorder="little").tobytes())

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        index = np.asarray(index, np.int64)
        out = np.zeros(len(index), np.uint64)
        for a in range(0, len(index), 4096):
            i = index[a : a + 4096]
            block = np.searchsorted(self.before, i, "right") - 1
            bits = np.unpackbits(self.blocks[block], axis=1, bitorder="little")
            rank = np.cumsum(bits, axis=1, dtype=np.int32)
            place = (rank <= (i - self.before[block])[:, None]).sum(axis=1)
            high = block * self.BLOCK * 8 + place - i
            low = np.zeros(len(i), np.uint64)
            for b in range(self.low_bits):
                at = i * self.low_bits + b
                low |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(b)
            out[a : a + 4096] = (high.astype(np.uint64) << np.uint64(self.low_bits)) | low
        return out

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.lows), len(self.highs)], "<u8").tobytes()
        return head + self.lows.tobytes() + self.highs.tobytes() + self.before.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = (int(x) for x in np.frombuffer(data[at : at + 32], "<u8"))
        at += 32
        made = cls(n, low_bits, bytes(data[at : at + a]), bytes(data[at + a : at + a + b]))
        return made, at + a + b + 4 * len(made.before)


class Encoder:
    """Ids of texts as packed unsigned integers of ``width`` bytes, by chunks between white space that are remembered.

    The strings of added tokens in a text are those tokens, as in the library. Chunks of Latin letters, digits and marks are
    lower-cased and cut by the file's pattern here, and the library is asked for their pieces only; others it gets whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        data = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        added = "|".join(re.escape(t["content"]) for t in data["added_tokens"])
        self.whole = re.compile("[\x1c-\x1f]" + (f"|{added}" if added else ""))
        self.known: dict[str, bytes] = {}
        self.pieces = None
        steps = data.get("normalizer") or {}
        split = (data.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = data["model"].get("end_of_word_suffix")
        if [n["type"] for n in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and suffix:
            self.pieces = regex.compile(split[0]["pattern"]["Regex"])
            self.bare = Tokenizer.from_file(tokenizer_file)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_pieces(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without characters that ``OTHER`` names: NFC leaves them, and every piece ends with a token that ends a word."""
        found = [[c.lower()] if c.isascii() and c.isalpha() else self.pieces.findall(c.lower()) for c in chunks]
        encoded = self.bare.encode_batch_fast([" ".join(x for some in found[a : a + 500] for x in some) for a in range(0, len(found), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, f"<u{self.width}") for e in encoded])
        last = np.cumsum([len(some) for some in found]) - 1
        cuts = (self.width * (np.flatnonzero(self.ends[ids])[last] + 1)).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [t if self.whole.search(t) else None for t in texts]
        chunks = [t.split() if w is None else [] for t, w in zip(texts, whole)]
        if len(self.known) > CACHE:
            self.known = {}
        missing = set().union(*chunks) - self.known.keys()
        plain = [c for c in missing if c.isascii() and c.isalpha() or not OTHER.search(c)] if self.pieces is not None else []
        for some, ids in ((plain, self._of_pieces), (list(missing.difference(plain)), self._ids)):
            for a in range(0, len(some), 50_000):
                part = some[a : a + 50_000]
                self.known.update(zip(part, ids(part)))
        get = self.known.__getitem__
        return [b"".join(map(get, some)) if w is None else self._ids([w])[0] for some, w in zip(chunks, whole)]


@lru_cache(maxsize=2)
def encoder_of(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def pack(doc_ids: list[int | None], docs: list[bytes], width: int) -> bytes:
    """A shard's file."""
    known = [i for i in doc_ids if i is not None]
    least = min(known, default=0)
    lengths = np.array([len(d) // width for d in docs], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    head = np.array([len(docs), int(bounds[-1]), len(docs) - len(known), least % (1 << 64), width], "<u8").tobytes()
    parts = [EliasFano.of(bounds).dump(), EliasFano.of(np.array([i - least for i in known], np.uint64)).dump(), EliasFano.of(np.zeros(0, np.uint64)).dump()]
    return b"".join([MAGIC, head, *parts, *docs])


class Shard:
    """A file read back: ``doc_ids`` and, through select, the ids of any document."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token id file")
        self.n_docs, self.n_ids, self.n_null, least, self.width = (int(x) for x in np.frombuffer(view[8:48], "<u8"))
        least = least - (1 << 64) if least >= 1 << 63 else least
        self.bounds, at = EliasFano.load(view, 48)
        ids, at = EliasFano.load(view, at)
        _, at = EliasFano.load(view, at)
        self.doc_ids = [int(x) + least for x in ids.select(np.arange(ids.n))] + [None] * self.n_null
        self.ids = np.frombuffer(view[at : at + self.width * self.n_ids], f"<u{self.width}")

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Boundaries of documents first to last: one more than there are documents."""
        return self.bounds.select(np.arange(first, last + 1)).astype(np.int64)


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def _save(folder: str, name: str, data: bytes) -> str:
    fs, root = _fs(folder)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, f"{root}/{name}")
    return f"{folder}/{name}"


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, order and write all documents; the manifest (path, part, shard, n_docs, n_ids, start), one row a file.

    ``start`` is the number of ids in all files before: a running sum over one row for each file.
    """
    _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__hash"))
    order = (F.col("__id").asc_nulls_last(), F.col("__hash"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer_file), TaskContext.get().partitionId()
        width = encoder.width
        end = np.array([end_id], f"<u{width}").tobytes()
        ids: list[int | None] = []
        packed: list[bytes] = []
        size = shard = 0

        def flush() -> pa.RecordBatch:
            path = _save(folder, f"part-{part:06d}-{shard:06d}.efids", pack(ids, packed, width))
            return pa.RecordBatch.from_pylist([{"path": path, "part": part, "shard": shard, "n_docs": len(ids), "n_ids": size}], schema=manifest)

        for whole in batches:
            for b in slices(whole, 1):
                for i, x in zip(b.column(0).to_pylist(), encoder(b.column(1).to_pylist())):
                    x += end
                    if ids and size + len(x) // width > shard_ids:
                        yield flush()
                        ids, packed, size, shard = [], [], 0, shard + 1
                    ids.append(i)
                    packed.append(x)
                    size += len(x) // width
        if ids:
            yield flush()

    manifest = pa.schema([("path", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    files = materialize(rows.mapInArrow(run, "path string, part int, shard int, n_docs bigint, n_ids bigint"), "manifest")
    return files.withColumn("start", F.sum("n_ids").over(Window.orderBy("part", "shard")) - F.col("n_ids"))


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest: (doc_id, start, n_tokens, ids_crc32) and, when asked, the packed ``ids``."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = _fs(path)
                with fs.open_input_stream(name) as stream:
                    shard = Shard(stream.read())
                for a in range(0, shard.n_docs, 4096):
                    e = min(shard.n_docs, a + 4096)
                    at = shard.offsets(a, e)
                    wide = shard.ids[at[0] : at[-1]].astype("<u4").tobytes()
                    ids = [wide[4 * s : 4 * t] for s, t in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist())]
                    made = [pa.array(shard.doc_ids[a:e], pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*made, *([pa.array(ids, pa.binary())] if with_ids else [])], schema=schema)

    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return files.select("path", "start").repartition("path").mapInArrow(run, ddl)


def folder_for(spark: SparkSession) -> str:
    """A new folder for files in the shared folder."""
    return scratch_path(spark, "id-files")


__all__: Iterable[str] = ["EliasFano", "Encoder", "Shard", "folder_for", "pack", "read", "write"]
