"""Alignment of two tokenizers against the definition, pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import align
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DDL = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def bytes_of_a(a, i):
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in visible)}
    return bytes(table[c] for c in a.id_to_token(i))


def bytes_of_b(b, i):
    piece = b.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()


def reference(libraries, texts):
    """(figures of each text) by the definition: overlaps of byte ranges, groups cut at common ends."""
    a, b = libraries
    docs, counts = [], Counter()
    for text in texts:
        one = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        parts_a, parts_b = [bytes_of_a(a, i) for i in one], [bytes_of_b(b, i) for i in two]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in parts_a]).tolist(), np.cumsum([len(x) for x in parts_b]).tolist()
        links, j = [], 0
        for i, (s, e) in enumerate(zip([0, *ends_a], ends_a)):
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(two) and (ends_b[k - 1] if k else 0) < e:
                links.append((one[i], two[k]))
                k += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append(",".join(map(str, one[i:x])) + "|" + ",".join(map(str, two[j:y])))
            i, j = x, y
        counts.update(links)
        docs.append((len(one), len(two), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*d[:3], len(d[3]), sum(counts[p] == top[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]))
    return out, counts


def test_query_against_the_definition(spark, libraries):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    expected, _ = reference(libraries, [r["text"] for r in rows])
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_alignment"][0](spark, SF).collect()}
    assert found == {r["doc_id"]: e for r, e in zip(rows, expected)}


TEXTS = [
    None, "", " ", "  ", "a", "\n\n\t x", "Grüße aus Köln, señor!", "日本語のテキスト", "emoji 🙂🙃 mix", "a▁b", "zero\x00byte", "<|endoftext|> and </s> and <unk>", "<s>x</s>", "tab\tand nbsp",
    "x" * 5000, "word " * 40_000 + "é" * 500, "ﬁ ligature ①", "same text", "same text", "same text", "é combining", "​ zero width", "1234567890" * 30, " leading", "trailing ", "퟿",
]


def test_texts_of_all_kinds(spark, libraries):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab ÄÖ\n.,日<>") for _ in range(rng.randrange(60))) for _ in range(150)]
    expected, counts = reference(libraries, texts)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DDL).repartition(4).selectExpr("*", "'x' as n_a", "'y' as chunk", "'z' as bucket", "1 as docs", "2 as blob", "3 as __text", "4 as n_best")
    found, pairs = align.align(docs, A_FILE, B_FILE, keep=["doc_id", "chunk", "n_a"], buckets=5)
    assert found.columns == ["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = [(r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((i, *e) for (i, _), e in zip(rows, expected)), key=repr)
    assert {r["chunk"] for r in found.collect()} == {"y"}
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == counts


def test_empty_table(spark):
    found, pairs = align.align(spark.createDataFrame([], DDL), A_FILE, B_FILE)
    assert found.collect() == [] and pairs.collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.randoms(use_true_random=False), st.integers(0, 60))
def test_walk_skips_nothing(sizes, rng, moves):
    """Diagonal runs of any length, with the shift changed at random places."""
    ends_a = np.cumsum(sizes).astype(np.int32)
    cuts = set(ends_a.tolist())
    for _ in range(moves):
        cuts ^= {rng.randrange(1, int(ends_a[-1]) + 1)}
    ends_b = np.array(sorted(cuts | {int(ends_a[-1])}), np.int32)
    link_a, link_b, last_a, last_b = align.walk(ends_a, ends_b)
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    irregular = []
    start = i = j = 0
    for cut in common:
        x, y = int(np.searchsorted(ends_a, cut)), int(np.searchsorted(ends_b, cut))
        if x > i or y > j:
            irregular.append((x, y))
        i, j, start = x + 1, y + 1, cut
    assert list(zip(last_a, last_b)) == irregular
    overlaps = set()
    for p, q in zip(link_a, link_b):
        assert max(ends_a[p - 1] if p else 0, ends_b[q - 1] if q else 0) < min(ends_a[p], ends_b[q])
        overlaps.add((p, q))
    union = len(set(ends_a.tolist()) | set(ends_b.tolist()))
    single = len(common) - len(irregular)
    assert len(overlaps) == len(link_a) == union - single


def test_packed_rows_come_back():
    for columns in ([np.array([], np.int64)], [np.arange(1000), np.array([2**32 - 1, 0])]):
        assert [x.tolist() for x in align.unpack(align.pack(*columns))] == [list(c) for c in columns]
