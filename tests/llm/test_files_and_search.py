"""Token id files, licence scans and vantage-point trees against brute force, and odd rows."""

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import idfiles, licences, queries, vptree

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(1, 10**9))
def test_elias_fano(gaps, scale):
    values = np.cumsum(np.array(gaps, np.uint64) * np.uint64(scale))
    made = idfiles.EliasFano.of(values)
    data = b"xx" + made.dump() + b"yy"
    back, end = idfiles.EliasFano.load(memoryview(data), 2)
    assert end == len(data) - 2
    assert back.select(np.arange(len(values))).tolist() == values.tolist()
    assert len(values) < 100 or len(made.lows) + len(made.highs) <= len(values) * (3 + max(0, np.log2(max(1, float(values[-1]) / len(values))))) / 8 + 16


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aZé.,'’s 3½ßΣİ\t\n\x1c\x1f\x85\xa0 ", "\u0301", "\u0307", "e\u0301", "<|endoftext|>", "<|startoftext|>", "ﬁ", "日本", "İ", "'re", "ª²"]), max_size=40).map("".join))
def test_chunks_encode_as_the_whole_text(text):
    encoder = idfiles.encoder_of(TOKENIZER)
    got = np.frombuffer(encoder([text])[0], f"<u{encoder.width}").tolist()
    assert got == library().encode(text, add_special_tokens=False).ids


def test_strings_of_added_tokens():
    encoder = idfiles.encoder_of(TOKENIZER)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(["a <|endoftext|> b", "A<|startoftext|>b <|endoftext", "x"])] == [
        library().encode(t, add_special_tokens=False).ids for t in ("a <|endoftext|> b", "A<|startoftext|>b <|endoftext", "x")
    ]
    assert library().encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]


def test_id_files_query(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    rows = {r["doc_id"]: r for r in queries.op6_id_files(spark, SF).collect()}
    assert len(rows) == len(docs)
    t, start = library(), 0
    for i, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_id_files_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b", "x"), (None, "c", "x"), (-3, None, "x"), (5, "a b", "x"), (7, "word " * 30_000, "x"), (8, "", "x")], "doc_id bigint, text string, path string")
    files = idfiles.write(df, idfiles.folder_for(spark), TOKENIZER, shard_ids=4)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in idfiles.read(files, with_ids=True).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [-3, 5, 5, 7, 8, None]
    assert [g[2] for g in got] == [1, 3, 3, 30_001, 1, 2] and [g[1] for g in got] == [0, 1, 4, 7, 30_008, 30_009]
    assert idfiles.read(idfiles.write(df.limit(0), idfiles.folder_for(spark), TOKENIZER)).count() == 0


def test_licences_query(spark):
    """Lines, paragraphs and texts against SQL that compares every segment with every template."""
    rows, _, problem = compare(queries.op7_licences(spark, SF).filter("kind <> 'run'"), connect(SF), licences.oracle())
    assert problem is None and rows > 0


def grams_of(text):
    w = [x for x in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if x]
    return {f"{a} {b}" for a, b in zip(w, w[1:])}, w


def licences_reference(text, templates, least=0.8):
    """All rows of one text by comparing every segment and every run of sentences with every template."""
    low, high = least / (2 - least), (2 - least) / least
    known = {k: grams_of(v)[0] for k, v in templates.items()}

    def score(grams, k):
        return 2 * len(grams & known[k]) / (len(grams) + len(known[k])) if grams or known[k] else 0.0

    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    segments = [("line", i, t) for i, t in enumerate(text.split("\n"))] + [("paragraph", i, t) for i, t in enumerate(paragraphs) if "\n" in t]
    segments += [("text", 0, text)] if len(paragraphs) > 1 else []
    out = []
    for kind, i, t in segments:
        best = min((-score(grams_of(t)[0], k), k) for k in known)
        if -best[0] >= least:
            out.append((kind, i, best[1], -best[0]))
    for k, b in known.items():
        reaches = lambda t: score(grams_of(t)[0], k) >= least
        units = [
            (grams_of(s)[1], reaches(line) or reaches(p) or reaches(text))
            for p in paragraphs for line in p.split("\n") for s in re.split(r"(?<=[.!?])\s+", line) if grams_of(s)[1]
        ]
        near = []
        for i, (w, held) in enumerate(units):
            around = (units[i - 1][0][-1:] if i else []) + w + (units[i + 1][0][:1] if i + 1 < len(units) else [])
            near.append(not held and any(f"{x} {y}" in b for x, y in zip(around, around[1:])))
        found = []
        for i in range(len(units)):
            for j in range(i, len(units)):
                if near[i] and near[j] and not any(h for _, h in units[i : j + 1]):
                    w = [x for u, _ in units[i : j + 1] for x in u]
                    grams = {f"{x} {y}" for x, y in zip(w, w[1:])}
                    if len(b) * low - 1e-9 <= len(w) - 1 <= len(b) * high + 1e-9 and score(grams, k) >= least:
                        found.append((-score(grams, k), j - i, i, j))
        kept = []
        for r in sorted(found):
            if not any(x[2] <= r[3] and r[2] <= x[3] for x in kept):
                kept.append(r)
        out += [("run", i, k, -s) for s, _, i, _ in kept]
    return out


def test_licences_against_brute_force(spark):
    """Notices, whole, cut, reworded and spread over lines, sentences and paragraphs, of all kinds of segment."""
    rng = np.random.default_rng(6)
    names = sorted(licences.TEMPLATES)
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.integers(1, 5)):
            w = licences.TEMPLATES[names[rng.integers(len(names))]].split(" ")
            w = [x if rng.random() > 0.04 else "other" for x in w]
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] += ["\n", "\n\n", ".", "!\n \n", ""][rng.integers(5)]
            parts.append(" ".join(w))
            parts.append(["Plain words here. ", "\n", "\n\nNext paragraph, ", " "][rng.integers(4)] + "some prose follows" * int(rng.integers(0, 2)))
        docs.append((i, "".join(parts)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = sorted((i, kind, place, licence, round(score, 9)) for i, t in docs for kind, place, licence, score in licences_reference(t, licences.TEMPLATES))
    assert {x[1] for x in want} == {"line", "paragraph", "text", "run"} and sum(x[1] == "run" for x in want) > 20
    for held in (licences.HELD, 100):  # one slice of templates, and several
        got = sorted((*tuple(r)[:4], round(r["score"], 9)) for r in licences.find(df, licences.template_table(spark), held=held).collect())
        assert not set(want) ^ set(got)
        assert got == want


def test_licences_odd_rows(spark):
    mit = licences.TEMPLATES["mit"]
    df = spark.createDataFrame(
        [(1, mit), (2, "start\n\n" + mit.replace(", ", ",\n").replace("Software is", "Program is") + "\n\nend"), (3, None), (4, ""), (4, ""), (5, "word " * 50_000), (6, "released under the mit LICENSE!!"), (6, "released under the mit LICENSE!!"), (None, "All rights\treserved")],
        "doc_id bigint, text string",
    ).selectExpr("*", "'x' as licence", "'y' as kind", "1 as n")
    got = sorted(((r["doc_id"], r["kind"], r["place"], r["licence"], round(r["score"], 2)) for r in licences.find(df, licences.template_table(spark)).collect()), key=str)
    assert got == sorted([(1, "line", 0, "mit", 1.0), (2, "paragraph", 1, "mit", 0.98), (2, "text", 0, "mit", 0.97), (6, "line", 0, "mit-line", 1.0), (6, "line", 0, "mit-line", 1.0), (None, "line", 0, "all-rights-reserved-line", 1.0)], key=str)
    assert licences.find(df.limit(0), licences.template_table(spark)).count() == 0
    assert licences.find(df, licences.template_table(spark).limit(0)).count() == 0


def brute(x, ids, asked, k):
    out = {}
    for j in asked:
        p = (x * x[j]).sum(axis=1)
        out[ids[j]] = [(ids[i], p[i]) for i in sorted((i for i in range(len(ids)) if ids[i] != ids[j]), key=lambda i: (-p[i], ids[i]))[:k]]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_vp_trees_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows]
    want = brute(x, ids, [j for j, i in enumerate(ids) if i % 20 == 0], 20)
    got = as_dict(queries.op10_vp_trees(spark, SF).collect())
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(got[q], want[q]))


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (1.1, 0.9)])
def test_vp_trees_shards_and_copies(spark, factor, least):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((30, 8))[rng.integers(0, 30, 900)] + 0.1 * rng.standard_normal((900, 8)), np.tile(rng.standard_normal(8), (400, 1))])
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist(), "rank": "x", "score": "y"}))
    got = as_dict(vptree.nearest(df, df.filter("vec_id % 13 = 0"), 5, factor, pivots=6, shard_rows=100).collect())
    want = brute(x, ids, [j for j, i in enumerate(ids) if i % 13 == 0], 5)
    if factor == 1:
        assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= least


def test_vp_trees_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 2.0]), (7, [0.5, 2.0]), (None, [1.0, 1.0]), (20, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, vptree.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect()))
    assert got == [(0, 1, 1, 4.5), (0, 2, 7, 4.5), (0, 3, 7, 4.5)]
    assert vptree.nearest(df.limit(0), df, 3).count() == 0 and vptree.nearest(df, df.limit(0), 3).count() == 0


def planted(x, ids):
    m2 = (x * x).sum(axis=1).max() * (1 + 1e-12)
    tree = vptree.Tree(ids, np.concatenate([x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))[:, None]], axis=1))
    tree.m2 = m2
    return tree


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e-7, 1e-150])
def test_vp_tree_walk_is_exact(monkeypatch, scale):
    """Noise, clusters, copies, repeated ids and norms of all sizes in leaves of 16, with and without a product to reach."""
    monkeypatch.setattr(vptree, "LEAF", 16)
    monkeypatch.setattr(vptree, "LEAF_QUERIES", 7)
    rng = np.random.default_rng(8)
    x = np.concatenate([
        rng.standard_normal((300, 12)), rng.standard_normal((6, 12))[rng.integers(0, 6, 300)] + 0.01 * rng.standard_normal((300, 12)),
        np.tile(rng.standard_normal(12), (90, 1)), rng.standard_normal((60, 12)) * 10.0 ** rng.uniform(-30, 9, (60, 1)),
    ]) * scale
    ids = rng.integers(0, 700, len(x))
    asked = np.concatenate([np.flatnonzero(ids % 5 == 0), np.flatnonzero(ids % 5 == 0)[:9]])
    q = np.concatenate([x[asked], np.zeros((len(asked), 1))], axis=1)
    want = []
    for j in asked:
        p = np.einsum("ij,ij->i", np.broadcast_to(x[j], x.shape).copy(), x)
        order = sorted((i for i in range(len(x)) if ids[i] != ids[j]), key=lambda i: (-p[i], ids[i]))[:7]
        want.append([(ids[i], p[i]) for i in order])
    least = np.array([w[3][1] for w in want])
    for floor, kept in ((np.full(len(asked), -np.inf), want), (least, [[h for h in w if h[1] >= w[3][1]] for w in want])):
        row, i, p = planted(x, ids).search(ids[asked], q, floor, 7, 1.0)
        got = [[] for _ in asked]
        for r, h in zip(row, zip(i, p)):
            got[r].append(h)
        assert got == kept


def test_vp_trees_rows_handed_on(spark, monkeypatch):
    """A query meets few trees, and of those searched later only hits that reach its k-th product so far come back."""
    seen = {}
    keep = vptree.materialize

    def spy(df, label):
        seen.setdefault(label, []).append(keep(df, label))
        return seen[label][-1]

    monkeypatch.setattr(vptree, "materialize", spy)
    rng = np.random.default_rng(10)
    x, ids = rng.standard_normal((6000, 24)), np.arange(6000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()})).repartition(4)
    got = as_dict(vptree.nearest(df, df.filter("vec_id % 20 = 0"), 20, shard_rows=2000).collect())
    want = brute(x, ids, range(0, 6000, 20), 20)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert sum(t.count() for t in seen["routed"]) <= 300 * 6
    first, second = seen["first-round"][0].toPandas(), seen["second-round"][0].toPandas()
    kth = first.groupby("query_id")["score"].apply(lambda s: s.nlargest(20).iloc[-1])
    assert len(second) and (second["score"] >= second["query_id"].map(kth)).all()


def test_notices_across_paragraphs_and_inside_lines(spark):
    """Standard headers with blank lines inside a longer document, and a licence sentence inside a line of prose."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    prose = "\n\n".join(f"Paragraph {i} says that the weather of day {i} was fine. Nobody went out all the same." for i in range(40))
    docs = [
        (1, f"{prose}\n\n{apache}\n\n{prose}"), (2, f"{prose}\n\n{gpl}\n\n{prose}"), (3, "Our tools are free to use. Released under the MIT License. Please write to us."),
        (4, "Released under the MIT License."), (5, prose), (6, None), (7, f"{prose}\n\n{apache}\n\n{prose}\n\n{apache}"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = licences.find(df, licences.template_table(spark)).collect()
    want = sorted((i, *x[:3], round(x[3], 9)) for i, t in docs if t for x in licences_reference(t, licences.TEMPLATES))
    assert sorted((r["doc_id"], r["kind"], r["place"], r["licence"], round(r["score"], 9)) for r in rows) == want
    got = [(r["doc_id"], r["kind"], r["licence"]) for r in rows if not (r["kind"] == "line" and r["licence"] == "apache-2.0-line")]
    assert sorted(got) == [(1, "run", "apache-2.0-notice"), (2, "run", "gpl-3.0-notice"), (3, "run", "mit-line"), (4, "line", "mit-line"), (7, "run", "apache-2.0-notice"), (7, "run", "apache-2.0-notice")]
