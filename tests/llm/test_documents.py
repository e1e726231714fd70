"""Corpus operators on documents against brute force, and their defined results on odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, queries, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "one two three four five six", "en", "b", 26), (4, "one two three four five six", "en", None, 26),
    (4, "one two three four five six", "en", None, 26), (5, "  \n\t ", "en", "a", 5), (6, "ab " * 60_000, "en", "a", 180_000), (7, "x" * 150_000, "en", "c", 150_000),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with those that operators add."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("ids", "score", "fp", "base", "spans", "rank", "size", "block", "component_id", "fingerprint", "candidates", "decoys", "taken", "target", "n_tokens", "__row", "__raw", "c0"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ------------------------------------------------------------------------------------------------------ secrets


def base_reference(text):
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_base_spans(documents):
    texts = [d["text"] or "" for d in documents] + [
        "secret: token = abcdefgh", "paſſword=abcdefgh", "TOKEN='abc.def=g' apikey:\"1234567\"", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 14,
        "f" * 24, "f" * 23, "é" * 5 + "0123456789abcdef01234567", "password = short",
    ]
    for t in texts:
        assert [f"{k}:{s}:{e}" for k, s, e in secrets.base_spans(t)] == base_reference(t)


def test_secrets_query(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op2_secrets(spark, SF).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        want = base_reference(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_battery_tells_random_from_written():
    rng = np.random.default_rng(1)
    symbols = secrets.ENCODINGS["base62"]
    passed = sum(min(secrets.battery("".join(rng.choice(list(symbols), 40)), "base62")) * 3 >= secrets.ACCEPT for _ in range(300))
    assert passed >= 285
    assert min(secrets.battery("a1" * 20, "base36")) < 1e-6
    assert min(secrets.battery("aaaaaaaaaabbbbbbbbbb" * 2, "lower")) < 1e-6


def test_random_tokens_are_found_and_words_left(spark):
    rng = np.random.default_rng(2)
    symbols = list(secrets.ENCODINGS["base62"])
    rows = []
    for i in range(60):
        token = "".join(rng.choice(symbols, 40))
        rows.append((i, f"the quick brown fox jumps over the lazy dog and goes home again to rest {token} " + "plain words follow here " * 30))
    rows += [(100 + i, "an internationalisationalistically long word and some-hyphenated-words-in-a-row here " * 5) for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in secrets.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(bool(found[i]) for i in range(60)) >= 55
    assert not any(found[100 + i] for i in range(60))


def test_parts_of_runs():
    """Names before an equals sign, marks of both alphabets, and runs that a base span overlaps in part."""
    rng = np.random.default_rng(4)
    token, mixed = "".join(rng.choice(list(secrets.ENCODINGS["base62"]), 40)), "".join(rng.choice(list(secrets.ENCODINGS["base64url"]), 40))
    for text, part in (
        (f"AWS_ACCOUNT_VALUE={token}", token), (f"export STRIPE_KEY=sk_live_{token}; x", f"sk_live_{token}"), (f"a=b={token}==&c", token + "=="),
        (f"get/it+now/{mixed}", mixed.strip("+/")), (f"https://a.example/x_y/{token}?q", token), (f"password=abcdefgh/{token}", None), ("0123456789abcdef01234567" + token[:0] + f"Z{token}", "Z" + token),
    ):
        found = [text[c[0] : c[1]] for c in secrets.scan_text(text)[1]]
        assert part is None and not found or any(part in f for f in found), text
    assert secrets.scan_text("a-b/c_d+" * 10)[1] == []


def test_ordinary_identifiers_are_not_reported(spark):
    """Short clean identifiers, whose random look the battery cannot tell, alone and beside tokens; tokens of a length with power stay."""
    rng = np.random.default_rng(6)
    names = ["Windows10UpdateBlocker", "SpringBootQuickJava17", "Version20240315Build1287", "Python3PackageIndex2", "Kubernetes1Cluster29Node"]
    prose = "The house at the end of the street was sold to a teacher who had lived in the north for years and wanted to be near the sea in the end. "
    rows = [(i, f"{prose} {names[i % 5]} {prose}") for i in range(300)]
    rows += [(1000 + i, f"{prose} {''.join(rng.choice(list(secrets.ENCODINGS['base62']), 60))} {prose}") for i in range(100)]
    found = {r["doc_id"]: r["spans"] for r in secrets.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(found[i] for i in range(300))
    assert sum(bool(found[1000 + i]) for i in range(100)) >= 90
    few = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id bigint, text string")
    assert not any(r["spans"] for r in secrets.find(few).collect())


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "a password=abcdefgh b " + "0" * 8 + "f" * 24 + " c", 60), (2, "clean", 5), (3, None, None), (4, "token=" + "a" * 30, 36)], "doc_id bigint, text string, n_chars bigint")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(df).collect()}
    assert out == {1: ("a [secret] b [secret] c", 23), 2: ("clean", 5), 3: (None, None), 4: ("[secret]", 8)}
    assert secrets.find(odd.limit(0)).count() == 0
    assert secrets.find(odd).count() == len(ODD)
    kept = secrets.redact(odd)
    assert kept.columns == odd.columns
    assert sorted(map(tuple, kept.drop("text", "n_chars").collect()), key=repr) == sorted(map(tuple, odd.drop("text", "n_chars").collect()), key=repr)


def test_decoys_come_from_the_whole_text():
    """The words of a text without candidates differ after the first 400: so do its decoys."""
    start = " ".join("alpha" for _ in range(1000))
    one, two = (secrets.ordinary_words(start + " " + " ".join(w for _ in range(30_000))) for w in ("bravo", "delta"))
    assert len(one) == 400 and one.count("bravo") > 300 and two.count("delta") > 300
    short = "some few words only"
    assert secrets.ordinary_words(short) == short.split()
    lengths = {d[1] for i in range(60) for d in secrets.scan_text(f"{i} " + "plain words that stand in a text of some length here " * 40)[2]}
    assert len(secrets.LENGTHS) - 1 in lengths


def test_decoys_are_made_of_all_words_of_a_long_text(monkeypatch):
    """Words are not sampled: a text longer than 16,000 characters without candidates hands all of them to its decoys."""
    text = " ".join(f"{a}{b}{c}" for a in "bcdfghjklmnp" for b in "aeiou" for c in "bcdfghjklmnpqrst" for _ in range(6))
    seen = []
    monkeypatch.setattr(secrets, "ordinary", lambda rng, words, name, n, made=secrets.ordinary: seen.append(words) or made(rng, words, name, n))
    assert len(text) > 16_000 and secrets.scan_text(text)[1] == []
    assert len(seen) == secrets.DECOYS and all(words == text.split() for words in seen)


# ------------------------------------------------------------------------------------------------------ simhash


def fingerprint_reference(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components_reference(fps, radius=4):
    """{index: smallest index of its component} by comparing everything."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def test_simhash_query(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op4_simhash(spark, SF).collect()}
    docs = sorted(documents, key=lambda d: d["doc_id"])
    fps = [fingerprint_reference(d["text"] or "") for d in docs]
    roots = components_reference(fps)
    assert len(rows) == len(docs)
    for d, fp, root in zip(docs, fps, roots):
        assert rows[d["doc_id"]]["fingerprint"] == f"{fp:016x}"
        assert rows[d["doc_id"]]["component_id"] == docs[root]["doc_id"]


@pytest.mark.parametrize("radius,block", [(4, 4096), (4, 8), (3, 4096), (6, 64)])
def test_links_lose_nothing(spark, monkeypatch, radius, block):
    """Dense balls of fingerprints, chains and strangers, with few and many blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(radius)
    fps = set()
    for centre in rng.integers(0, 2**63, 12).tolist():
        fps.add(centre)
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(1, 9)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= set(rng.integers(0, 2**63, 300).tolist())
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint").repartition(5)
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, radius)).collect()}
    roots = components_reference([x & (2**64 - 1) for x in fps], radius)
    assert [found.get(x, x) for x in fps] == [fps[r] for r in roots]


def test_correlated_bits_share_a_partition():
    corr = np.eye(64)
    for a in range(0, 64, 2):
        corr[a, a + 1] = corr[a + 1, a] = 0.9
    groups = simhash.group_bits(corr, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    assert all(b ^ 1 in g for g in groups for b in g)


def test_simhash_odd_rows(spark, odd):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_copies(odd).collect()]
    assert Counter(got) == Counter([(1, 1), (2, 1), (5, 1), (None, 4), (4, 4), (4, 4), (6, 6), (7, 7)])
    assert simhash.near_copies(odd.limit(0)).count() == 0
    kept = simhash.one_of_each(odd)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7] and kept.columns == odd.columns
    nameless = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (3, "q r s t u v")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in simhash.one_of_each(nameless).collect()) == ["a b c d e", "q r s t u v"]


def test_survivors_are_rows(spark):
    """One id over two texts: each of the two groups keeps one row, the same one on every layout."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "y"), (3, a, "z"), (1, a, "x"), (4, "another text that stands alone here", "w")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(3)
        assert sorted(map(tuple, simhash.one_of_each(df).collect())) == sorted([(1, a, "x"), (1, b, "x"), (4, "another text that stands alone here", "w")])


# ----------------------------------------------------------------------------------------------------- toxicity


def test_gradients():
    model = toxicity.Model({}, {})
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, model.INPUTS, 3)).astype(np.float32)
    mask = np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    y = np.array([1, 0, 1], np.float32)
    g = model.gradients(x, mask, y)
    loss = lambda: float(-np.mean(y * np.log(p := model.run(x, mask)) + (1 - y) * np.log(1 - p)))
    for k in ("v", "A", "a", "b", "Wf", "Ub", "kf"):
        flat = model.p[k].reshape(-1)
        i = int(np.argmax(np.abs(g[k].reshape(-1))))
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        # the rational tanh is not its own exact derivative, so the slope agrees only roughly
        assert (up - down) / 2e-2 == pytest.approx(float(g[k].reshape(-1)[i]), rel=0.35, abs=2e-3), k


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op5_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[i], r["score"]) for i, r in rows.items() if r["held_out"] and labels.get(i) is not None]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.95


def test_toxicity_windows_and_odd_rows(spark, odd):
    for n in (0, 5, 32, 33, 56, 57, 1000):
        starts = toxicity.windows_of(n)
        seen = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a <= toxicity.STEP for a, b in zip(starts, starts[1:]))
    texts = ["you are a stupid idiot and a moron"] * 6 + ["the sun is warm and the sea is calm today"] * 6
    model = toxicity.fit([f"{t} {i} {i * 7}" for i, t in enumerate(texts)], [1] * 6 + [0] * 6)
    got = {(r["doc_id"], round(r["score"], 6)) for r in toxicity.score(odd, model).collect()}
    assert len({s for i, s in got if i in (1, 2, 5)}) == 1
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.fit(["a"], [0]) == 0.01 and toxicity.fit([], []) == 0.01 and toxicity.fit(["a"], [1]) == 0.99
    long = "calm sea and warm sun " * 300
    low, high = toxicity.Scorer(model)([long, long + "you stupid idiot moron " + long])
    assert high > low


# ---------------------------------------------------------------------------------------------------------- bpe


def test_bpe_query(spark, documents):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in queries.op8_bpe(spark, SF).collect()}
    for d in documents:
        ids = enc.encode_ordinary(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_safe_parts():
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    alphabet = list("aé7.,' \n\t\x1c 　st!") + ["'re", "  ", "\r\n"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, 80))
        assert "".join(bpe.safe_parts(text, 5)) == text
        assert bpe.encode_text(enc, text, 5).tolist() == enc.encode_ordinary(text), repr(text)


def test_bpe_odd_rows(spark, odd):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe.encode(odd, path, pattern, keep=odd.columns)
    assert dict(made.dtypes)["ids"] == "binary" and made.count() == len(ODD)
    back = {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(made, path, pattern).collect()}
    assert back == {(i, (t or "").encode()) for i, t, *_ in ODD}
    assert bpe.encode(odd.limit(0), path, pattern).count() == 0


# ------------------------------------------------------------------------------------------------------- mixing


def targets_reference(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, share = total - sum(capped.values()), sum(w[s] for s in order if s not in capped)
        now = {s: left * w[s] / share for s in order if s not in capped} if share else {}
        over = [s for s, t in now.items() if t > cap * sizes[s]]
        if not over:
            return {**now, **capped}
        capped |= {s: cap * sizes[s] for s in over}


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    want = targets_reference(dict(sizes))
    taken = defaultdict(int)
    source = {d["doc_id"]: d["source"] for d in docs}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 48, s


def test_mixing_query(spark, documents):
    rows = queries.op9_mixing(spark, SF).collect()
    assert len(rows) == len(documents)
    check_mix(rows, documents)
    again = queries.op9_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_targets_fill_up_small_sources(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "é": 7, None: 500, "z": 40}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in targets_reference(sizes).items()}


def test_permutation(spark):
    for n in (1, 2, 3, 31, 32, 33, 1000):
        got = sorted(r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect())
        assert got == list(range(n))


def test_mix_keeps_words(spark, odd):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(n)), "en", s, n) for i, (s, n) in enumerate([("a", 100), ("a", 3), ("b", 700), (None, 50), ("b", 0), ("c", 33)])]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(df, block_words=8, shards=4, keep=df.columns)
    words = Counter(w for r in mixing.remixed(df, block_words=8, shards=4).collect() for w in r["text"].split())
    taken = {r["doc_id"]: r["taken"] for r in mixing.accounts(mixed).collect()}
    by_doc = Counter()
    for w, n in words.items():
        by_doc[int(w[1:].split("_")[0])] += n
    assert {i: by_doc[i] for i in taken} == taken and max(words.values()) <= 3
    blocks = Counter(w for r in mixing.block_texts(mixed).collect() for w in r["text"].split())
    assert blocks == words
    shards = Counter(r["shard"] for r in mixed.slots.collect())
    assert set(shards) <= set(range(4)) and sum(shards.values()) == sum(r["slots"] for r in mixed.sources.collect())
    assert mixing.accounts(mixing.mix(odd)).count() == len(ODD)
    assert mixing.remixed(odd.limit(0)).count() == 0 and mixing.remixed(odd).columns == odd.columns
    assert math.isclose(sum(r["target"] for r in mixing.mix(odd).sources.collect()), sum(len((t or "").split()) for _, t, *_ in ODD))


# ----------------------------------------------------------------------------------------------------- pipeline


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        kept[name] = docs
        assert docs.columns == columns or name == "byte_level_bpe"
    clean, single, masked, mixed, ids = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert {r["doc_id"] for r in single.collect()} <= {r["doc_id"] for r in clean.collect()}
    assert clean.count() >= 0.8 * len(documents)
    rows = sorted(clean.collect(), key=lambda r: r["doc_id"])
    roots = components_reference([fingerprint_reference(r["text"] or "") for r in rows])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({rows[i]["doc_id"] for i in roots})
    assert masked.count() == single.count()
    assert not any(base_reference(r["text"] or "") for r in masked.collect())
    assert ids.count() == mixed.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table through every stage."""
    import corpus_pipeline

    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.materialize(stage(spark, docs, SF), f"odd-{name}")
            assert after.columns == odd.columns
            assert {v for c in ("score", "base", "candidates", "taken") for (v,) in after.select(c).distinct().collect()} <= {"clash"}
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
