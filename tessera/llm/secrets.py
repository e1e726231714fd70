"""Secrets in texts: three fixed patterns, and strings that a randomness battery cannot tell from random ones.

Base spans: assignments, access keys and long hexadecimal strings (see ``base_spans``). What is left of every run of the
base64 alphabets outside base spans is cut at inner ``=``; a piece with marks of both alphabets is cut into its maximal
parts of either one, which may overlap. Every part of ``MIN_LENGTH`` or more characters is a candidate. Its encoding is the
smallest alphabet that holds it. Three tests ask whether it could be drawn uniformly from that alphabet: the
chi-squared test of uniformity, the runs test about the median symbol and the serial correlation at lag one. Their
combined p value (Bonferroni) is the score.

False discoveries are controlled by length and encoding. Decoys are ordinary mixed strings: words of a text drawn at
random and written as identifiers of an encoding (words with capitals, numbers, dates and marks; see ``ordinary``). Each
candidate brings ``DECOYS`` of its encoding and length, and every text with words brings as many of encodings and lengths
drawn by its hash, so that the decoys of a class come from the whole corpus. They pass the same battery. A histogram by
(encoding, length class, score class) gives the share of decoys at each score or above; this share of all candidates of the
class is what ordinary strings would make up among those reported. A candidate is reported where that is at most ``RATE`` of
them and its score is at least ``ACCEPT``. A class in which more than ``WEAK`` of the
decoys pass is never reported: there the battery cannot tell. A class with fewer than ``ENOUGH`` decoys is reported only at lengths at which the
battery has power (``POWER``: at most 1 % of ordinary strings pass).

Defined results: null text = empty text = no spans. Offsets are code points, end exclusive. Repeated rows have
repeated results. An empty table gives an empty table and no thresholds. Long texts are read whole. Equal scores share a
score class and are reported together or not at all. ``scan`` and ``find`` replace kept columns of the names they add;
``redact`` renames all columns while it works, so none can clash.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

# The three patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex")

MIN_LENGTH, DECOYS = 20, 4
ACCEPT, RATE = 0.01, 0.01
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Pieces between inner equals signs, with the padding that ends them, and maximal parts of either alphabet.
PIECE = re.compile(r"[A-Za-z0-9+/_-]+=*")
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"))
ORDINARY = re.compile(r"[A-Za-z]{2,15}")
BLANK = re.compile(r"\s")
#: Encodings from the smallest alphabet to the largest, with symbols in value order.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567",
    "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER, "alpha": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Digits alone are numbers, not secrets.
REPORTED = frozenset(ENCODINGS) - {"decimal"}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_VALUES = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}
LENGTHS = (24, 32, 48, 64, 128, 1 << 62)
SCORES = 16
#: Words drawn from a long text without candidates, and the length below which its decoys of the highest class stay; the
#: decoys that a candidate brings have its own length.
DRAWN, TOP = 400, 256
#: The fewest decoys that support a rate, and the most of them that may pass ``ACCEPT``: above, the battery has no power; and the first length class with power, measured with 700 ordinary
#: strings a class (words of sf0.01); HEX has none: 1.1 % pass even at 128 to 256 characters.
ENOUGH = 200
WEAK = 0.1
POWER = {"BASE36": 4, "alpha": 3, "base32": 3, "base36": 4, "base62": 3, "base64": 3, "base64url": 3, "hex": 5, "lower": 3, "upper": 3}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns, leftmost and non-overlapping for each kind, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds a token; None for a mixture of alphabets."""
    used = frozenset(token)
    return next((name for name, symbols in _SETS.items() if used <= symbols), None)


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(500):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-12:
                break
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, encoding: str) -> tuple[float, float, float]:
    """p values of uniformity (chi-squared), runs and serial correlation for a token in its alphabet."""
    values = np.array([_VALUES[encoding][c] for c in token], float)
    n, k = len(values), len(ENCODINGS[encoding])
    counts = np.bincount(values.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    uniform = _upper_gamma((k - 1) / 2, chi / 2)
    above = values > (k - 1) / 2
    a = int(above.sum())
    b = n - a
    runs = 0.0
    if a and b:
        r = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((r - mean) / math.sqrt(var)) if var > 0 else 1.0
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = 0.0
    if power:
        rho = float((centred[1:] * centred[:-1]).sum()) / power
        serial = _two_sided((rho + 1 / n) * math.sqrt(n))
    return uniform, runs, serial


def score_of(token: str) -> tuple[str, int, float] | None:
    """(encoding, length class, combined p value) of a token without its padding; None if it has no single alphabet."""
    bare = token.rstrip("=")
    name = encoding_of(bare) if len(bare) >= MIN_LENGTH else None
    return None if name is None else (name, bisect_left(LENGTHS, len(bare) + 1), min(1.0, 3 * min(battery(bare, name))))


def score_class(p: float) -> int:
    """Classes of the combined p value: 0 below 1e-4, then four to each power of ten."""
    return 0 if p < 1e-4 else min(SCORES, 1 + int(4 * (4 + math.log10(p))))


def ordinary(rng: random.Random, words: list[str], encoding: str, length: int) -> str:
    """An ordinary string of an encoding: words, numbers and dates, cut to a length."""
    symbols, out, size = _SETS[encoding], [], 0
    numbers = DIGITS[0] in symbols
    case = {"lower": str.lower, "base36": str.lower, "upper": str.upper, "base32": str.upper, "BASE36": str.upper}.get(encoding)
    marks = {"base64": "/+", "base64url": "-_"}.get(encoding, "")
    while size < length:
        kind = rng.random()
        if encoding in ("hex", "HEX", "decimal") or numbers and kind < 0.2:
            piece = f"{rng.randrange(1990, 2031)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}" if kind < 0.04 else str(rng.randrange(10 ** rng.randrange(1, 4)))
            if encoding != "decimal" and encoding.lower() == "hex" and rng.random() < 0.7:
                piece += "".join(c for c in rng.choice(words).lower() if c in "abcdef")
                piece = piece.upper() if encoding == "HEX" else piece
        elif encoding == "base32" and kind < 0.2:
            piece = rng.choice("234567")
        else:
            w = rng.choice(words)
            piece = case(w) if case else w.capitalize() if kind < 0.9 else w.lower()
        if marks and out and rng.random() < 0.5:
            piece = (marks[0] if rng.random() < 0.8 else marks[1]) + piece
        out.append(piece)
        size += len(piece)
    return "".join(out)[:length]


def parts_of(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates: parts of one alphabet, MIN_LENGTH or more without padding, outside base spans."""
    out, spans = [], sorted((s, e) for _, s, e in base)
    for m in CANDIDATE.finditer(text):
        pieces, at = [], m.start()
        for s, e in spans:
            if s < m.end() and e > at:
                pieces.append((at, max(at, s)))
                at = e
        pieces.append((at, m.end()))
        for a, b in pieces:
            for piece in PIECE.finditer(text, a, max(a, b)):
                if encoding_of(piece.group().rstrip("=")) is not None:
                    out.append(piece.span())
                else:
                    out += sorted({x.span() for alphabet in ALPHABETS for x in alphabet.finditer(text, *piece.span())})
    return [(a, b) for a, b in out if len(text[a:b].rstrip("=")) >= MIN_LENGTH]


def ordinary_words(text: str) -> list[str]:
    """Ordinary words of a text: all of a short one, else those at ``DRAWN`` places drawn over the whole text by its hash."""
    if len(text) <= 40 * DRAWN:
        return ORDINARY.findall(text)
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ 0x5EED)
    found = []
    for place in rng.choices(range(len(text)), k=DRAWN):
        blank = BLANK.search(text, place)  # a place inside a word would cut it
        m = ORDINARY.search(text, blank.end() if blank else 0)
        if m:
            found.append(m.group())
    return found


def scan_text(text: str):
    """Base spans, candidates (start, end, encoding, length class, score class, passes) and decoys' classes."""
    base = base_spans(text)
    candidates, decoys = [], []
    for s, e in parts_of(text, base):
        scored = score_of(text[s:e])
        if scored is not None and scored[0] in REPORTED:
            name, length, p = scored
            candidates.append((s, e, name, length, score_class(p), p >= ACCEPT))
    words = ORDINARY.findall(text)
    if len(words) >= 5:
        rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
        bounds = [(MIN_LENGTH, *LENGTHS, TOP)[k : k + 2] for k in rng.choices(range(len(LENGTHS)), k=DECOYS)]
        wanted = [(rng.choice(sorted(REPORTED)), rng.randrange(low, min(high, TOP))) for low, high in bounds]
        wanted += [(name, len(text[s:e].rstrip("="))) for s, e, name, *_ in candidates for _ in range(DECOYS)]
        for name, n in wanted:
            p = min(1.0, 3 * min(battery(ordinary(rng, words, name, n), name)))
            decoys.append((name, bisect_left(LENGTHS, n + 1), score_class(p) if p >= ACCEPT else 0))
    return base, candidates, decoys


SPAN = "struct<kind:string,start:bigint,end:bigint>"
CANDIDATES = "struct<start:bigint,end:bigint,encoding:string,length:int,score:int,passes:boolean>"
SCANNED = f"base array<{SPAN}>, candidates array<{CANDIDATES}>, decoys array<struct<encoding:string,length:int,score:int>>"


def scan(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``base`` spans, ``candidates`` and ``decoys`` of each whole text."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int32()), ("score", pa.int32()), ("passes", pa.bool_())]))
    dec = pa.list_(pa.struct([("encoding", pa.string()), ("length", pa.int32()), ("score", pa.int32())]))

    def rows(found, kind):
        names = [f.name for f in kind.value_type]
        return pa.array([[dict(zip(names, x)) for x in some] for some in found], kind)

    def setup():
        def work(texts: list[str]) -> list[pa.Array]:
            made = [scan_text(t) for t in texts]
            return [rows([m[i] for m in made], kind) for i, kind in enumerate((span, cand, dec))]

        return work

    return map_texts(docs, keep, text_col, SCANNED, setup)


def thresholds(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, length, least): the lowest score class reported; classes that never reach ``rate`` are missing.

    Counts are over all rows. The result has at most 12 encodings x 6 lengths rows.
    """
    def counts(name: str):
        x = scanned.select(F.explode(name).alias("x"))
        # candidates that do not pass are never reported: they count at the lowest score only
        x = x.select("x.encoding", "x.length", F.expr("if(x.passes, x.score, 0)").alias("score") if name == "candidates" else F.col("x.score"))
        return x.groupBy("encoding", "length", "score").agg(F.count(F.lit(1)).alias("n"))

    both = counts("candidates").select("encoding", "length", "score", "n", F.lit(0).alias("d")).unionByName(
        counts("decoys").select("encoding", "length", "score", F.lit(0).alias("n"), F.col("n").alias("d"))
    )
    tail = both.withColumn("least", F.explode(F.sequence(F.lit(0), "score"))).groupBy("encoding", "length", "least").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    made = both.groupBy("encoding", "length").agg(F.sum("n").alias("all_n"), F.sum("d").alias("all_d"), F.sum(F.expr("if(score > 0, d, 0)")).alias("passing"))
    strong = F.expr(" or ".join(f"(encoding = '{k}' and length >= {v})" for k, v in POWER.items()))
    able = (F.col("passing") <= WEAK * F.col("all_d")) & (F.col("d") * F.col("all_n") <= rate * F.col("n") * F.col("all_d"))
    fair = F.when(F.col("all_d") >= ENOUGH, able).otherwise(strong)
    return tail.join(made, ["encoding", "length"]).filter((F.col("n") > 0) & fair).groupBy("encoding", "length").agg(F.min("least").alias("least"))


def flagged(scanned: DataFrame, least: DataFrame) -> DataFrame:
    """Scanned rows with ``spans``: base spans and reported candidates (kind ``random``), by start and then kind."""
    pairs = [(f"{r['encoding']}:{r['length']}", r["least"]) for r in least.collect()]  # at most 72
    table = F.create_map(*[F.lit(x) for pair in sorted(pairs) for x in pair]) if pairs else F.expr("map('', 99)")
    found = scanned.withColumn("__least", table)
    reported = F.expr(
        "transform(filter(candidates, c -> c.passes and c.score >= coalesce(element_at(__least, concat_ws(':', c.encoding, c.length)), 99)), "
        "c -> named_struct('start', c.start, 'rank', 3, 'kind', 'random', 'end', c.end))"
    )
    base = F.expr("transform(base, b -> named_struct('start', b.start, 'rank', case b.kind when 'assign' then 0 when 'access' then 1 else 2 end, 'kind', b.kind, 'end', b.end))")
    return found.withColumn("spans", F.array_sort(F.concat(base, reported))).drop("__least")


def find(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans`` of every row; the scan is written once to the shared folder."""
    scanned = materialize(scan(docs, text_col, keep), "secrets")
    return flagged(scanned, thresholds(scanned)).drop("candidates", "decoys")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` (overlapping spans by one) and the length column, if any, renewed."""
    columns = docs.columns
    own = {c: f"__c{i}" for i, c in enumerate(columns)}  # no name of the caller meets one of the operator
    raw = own[text_col]
    found = find(docs.toDF(*own.values()), raw, own.values())
    clean = F.expr(
        f"""case when size(spans) = 0 then {raw} else concat_ws('',
            transform(aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>),
                (acc, s) -> if(size(acc) > 0 and element_at(acc, -1).b > s.start,
                    concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.end)))),
                    concat(acc, array(named_struct('a', s.start, 'b', s.end)))),
                acc -> transform(acc, (x, i) -> named_struct('from', if(i = 0, 0L, acc[i - 1].b), 'to', x.a))),
              p -> concat(substring({raw}, cast(p.from as int) + 1, cast(p.to - p.from as int)), '{mask}')),
            substring({raw}, cast(array_max(transform(spans, s -> s.end)) as int) + 1)) end"""
    )
    out = found.withColumn("clean", clean)
    chars = F.when(F.size("spans") > 0, F.length("clean").cast(dict(docs.dtypes).get(chars_col, "bigint")))
    made = {text_col: F.col("clean"), chars_col: chars.otherwise(F.col(own[chars_col])) if chars_col in own else None}
    return out.select(*[made.get(c, F.col(mine)).alias(c) for c, mine in own.items()])
