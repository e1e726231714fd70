"""Personal data: plain spans against the patterns as they stand, disguised ones planted in prose."""

import hashlib
import random
import re
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    """Base spans by the patterns as they are stated."""
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and checksum(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@-+ 0(%_é9", max_size=60))
def test_plain_spans_are_those_of_the_patterns(text):
    assert pii.plain(text) == brute(text)


DISGUISED = [
    ("email", "jane (at) example (dot) com"),
    ("email", "jane.doe [at] mail [dot] example [dot] org"),
    ("email", "jane dot doe at mail dot example dot net"),
    ("email", "jane_at_example_dot_com"),
    ("email", "jane @ example.com"),
    ("email", "jane&#64;example&#46;com"),
    ("email", "jane＠example．com"),
    ("email", "jаne@exаmple.com"),  # two Cyrillic letters
    ("email", "jane{at}example{punto}es"),
    ("email", "ja­ne@exam​ple.com"),
    ("ip", "192 dot 168 dot 1 dot 10"),
    ("ip", "192[.]168[.]1[.]10"),
    ("ip", "one nine two dot one six eight dot one dot seven"),
    ("ip", "１９２.１６８.１.１０"),
    ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "4111​1111 1111 1111"),
    ("card", "four one one one, one one one one, one one one one, one one one one"),
    ("card", "4111 1111 11l1 11I1"),
    ("card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("phone", "plus four nine, one seven double two, three four five six seven"),
    ("phone", "+1 (four one five) 555 2671"),
    ("phone", "+1 (O17) 555-77l3"),
    ("phone", "＋49 30–123‑4567"),
    ("phone", "más tres cuatro seis uno dos tres cuatro cinco seis siete"),
]


@pytest.mark.parametrize("kind,hidden", DISGUISED)
def test_disguised_forms_keep_their_offsets(kind, hidden):
    for before, after in (("", ""), ("Bitte schreib: ", " und dann, é."), ("\n​ñ ", "\nNext line"), ("(", ")"), ("x, ", ".")):
        text = before + hidden + after
        base = pii.plain(text)
        found = [(k, text[a:b]) for k, a, b in pii.disguised(text, base)]
        assert found == [(kind, hidden)], (text, found)
        assert base == brute(text)


CLEAN = [
    "Look at example.com today.", "We meet at noon - version 1.2.3.4.5 is out", "x (at) 5.30 pm", "at home dot dot dot", "one two three", "un deux trois, soleil",
    "Call +1 415 555 2671 I am there at 5", "| +1 (599) 555-3756 |", "a.b@c.com, d@e.fr", "10.0.0.1 and 10.0.0.2", "IOOl lO 10 SOO", "price 5 . 10 . 20", "f(at) = 5 [dot] x", "4111 1111 1111 1111 l",
    "one dot two dot three", "phone at example dot", "Ελληνικά και русский текст 12.5", "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_gain_nothing(text):
    assert pii.disguised(text, pii.plain(text)) == []


def test_added_spans_beside_a_part_that_is_plain():
    text = "jane dot doe@example.com"
    base = pii.plain(text)
    assert [text[a:b] for _, a, b in base] == ["doe@example.com"]
    assert [text[a:b] for _, a, b in pii.disguised(text, base)] == [text]


@pytest.mark.parametrize("unit", ["1", "a", "a.", "a@", "1 ", "1.", "one ", "x at b dot com ", "é at b dot com ", "1 1l", "+1 ", "((", "a-", "lO", "_at_", "one dot "])
def test_long_texts_take_time_in_proportion(unit):
    times = []
    for n in (50_000, 400_000):
        text = unit * (n // len(unit))
        start = time.process_time()
        pii.disguised(text, pii.plain(text))
        times.append(time.process_time() - start)
    assert times[1] < 32 * max(times[0], 0.02)


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = {r["doc_id"]: r for r in QUERIES["op12_pii"][0](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        base = brute(text)
        listed = ",".join(":".join(map(str, s)) for s in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert rows[i]["spans"] == listed  # these tables hold no disguised data
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]


def test_defined_results(spark):
    rng = random.Random(5)
    prose = " ".join(rng.choice(["Haus", "la", "the", "voilà"]) for _ in range(40_000))
    rows = [(1, None), (2, ""), (None, "mail a@b.com"), (3, "a@b.com"), (3, "a@b.com"), (4, prose + " jane (at) example (dot) com " + prose)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as base", "'y' as spans", "1 as kind", "2 as __text")
    found = pii.find(docs, keep=["doc_id", "kind"])
    got = sorted((r["doc_id"] or 0, r["kind"], [tuple(s) for s in r["spans"]]) for r in found.collect())
    mail = [("email", 0, 7)]
    n = len(prose) + 1
    assert got == [(0, 1, [("email", 5, 12)]), (1, 1, []), (2, 1, []), (3, 1, mail), (3, 1, mail), (4, 1, [("email", n, n + len("jane (at) example (dot) com"))])]
    assert pii.find(docs, keep=["doc_id", "base"]).columns == ["doc_id", "base", "spans"]
    assert pii.find(docs.limit(0)).collect() == []
