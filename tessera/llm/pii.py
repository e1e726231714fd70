"""Personal data in texts: plain and disguised e-mail addresses, IP addresses, card and phone numbers, with offsets.

Plain identifiers are found by one pattern a kind, leftmost and without overlaps (``base``). Disguised ones are found
in a normalised text that keeps its offsets. A ``Tape`` is a text with, for every character, the source span that it
came from; a transducer rewrites a tape from left to right and gives what it writes the span of what it read. In order:

1. ``characters``: homoglyphs, full-width and mathematical forms and foreign digits become the ASCII characters that
   they look like, odd blanks and dashes the plain ones, invisible characters nothing.
2. ``marks``: "(at)", "[dot]", "&#64;" and the like become "@" and ".".
3. ``spelled``: runs of four or more digits with words among them ("plus four nine, one double two ...") become
   digits; the words are those of four languages. Letters that look like digits become digits beside digits.
4. ``numbers``: "10 dot 0 dot 0 dot 1" becomes dotted.
5. ``addresses``: "jane at mail dot example dot com", "jane @ example.com", "jane_at_example_dot_com". A bare "at" needs
   a disguised dot in the domain, as "at example.com" is ordinary prose.

Then the kinds' patterns run on the normalised text, with word limits around them and letters as the last label of a
domain. A span goes back to the source characters from the first to the last of its characters; it is added where the
source differs from the normalised characters and no base span of its kind holds it.

Defined results: null text = empty text: no spans. Texts are read whole, whatever their length, with patterns that
take time in proportion to the text. Offsets are code points, ends exclusive. Equal spans of a kind occur once; spans
of different kinds may overlap. Repeated rows give repeated rows, an empty table an empty table. Columns that are not
kept do not matter; a kept column called ``base`` or ``spans`` is replaced by the operator's.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int>>"
Span = tuple[str, int, int]

# --------------------------------------------------------------------------------------------------------- plain forms

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: if it failed at the start of the run, it fails there too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their "@" in one pass."""
    free = 0
    for m in AT_DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def is_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found.split("."))


def is_card(found: str) -> bool:
    digits = NO_DIGIT.sub("", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 9 <= len(NO_DIGIT.sub("", found)) <= 15


NUMBERS = (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone))


def plain(text: str) -> list[Span]:
    """The base spans, by kind as listed, then by start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for kind, pattern, fits in NUMBERS:
        if kind != "phone" or "+" in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(m.group())]
    return found


# ---------------------------------------------------------------------------------------------------------- transducers


class Tape:
    """A text, and for each of its characters the source span [starts, ends) that it stands for."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """The tape with [start, end) replaced by a text, for edits in order that do not overlap."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            if a < b:
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        return Tape("".join(text), starts, ends)


# fixed values: letters of other scripts and the ASCII letters they look like
LOOKALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "Ӏ": "I",
    # Greek
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Latin letters without their dot or with another shape, dots and at signs
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "·": ".", "․": ".", "。": ".", "｡": ".", "•": ".", "∙": ".", "⋅": ".", "﹫": "@", "ⓐ": "a",
}
KEPT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+-_%()[]{}<> ")


class _Looks(dict):
    """What a character is rewritten to: itself, a look-alike, or nothing."""

    def __missing__(self, c: str) -> str:
        made = c
        if c > "\x7f":
            if c in LOOKALIKES:
                made = LOOKALIKES[c]
            elif unicodedata.category(c) == "Cf":
                made = ""  # zero width, soft hyphen, marks of direction
            elif unicodedata.category(c) == "Zs":
                made = " "
            elif unicodedata.category(c) == "Pd" or c == "−":
                made = "-"
            elif unicodedata.decimal(c, None) is not None:
                made = str(unicodedata.decimal(c))
            else:
                form = unicodedata.normalize("NFKC", c)
                made = form if len(form) == 1 and form in KEPT else c
        self[c] = made
        return made


LOOKS = _Looks()


def characters(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    odd = "".join(c for c in set(tape.text) if LOOKS[c] != c)
    if not odd:
        return tape
    return tape.rewrite([(m.start(), m.end(), LOOKS[m.group()]) for m in re.finditer(f"[{re.escape(odd)}]", tape.text)])


BLANK = r"[ \t]{0,8}"
AT_WORD = r"(?:at|@|arroba|arobase|ät)"
DOT_WORD = r"(?:dot|punkt|punto|point|period|ponto)"
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
AT_MARK = re.compile(rf"{BLANK}(?:{OPEN}{BLANK}{AT_WORD}{BLANK}{SHUT}|&#0*64;|&#x0*40;|&commat;|%40){BLANK}", re.I)
DOT_MARK = re.compile(rf"{BLANK}(?:{OPEN}{BLANK}(?:{DOT_WORD}|\.){BLANK}{SHUT}|&#0*46;|&#x0*2e;|&period;){BLANK}", re.I)


def marks(tape: Tape) -> Tape:
    if "&" in tape.text or "%" in tape.text or any(c in tape.text for c in "[({<"):
        tape = tape.rewrite([(m.start(), m.end(), "@") for m in AT_MARK.finditer(tape.text)])
        tape = tape.rewrite([(m.start(), m.end(), ".") for m in DOT_MARK.finditer(tape.text)])
    return tape


# fixed values: names of the digits 0 to 9
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
VALUES = {word: str(i) for names in DIGIT_WORDS for i, word in enumerate(names.split())} | {"oh": "0", "o": "0", "zwo": "2", "fuenf": "5", "ein": "1", "une": "1", "fiver": "5", "niner": "9"}
TIMES = {"double": 2, "triple": 3, "treble": 3, "doppel": 2, "doble": 2}
PLUS = {"plus": "+", "más": "+", "mas": "+"}
_names = "|".join(sorted([*VALUES, *TIMES, *PLUS], key=len, reverse=True))
_first = "|".join(sorted([*(v for v in VALUES if v != "o"), *TIMES, *PLUS], key=len, reverse=True))
GAP = r"[ \t\n,;/()-]{1,4}"
#: A run: names and numerals, at least four of them, with short gaps or a spelled dot between.
RUN = re.compile(rf"(?<!\w)(?:(?:{_first})|\+?[0-9]{{1,4}}(?={GAP}(?:{_names})(?!\w)))(?!\w)(?:(?:{GAP}{DOT_WORD})?{GAP}(?:{_names}|[0-9]{{1,4}})(?!\w)){{3,}}", re.I)
ITEM = re.compile(rf"(?P<dot>{DOT_WORD})|(?P<name>{_names})|(?P<digits>[0-9]+)|(?P<plus>\+)|(?P<gap>[ \t\n,;/()-]+)", re.I)


def _digits(run: str) -> str | None:
    """What a run says; numerals apart from spelled digits keep the gap between them."""
    out, times, names, gap, numeral = [], 1, 0, "", False
    for m in ITEM.finditer(run):
        word = m.group().lower()
        if m.lastgroup == "gap":
            gap = word
            continue
        if m.lastgroup == "dot":
            out.append(".")
        elif m.lastgroup == "plus" or word in PLUS:
            out.append("+")
        elif word in TIMES:
            times = TIMES[word]
            names += 1
            continue
        elif m.lastgroup == "digits":
            out.append((" " if numeral and gap else "") + word * times)
        else:
            out.append(VALUES[word] * times)
            names += 1
        times, gap, numeral = 1, "", m.lastgroup == "digits"
    return "".join(out) if names >= 2 and times == 1 else None


LIKE_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1"}
#: Groups of digits and such letters; possessive and without a condition after it, so a run is read once.
MIXED = re.compile(r"(?<![\w.@-])(?=[0-9+]|[OolI]{1,3}[0-9])\+?[0-9OolI]++(?:[ .-][0-9OolI]++)*+")
MIXED_GROUP = re.compile(r"[0-9OolI]+")
LETTER = re.compile(r"[OolI]")


def like_digits(tape: Tape) -> Tape:
    """Letters within a group that has a digit, in a run with twice as many digits as letters."""
    edits = []
    for m in MIXED.finditer(tape.text):
        if LETTER.search(m.group()) and not tape.text[m.end() : m.end() + 1].isalnum():
            groups = [g for g in MIXED_GROUP.finditer(m.group()) if any(map(str.isdigit, g.group()))]
            letters = [i for g in groups for i, c in enumerate(g.group(), m.start() + g.start()) if c in LIKE_DIGITS]
            if sum(map(str.isdigit, m.group())) >= 2 * len(letters):
                edits += [(i, i + 1, LIKE_DIGITS[tape.text[i]]) for i in letters]
    return tape.rewrite(edits)


def spelled(tape: Tape) -> Tape:
    edits = []
    for m in RUN.finditer(tape.text):
        said = _digits(m.group())
        if said is not None:
            edits.append((m.start(), m.end(), said))
    return like_digits(tape.rewrite(edits))


DOTTED = re.compile(rf"(?<=[0-9])[ \t_-]{{1,8}}{DOT_WORD}[ \t_-]{{1,8}}(?=[0-9])", re.I)
SPACED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])")


def numbers(tape: Tape) -> Tape:
    tape = tape.rewrite([(m.start(), m.end(), ".") for m in DOTTED.finditer(tape.text)])
    gaps = [(m.start() + g.start(), m.start() + g.end(), ".") for m in SPACED.finditer(tape.text) for g in re.finditer(r" ?\. ?", m.group()) if len(g.group()) > 1]
    return tape.rewrite(gaps)


_SEP = r"(?:[ \t]{1,8}|_|-)"
_AT = rf"(?P<at>{_SEP}(?:at|arroba|arobase)(?:[ \t]{{1,8}}|_|-)|[ \t]{{1,8}}@[ \t]{{0,8}}|@[ \t]{{0,8}})"
_DOT = rf"(?:{_SEP}{DOT_WORD}{_SEP}|\.)"
_LABEL = r"(?:(?!(?:at|dot|punkt|punto|point|period|ponto)(?![a-z0-9]))[a-z0-9]+(?:-(?!(?:at|dot|punkt|punto|point|period|ponto)[-_])[a-z0-9]+)*)"
ADDRESS = re.compile(
    rf"(?<![\w.%+-])(?P<local>{_LABEL}(?:(?:{_SEP}{DOT_WORD}{_SEP}|[.%+]|_(?!(?:at|dot)_)){_LABEL}){{0,8}}){_AT}(?P<domain>{_LABEL}(?:{_DOT}{_LABEL}){{1,8}})(?!\w)", re.I
)
A_DOT = re.compile(rf"{_SEP}{DOT_WORD}{_SEP}", re.I)
#: What an address in words must have somewhere: "at" or "@", and a domain after it.
TRIGGER = re.compile(rf"(?:(?:[ \t]|_|-)(?:at|arroba|arobase)(?:[ \t]|_|-)|@)[ \t]{{0,8}}(?P<domain>{_LABEL}(?:{_DOT}{_LABEL}){{1,8}})", re.I)
BEFORE = 256  # characters before the "at" in which the local part starts: nine labels


def addresses(tape: Tape) -> Tape:
    text, edits, free = tape.text, [], 0
    for t in TRIGGER.finditer(text):
        if t.group()[0] != "@" or text[t.start() - 1 : t.start()] in ("", " ", "\t") or text[t.start() + 1] in " \t" or A_DOT.search(t.group()):
            bare = "@" not in t.group()
        elif A_DOT.search(text, max(free, t.start() - BEFORE), t.start()):
            bare = False  # a plain "@" after "jane dot doe"
        else:
            continue
        if bare and not (A_DOT.search(t.group("domain")) or _changed(tape, *t.span("domain"))):
            continue
        for m in ADDRESS.finditer(text, max(free, t.start() - BEFORE), t.end()):
            if m.start("at") <= t.start() < m.end("at"):
                local, domain = A_DOT.sub(".", m.group("local")), A_DOT.sub(".", m.group("domain"))
                edits.append((m.start(), m.start("at"), local))
                edits.append((*m.span("at"), "@"))
                edits.append((*m.span("domain"), domain))
                free = m.end()
                break
    return tape.rewrite(edits)


def _changed(tape: Tape, a: int, b: int) -> bool:
    """Whether some character of the range is not a plain copy."""
    starts, ends = tape.starts, tape.ends
    return isinstance(starts, list) and (any(ends[i] - starts[i] != 1 for i in range(a, b)) or any(y - x != 1 for x, y in pairwise(starts[a:b])))


TRANSDUCERS: tuple[Callable[[Tape], Tape], ...] = (characters, marks, spelled, numbers, addresses)


def normalised(text: str) -> Tape:
    tape = Tape(text)
    for transducer in TRANSDUCERS:
        tape = transducer(tape)
    return tape


TLD = re.compile(r"[A-Za-z]{2,24}\Z")
WORD = re.compile(r"\w")


def disguised(text: str, base: list[Span]) -> list[Span]:
    """The spans that show only in the normalised text, by kind, then by start."""
    tape = normalised(text)
    if tape.text is text:
        return []
    found = []
    clean, starts, ends = tape.text, tape.starts, tape.ends
    held = {kind: [s for s in base if s[0] == kind] for kind in KINDS}
    for kind, a, b in plain(clean):
        if kind == "email":
            while clean[a] in ".%+-" and a < b:  # punctuation before an address is no part of it
                a += 1
            if not TLD.search(clean[a:b].rsplit(".", 1)[1]) or clean[a] == "@":
                continue
        before, after = clean[a - 1 : a], clean[b : b + 1]
        if kind != "phone" and (before.isalnum() or after.isalnum()):
            continue
        if kind == "ip" and (before == "." or (after == "." and clean[b + 1 : b + 2].isdigit())):
            continue
        start, end = starts[a], ends[b - 1]
        if text[start:end] != clean[a:b] and not any(s <= start and end <= e for _, s, e in held[kind]):
            found.append((kind, start, end))
    return sorted(set(found), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``base`` (plain spans) and ``spans`` (plain and disguised), by kind as in ``KINDS``, then by start."""

    def setup():
        made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def work(texts: list[str]) -> list[pa.Array]:
            base, spans = [], []
            for text in texts:
                found = plain(text)
                more = disguised(text, found)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                every = sorted(found + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else found
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in every])
            return [pa.array(base, made), pa.array(spans, made)]

        return work

    return map_texts(docs, keep, text_col, f"base {SPANS}, spans {SPANS}", setup)
