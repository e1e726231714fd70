"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree; every element gets features of itself and its surroundings (tag, attribute tokens, depth,
siblings, subtree size and density, share of linked text). Boosted trees give the odds that an element belongs to the
article. Decoding is hierarchical: each element is taken whole, left out whole, or decided by its parts, so that the
likelihood over the whole tree is greatest and no choice contradicts one above it. The text that an element holds itself
is a part like its children, so an article of bare text keeps it when an advert or comments inside it go.

Training needs no labelled table. It takes at most ``SAMPLE`` pages (smallest hash of their id) and rebuilds each
as its own layout and as invented ones: their text blocks are dealt to an article and to menus, headers, footers, side
columns, notices, adverts, forms and reader comments under varied tags and attribute tokens, whose labels are known
by construction; some articles hold bare text between line breaks. Layouts depend on the page id alone. Pages with an ``article`` element also train as they are, with
that element as the article.

Defined results: null html = empty html = no text, 0 characters. Markup may be cut off, unclosed or misnested; a tag
whose quote is never closed ends at its first ``>``. Repeated
rows have repeated results. Without any page to train on the text is all text outside elements that never hold
prose (scripts, styles, menus, forms). Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import pickle
import random
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SAMPLE = 80
INHERIT = 0.7
TREES, DEPTH, RATE, BINS, LEAF_ROWS, SHRINK = 40, 4, 0.3, 32, 20, 1.0

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
HIDDEN = RAW | frozenset("head button select option form canvas object audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
TAGS = ("a", "article", "aside", "blockquote", "body", "dd", "div", "dl", "figure", "footer", "form", "h1", "h2", "h3", "header", "li", "main", "nav", "ol", "p", "pre", "section", "span", "table", "td", "ul")
TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "depth")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent, self.children, self.text = tag, words, parent, [], None
        self.depth = parent.depth + 1 if parent else 0


def attribute_words(attributes: str) -> frozenset:
    """Lower-case words of class, id and role."""
    return frozenset(w for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role") for w in WORD.findall((m[2] or m[3] or m[4] or "").lower()))


def parse(source: str) -> Node:
    """The tree of a page; text stands in nodes with the tag ``#``. Unclosed and stray tags are repaired as browsers do, roughly."""
    root = here = Node("#root", frozenset(), None)
    at, n = 0, len(source)
    while at < n:
        m = TOKENS.match(source, at)
        at = m.end()
        closing, tag, attributes, closing_2, tag_2, attributes_2, text = m.groups()
        if tag_2 is not None:  # an attribute's quote is not closed
            closing, tag, attributes = closing_2, tag_2, attributes_2
        if text is not None:
            if here.children and here.children[-1].tag == "#":
                here.children[-1].text += text
            else:
                t = Node("#", frozenset(), here)
                t.text = text
                here.children.append(t)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            up = here
            while up.parent is not None and up.tag != tag:
                if up.tag in ("article", "main", "nav", "aside", "footer", "header", "section", "div", "table") and tag in ("p", "b", "i", "em", "strong", "span", "a", "li"):
                    break  # a stray inline end tag closes nothing above its block
                up = up.parent
            if up.parent is not None and up.tag == tag:
                here = up.parent
            continue
        if tag in ENDS_P:
            up = here
            while up.parent is not None and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            up = here
            while up.parent is not None and up.tag not in ("ul", "ol", "dl", "table", "select", "menu", tag):
                up = up.parent
            if up.tag == tag:
                here = up.parent
        node = Node(tag, attribute_words(attributes) if attributes else frozenset(), here)
        here.children.append(node)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            continue
        here = node
    return root


def elements(root: Node) -> list[Node]:
    """All elements that can hold prose, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "#" or node.tag in HIDDEN:
            continue
        out.append(node)
        stack.extend(reversed(node.children))
    return out


class Vocabulary:
    """Attribute words that training saw often enough, each a feature of an element and of what stands above it."""

    def __init__(self, words: Iterable[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.width = 17 + 2 * len(TAGS) + 2 * len(self.words)
        self.tags = {t: i for i, t in enumerate(TAGS)}


def features(root: Node, vocabulary: Vocabulary) -> tuple[list[Node], np.ndarray]:
    """The elements of a page and a row of features for each."""
    nodes = elements(root)
    place = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    chars, linked, count, paragraphs, marks = (np.zeros(n) for _ in range(5))
    own = np.zeros(n)
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        count[i] += 1
        if node.tag == "p":
            paragraphs[i] += 1
        for c in node.children:
            if c.tag == "#":
                size = len(c.text) - (c.text.count(" ") if c.text.isspace() else 0)
                size = 0 if c.text.isspace() else size
                own[i] += size
                marks[i] += c.text.count(".") + c.text.count(",")
        chars[i] += own[i]
        if node.tag == "a":
            linked[i] = chars[i]
        if node.parent is not None and (j := place.get(id(node.parent))) is not None:
            for a in (chars, linked, count, paragraphs, marks):
                a[j] += a[i]
    total = max(chars[0], 1.0)
    x = np.zeros((n, vocabulary.width), np.float32)
    t0 = 17
    v0 = t0 + 2 * len(TAGS)
    nt, nv = len(TAGS), len(vocabulary.words)
    around = [(1, 1, 0.0)] * n  # siblings, those of the same tag, place among them
    for node in nodes:
        kids = [c for c in node.children if c.tag != "#"]
        tags: dict[str, int] = {}
        for c in kids:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        for k, c in enumerate(kids):
            if (i := place.get(id(c))) is not None:
                around[i] = (len(kids), tags[c.tag], k / len(kids))
    up = np.array([place[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    over, has = np.maximum(up, 0), up >= 0
    before = np.cumsum(own) - own
    some = np.maximum(chars, 1)
    x[:, 0] = [node.depth for node in nodes]
    x[:, 1], x[:, 2], x[:, 3], x[:, 4], x[:, 5] = np.log1p(chars), np.log1p(own), linked / some, np.log1p(count), chars / count
    x[:, 6], x[:, 7], x[:, 8], x[:, 9], x[:, 10:13] = np.log1p(paragraphs), marks / some * 100, chars / total, before / total, around
    x[:, 13] = [len(node.children) for node in nodes]
    x[:, 14], x[:, 15], x[:, 16] = np.where(has, chars / some[over], 1), np.where(has, (linked / some)[over], 0), np.where(has, np.log1p(chars)[over], 0)
    for i, node in enumerate(nodes):
        j = up[i]
        if (t := vocabulary.tags.get(node.tag)) is not None:
            x[i, t0 + t] = 1
        for w in node.words:
            if (k := vocabulary.words.get(w)) is not None:
                x[i, v0 + k] = 1
        if j >= 0:  # what stands above: tags and words of all ancestors
            x[i, t0 + nt : t0 + 2 * nt] = np.maximum(x[j, t0 : t0 + nt], x[j, t0 + nt : t0 + 2 * nt])
            x[i, v0 + nv :] = np.maximum(x[j, v0 : v0 + nv], x[j, v0 + nv :])
    return nodes, x


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, by histograms of quantile bins."""

    def __init__(self) -> None:
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.int64)
        mean = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        width = x.shape[1]
        offset = np.arange(width) * (BINS + 1)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, p * (1 - p) * weight
            queue = [(np.arange(len(y)), 0, -1, 0)]
            tree: list[list] = []  # [feature, threshold, left, right] or [-1, value, 0, 0]
            while queue:
                rows, depth, parent, side = queue.pop(0)
                value = -g[rows].sum() / (h[rows].sum() + SHRINK)
                at = len(tree)
                tree.append([-1, float(RATE * value), 0, 0])
                if parent >= 0:
                    tree[parent][2 + side] = at
                if depth == DEPTH or len(rows) < 2 * LEAF_ROWS:
                    score[rows] += RATE * value
                    continue
                flat = (binned[rows] + offset).ravel()
                size = width * (BINS + 1)
                hg, hh, hn = (np.bincount(flat, np.repeat(a, width), size).reshape(width, -1).cumsum(axis=1) for a in (g[rows], h[rows], np.ones(len(rows))))
                tg, th, tn = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = hg**2 / (hh + SHRINK) + (tg - hg) ** 2 / (th - hh + SHRINK) - tg**2 / (th + SHRINK)
                gain[(hn < LEAF_ROWS) | (tn - hn < LEAF_ROWS)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    score[rows] += RATE * value
                    continue
                tree[at][:2] = int(f), float(edges[f][b])
                inside = binned[rows, f] <= b
                queue += [(rows[inside], depth + 1, at, 0), (rows[~inside], depth + 1, at, 1)]
            f, t, left, right = (np.array(c) for c in zip(*tree))
            self.trees.append((f, t.astype(np.float64), left, right))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, left, right in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                nxt = np.where(x[rows, np.maximum(f[at], 0)] <= t[at], left[at], right[at])
                at = np.where(inner, nxt, at)
            out += t[at]
        return out


#: What it costs to decide an element by its parts: whole elements are the rule.
MIXED = 3.0


def decode(nodes: list[Node], odds: np.ndarray) -> tuple[set[int], set[int]]:
    """Places of the elements taken whole, and of those of which only the own text is, by the most likely consistent choice.

    An element's weight is the text it holds itself, and a choice for an element holds for all below it: taking
    earns the log probability of the article for each of them, leaving that of the rest. An element that is decided by its
    parts has its own text taken or left by its own odds.
    """
    place = {id(x): i for i, x in enumerate(nodes)}
    n = len(nodes)
    own = np.array([sum(len(c.text.strip()) for c in x.children if c.tag == "#") for x in nodes], float)
    weight = np.sqrt(own) + 0.5
    odds = np.clip(odds, -8, 8)
    for i, x in enumerate(nodes):  # inside an element that looks like the article, what is in doubt belongs to it
        if x.parent is not None and odds[j := place[id(x.parent)]] > 0:
            odds[i] += INHERIT * min(odds[j], 4.0)
    take, leave = -np.logaddexp(0, -odds) * weight, -np.logaddexp(0, odds) * weight
    all_take, all_leave = take.copy(), leave.copy()
    best, choice = np.zeros(n), np.zeros(n, np.int8)
    below = np.zeros(n)
    for i in range(n - 1, -1, -1):
        apart = (leave[i], take[i] - MIXED) if own[i] else (-MIXED, -np.inf)
        options = (below[i] + apart[0], all_leave[i], all_take[i], below[i] + apart[1])
        choice[i] = int(np.argmax(options)) if below[i] else int(np.argmax((-np.inf, *options[1:3])))
        best[i] = options[choice[i]]
        if nodes[i].parent is not None and (j := place.get(id(nodes[i].parent))) is not None:
            all_take[j] += all_take[i]
            all_leave[j] += all_leave[i]
            below[j] += best[i]
    taken: set[int] = set()
    bare: set[int] = set()
    stack = [0] if n else []
    children: list[list[int]] = [[] for _ in range(n)]
    for i, x in enumerate(nodes):
        if x.parent is not None:
            children[place[id(x.parent)]].append(i)
    while stack:
        i = stack.pop()
        if choice[i] == 2:
            taken.add(i)
        elif choice[i] in (0, 3):
            stack.extend(children[i])
            if choice[i] == 3:
                bare.add(i)
    return taken, bare


def text_of(node: Node, whole: set[int] | None = None, bare: set[int] | None = None) -> list[str]:
    """Blocks of text below a node in page order, white space made single blanks and trimmed, empty ones left out.

    ``whole`` and ``bare`` hold the ids of the nodes taken whole and of those whose own text alone is taken; without
    them everything is taken. What is left out ends a block if it is one.
    """
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                blocks.append(text)
            run.clear()

    stack: list = [(node, False, whole is None)]
    while stack:
        x, closing, inside = stack.pop()
        if closing:
            end()
            continue
        if x.tag == "#":
            if inside or (x.parent is not None and id(x.parent) in bare) or x.text.isspace():
                run.append(x.text)
            continue
        if x.tag == "br":
            run.append(" ")
        elif x.tag not in HIDDEN:
            if x.tag in BLOCK:
                end()
                stack.append((x, True, False))
            stack.extend((c, False, inside or id(x) in whole) for c in reversed(x.children))
    end()
    return blocks


def extract(sources: list[str], model: tuple[Vocabulary, Boosted] | None) -> list[str]:
    """The main texts of pages."""
    out = []
    for a in range(0, len(sources), 64):
        roots = [parse(s) for s in sources[a : a + 64]]
        if model is None:
            out += ["\n".join(text_of(r)) for r in roots]
            continue
        made = [features(r, model[0]) for r in roots]
        odds = model[1].odds(np.concatenate([x for _, x in made]))
        at = 0
        for nodes, _ in made:
            taken, bare = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append("\n".join(text_of(nodes[0], {id(nodes[i]) for i in taken}, {id(nodes[i]) for i in bare})))
    return out


# ---------------------------------------------------------------------------------------------------- training

# Attribute tokens that pages commonly use, for invented layouts.
ARTICLE_WORDS = ("article", "article-body", "post", "post-content", "entry", "entry-content", "content", "main-content", "story", "story-body", "text", "body-text", "page-content")
OTHER_WORDS = {
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "links", "toc"), "header": ("header", "masthead", "banner", "top-bar", "site-header"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom"), "side": ("sidebar", "side", "widget", "related", "popular", "recommended", "tags"),
    "notice": ("cookie", "consent", "notice", "alert", "gdpr", "popup", "newsletter", "subscribe"), "advert": ("ad", "ads", "advert", "sponsored", "promo", "promotion"),
    "comments": ("comments", "comment", "comment-list", "replies", "discussion", "responses"),
}
OTHER_TAGS = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "notice": ("div", "aside", "section"), "advert": ("div", "aside", "ins"), "comments": ("section", "div", "ol")}


def invented(blocks: list[str], rng: random.Random) -> str:
    """A page whose article (marked by ``data-main``) is made of some blocks and whose other parts of others."""
    esc = lambda t: entities.escape(t, quote=False)
    some = lambda k: [rng.choice(blocks)[: rng.randint(10, 160)] for _ in range(k)]

    def part(kind: str) -> str:
        tag, word = rng.choice(OTHER_TAGS[kind]), rng.choice(OTHER_WORDS[kind])
        named = "" if tag in ("nav", "header", "footer", "aside") and rng.random() < 0.6 else f' {rng.choice(("class", "id"))}="{word}"'
        if kind == "menu" or (kind in ("side", "footer", "header") and rng.random() < 0.5):
            items = "".join(f'<li><a href="/{i}">{esc(t.split(" ")[0])}</a></li>' for i, t in enumerate(some(rng.randint(2, 9))))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "comments":
            item = rng.choice(("div", "li", "article"))
            inner = "".join(f'<{item} class="{rng.choice(OTHER_WORDS["comments"][:2])}"><p>{esc(t)}</p></{item}>' for t in [rng.choice(blocks)[:400] for _ in range(rng.randint(1, 6))])
        else:
            wrap = rng.choice(("{}", "<p>{}</p>", "<div>{}</div>", *(("<h1>{}</h1>", "<h2>{}</h2>") if kind in ("header", "side") else ())))
            inner = "".join(wrap.format(esc(t)) for t in some(rng.randint(1, 3)))
        return f"<{tag}{named}>{inner}</{tag}>"

    tag = rng.choice(("article", "article", "main", "div", "div", "section"))
    named = f' class="{rng.choice(ARTICLE_WORDS)}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
    body = []
    short = rng.random() < 0.4  # articles of little text on pages of little else
    chosen = [blocks[(rng.randrange(len(blocks)) + i) % len(blocks)][: rng.randint(120, 900) if short else None] for i in range(rng.randint(1, 3 if short else 12))]
    for t in chosen:
        kind = rng.random()
        body.append(f"<p>{esc(t)}</p>" if kind < 0.75 else f"<h2>{esc(t[:60])}</h2>" if kind < 0.85 else f"<blockquote><p>{esc(t)}</p></blockquote>" if kind < 0.9 else f"<ul><li>{esc(t)}</li><li>{esc(t[:80])}</li></ul>" if kind < 0.95 else f"<p><b>{esc(t)}<br>")
    if rng.random() < 0.2:  # bare text between line breaks
        body = [esc(t) + rng.choice(("<br><br>", "<br>", "<p>", " ")) for t in chosen]
    inside = [part(k) for k in ("advert", "notice", "comments", "side") if rng.random() < 0.15]
    body[rng.randint(0, len(body)) : 0] = inside
    heading = f"<h1>{esc(rng.choice(blocks)[:60])}</h1>" if rng.random() < 0.8 else ""
    main = f'<{tag}{named} data-main="1">{heading}{"".join(body)}</{tag}>'
    share = 0.15 if short else 0.5
    top = [part(k) for k in ("header", "menu", "advert", "notice", "side") if rng.random() < share]
    bottom = [part(k) for k in ("comments", "side", "advert", "footer", "notice") if rng.random() < share]
    rng.shuffle(top)
    whole = "".join([*top, main, *bottom])
    if rng.random() < 0.3:
        whole = f'<div class="{rng.choice(("wrapper", "container", "page", "row"))}">{whole}</div>'
    return f"<html><head><title>{esc(rng.choice(blocks)[:50])}</title></head><body>{whole}" + rng.choice(("</body></html>", ""))


def labelled(source: str) -> tuple[Node, set[int]] | None:
    """A training page's tree and the ids of the nodes of its article, parts of other kinds inside left out."""
    at = re.search(r'<(\w+)([^>]*) data-main="1">', source)
    root = parse(source.replace(' data-main="1"', ' role="zzmain"') if at else source)
    found = [x for x in elements(root) if ("zzmain" in x.words if at else x.tag == "article")]
    if not found:
        return None
    others = {w for words in OTHER_WORDS.values() for word in words for w in WORD.findall(word)}
    inside: set[int] = set()
    stack = [found[0]]
    while stack:
        x = stack.pop()
        if x is not found[0] and (x.tag in ("nav", "aside", "header", "footer", "form", "ins") or x.words & others):
            continue
        inside.add(id(x))
        stack.extend(c for c in x.children if c.tag != "#")
    for x in found:
        x.words = x.words - {"zzmain"}
    return root, inside


def fit(pages: list[tuple[int, str]], layouts: int = 8) -> tuple[Vocabulary, Boosted] | None:
    """Vocabulary and trees from sample pages (id, html)."""
    trained: list[tuple[Node, set[int]]] = []
    for page_id, source in pages:
        blocks = [b for b in text_of(parse(source)) if b]
        if not blocks:
            continue
        rng = random.Random(zlib.crc32(str(page_id).encode()))
        made = [source, *(invented(blocks, rng) for _ in range(layouts))]
        trained += [t for m in made if (t := labelled(m)) is not None]
    if not trained:
        return None
    seen: dict[str, int] = {}
    for root, _ in trained:
        for w in {w for x in elements(root) for w in x.words}:
            seen[w] = seen.get(w, 0) + 1
    vocabulary = Vocabulary(sorted(w for w, n in seen.items() if n >= 3))
    rows, labels = [], []
    for root, inside in trained:
        nodes, x = features(root, vocabulary)
        rows.append(x)
        labels.append(np.array([id(n) in inside for n in nodes], float))
    x, y = np.concatenate(rows), np.concatenate(labels)
    weight = np.where(x[:, 2] > 0, 1.0, 0.7)
    return vocabulary, Boosted().fit(x, y, weight)


def train(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> tuple[Vocabulary, Boosted] | None:
    """Fit on at most ``sample`` pages, the ones with the smallest hash of their id; on the driver."""
    picked = pages.filter(F.col(html_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(html_col) > 0)).select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
    picked = picked.withColumn("k", F.xxhash64("i")).orderBy("k", "i", F.xxhash64("h")).limit(sample)
    return fit([(r["i"], r["h"]) for r in picked.collect()])


_MODELS: dict[int, object] = {}


def main_text(pages: DataFrame, model, html_col: str = "html", keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every page."""
    packed = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def setup():
        key = zlib.crc32(packed.value)
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(packed.value)
        found = _MODELS[key]
        return lambda sources: [pa.array(extract(sources, found), pa.string())]

    return map_texts(pages, keep, html_col, "text string", setup)
