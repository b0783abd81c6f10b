"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element of a page is a node with features of its subtree (text, links, punctuation, controls), of its
tag and attribute words, of its ancestors, of its depth and of its siblings. The trees give each node log-odds that it belongs to
the article. Decoding then chooses for the whole tree at once: a dropped node drops all below it, a kept one
leaves the choice to each child, and the total of the nodes' log-odds, weighted by their own text, is the greatest.

The pages table has no labels, so the trees learn from pages that this module lays out itself, in many random layouts whose
parts are known; nothing of the corpus enters the model. Training takes about 20 seconds on the driver and gives the same trees each time;
they are kept in the shared folder, under a name made from this module's text, for the next driver.

Output: texts of kept nodes, references decoded, white space within a block made one space, blocks joined by a newline.
``<br>`` is white space. Null or empty html gives an empty text. Repeated pages are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are never text.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas video audio head title button select textarea".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: What a start tag closes if it is open above it, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table html body".split())
#: Most tags: no angle brackets in quoted values, so that a failing match ends at the next bracket.
_TAG_TEXT = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_NAMED = re.compile(r"\b(class|id|role|itemprop|aria-label|style|data-part)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_STOP = re.compile(r"[.!?;:,。！？]")
#: Words in attributes that tell parts of a page, each a feature.
MARKS = (
    "article content post entry body main story text prose page section paragraph blog news "
    "nav menu header head masthead footer foot sidebar side aside rail bar ad ads advert advertisement banner promo sponsor sponsored cookie consent gdpr notice notification alert "
    "popup modal overlay dialog comment comments reply replies respond discussion thread share social follow related recommended recommend more trending popular widget form newsletter "
    "subscribe signup login search breadcrumb breadcrumbs crumb pagination pager tags meta byline legal copyright skip toolbar links list wrap wrapper container inner layout hidden complementary contentinfo navigation"
).split()
_MARK = {m: i for i, m in enumerate(MARKS)}
_TAG = {t: i for i, t in enumerate(sorted(BLOCKS))}
_ABOVE = {t: i for i, t in enumerate("article main nav aside footer header form ul table section figure li".split())}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "marks", "above", "above_marks", "chars", "linked", "stops", "words", "runs", "controls", "links", "kids", "index", "part", "own", "paragraphs", "blocks", "images")

    def __init__(self, tag: str, parent: Node | None, index: int, attrs: str):
        self.tag, self.parent, self.index = tag, parent, index
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.linked = self.stops = self.words = self.controls = self.links = self.own = self.paragraphs = self.blocks = self.images = 0
        self.runs: list[tuple[int, list[str]]] = []
        self.kids: list[Node] = []
        self.part = ""
        marks = 0
        if attrs and "=" in attrs:
            for name, a, b, c in _NAMED.findall(attrs):
                value, name = a or b or c, name.lower()
                if name == "data-part":
                    self.part = value
                elif name == "style":
                    if "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", ""):
                        marks |= 1 << _MARK["hidden"]
                else:
                    for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                        if w in _MARK:
                            marks |= 1 << _MARK[w]
        if " hidden" in attrs and re.search(r"\shidden(?=[\s=/]|$)", attrs):
            marks |= 1 << _MARK["hidden"]
        self.marks = marks
        self.above = parent.above | (1 << _ABOVE[parent.tag] if parent.tag in _ABOVE else 0) if parent else 0
        self.above_marks = parent.above_marks | parent.marks if parent else 0
        if parent:
            parent.kids.append(self)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag, the name empty for comments and declarations.

    Linear in the page: a tag ends at the first > outside of quotes, or at the first one after a quote that is never
    closed. A comment that is never closed takes the rest; a < that begins no tag is text. Send a place to go on from there.
    """
    at, open_ended = 0, set()
    while (start := page.find("<", at)) >= 0:
        end, closing, name, attrs = -1, False, "", ""
        if m := _TAG_TEXT.match(page, start):
            end, closing, name, attrs = m.end(), m[1] == "/", m[2].lower(), m[3]
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start) + 1 or -1
        elif m := _TAG_NAME.match(page, start):
            closing, name, place = m[1] == "/", m[2].lower(), m.end()
            while end < 0:
                stop = _QUOTE_OR_END.search(page, place)
                if stop is None:
                    return  # no > is left
                quote = stop[0]
                if quote == ">":
                    end = stop.end()
                    continue
                shut = -1 if quote in open_ended else page.find(quote, stop.end())
                if shut < 0:
                    open_ended.add(quote)
                    end = page.find(">", stop.end()) + 1
                    if end == 0:
                        return
                else:
                    place = shut + 1
            attrs = page[m.end() : end - 1]
        if end < 0:
            at = start + 1
            continue
        sent = yield start, end, closing, name, attrs
        at = end
        if sent is not None:
            at = sent
            yield start, end, closing, name, attrs  # what send() returns


def parse(page: str) -> list[Node]:
    """Block elements in page order; each holds its own runs of text, numbered in page order."""
    root = Node("html", None, 0, "")
    nodes, open_, run, number = [root], root, [], 0
    at, skip, depth, linked, within = 0, "", 0, False, {}

    opened: Counter = Counter()  # open elements by tag, so that no search goes up for one that isn't there

    def shut_to(node: Node) -> None:
        nonlocal open_
        while open_ is not node:
            opened[open_.tag] -= 1
            open_ = open_.parent

    def close_run() -> None:
        nonlocal run, number
        if run:
            open_.runs.append((number, run))
            number += 1
            run = []

    def text(raw: str) -> None:
        if not raw.strip() and not run:
            return
        t = html_lib.unescape(raw) if "&" in raw else raw
        run.append(t)
        n = len(t)
        open_.own += n
        open_.chars += n
        open_.words += t.count(" ") + 1
        open_.stops += len(_STOP.findall(t))
        if linked:
            open_.linked += n

    end = len(page)
    found = tags(page)
    for start, stop, closing, tag, attrs in found:
        if not skip and start > at:
            text(page[at:start])
        at = stop
        if not tag:
            continue
        if skip:
            if tag == skip:
                depth += -1 if closing else 0 if attrs.endswith("/") else 1
                if depth == 0:
                    skip = ""
                continue
            if tag not in BLOCKS or tag in VOID:
                continue
            if not closing and not (skip == "head" and tag != "html"):
                within[tag] = within.get(tag, 0) + 1
                continue
            if closing and within.get(tag, 0):
                within[tag] -= 1
                continue
            skip = ""  # its end tag is missing: the body or the end of a block around it ends it
        if tag in SKIPPED:
            if not closing and not attrs.endswith("/"):
                if tag in ("button", "select", "textarea"):
                    open_.controls += 1
                if tag in RAW:
                    last = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = last.end() if last else end
                    found.send(at)
                else:
                    skip, depth, within = tag, 1, {}
            continue
        if tag == "br":
            if run:
                run.append(" ")
        elif tag == "a":
            linked = not closing
            if not closing:
                open_.links += 1
        elif tag == "input":
            open_.controls += 1
        elif tag == "img":
            open_.images += 1
        elif tag in BLOCKS:
            close_run()
            if closing:
                if opened[tag]:
                    x = open_
                    while x.tag != tag:
                        x = x.parent
                    shut_to(x.parent)
                linked = linked and tag in _HEADINGS
                continue
            if tag in ("html", "body"):
                if tag == "body":
                    nodes.append(Node(tag, open_, len(nodes), attrs)) if open_.tag == "html" else None
                    if nodes[-1].tag == "body" and open_ is not nodes[-1]:
                        open_ = nodes[-1]
                        opened["body"] += 1
                continue
            if open_.tag == "p" or (open_.tag in _HEADINGS and tag in _HEADINGS):  # neither holds blocks
                shut_to(open_.parent)
            shut = CLOSES.get(tag)
            left = sum(opened[t] for t in shut) if shut else 0
            if left:
                x, last = open_, None
                while left and x is not None and x.tag not in SCOPE:
                    if x.tag in shut:
                        last, left = x, left - 1
                    x = x.parent
                if last is not None:
                    shut_to(last.parent)
            node = Node(tag, open_, len(nodes), attrs)
            nodes.append(node)
            if tag not in VOID:
                open_ = node
                opened[tag] += 1
    if not skip and at < end:
        text(page[at:])
    close_run()
    for x in reversed(nodes):  # children come after their parents
        p = x.parent
        if p is not None:
            p.chars += x.chars
            p.linked += x.linked
            p.words += x.words
            p.stops += x.stops
            p.controls += x.controls
            p.links += x.links
            p.images += x.images
            p.paragraphs += x.paragraphs + (x.tag == "p")
            p.blocks += x.blocks + 1
    return nodes


N_NUMBERS = 24
N_FEATURES = N_NUMBERS + 2 * len(MARKS) + len(_TAG) + len(_ABOVE)


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), N_FEATURES), dtype=np.float32)
    total = max(1, nodes[0].chars)
    m, t, a = N_NUMBERS, N_NUMBERS + 2 * len(MARKS), N_NUMBERS + 2 * len(MARKS) + len(_TAG)
    for i, x in enumerate(nodes):
        p = x.parent
        peers = p.kids if p else [x]
        size = max(1, x.chars)
        place = x.index - p.index if p else 0
        p_size = max(1, p.chars) if p else size
        pp_link = p.linked / p_size if p else 0.0
        out[i, :N_NUMBERS] = (
            math.log1p(x.chars), x.chars / total, x.linked / size, x.stops / max(1, x.words), x.words / (x.blocks + 1), x.links / (1 + x.words), x.controls, x.paragraphs, x.blocks, x.depth, place, len(peers),
            x.chars / p_size, pp_link, math.log1p(p_size), math.log1p(x.own), x.own / size, p.stops / max(1, p.words) if p else 0.0, p.paragraphs if p else 0, x.index / len(nodes), x.images, x.words, p_size / total, p.controls if p else 0,
        )
        marks, above = x.marks, x.above_marks
        while marks:
            low = marks & -marks
            out[i, m + low.bit_length() - 1] = 1
            marks ^= low
        while above:
            low = above & -above
            out[i, m + len(MARKS) + low.bit_length() - 1] = 1
            above ^= low
        out[i, t + _TAG[x.tag]] = 1
        for k in range(len(_ABOVE)):
            if x.above >> k & 1:
                out[i, a + k] = 1
    return out


class Trees:
    """Gradient-boosted regression trees for the log-odds of a yes: histograms of quantile bins, leaves by Newton steps."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, j], grid)) if len(np.unique(x[:200, j])) > 2 else np.array([0.5], dtype=np.float32) for j in range(x.shape[1])]
        edges = [e if len(e) else np.array([0.5]) for e in edges]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        live = [j for j in range(x.shape[1]) if binned[:, j].min() != binned[:, j].max()]
        share = float((y * weight).sum() / weight.sum())
        self.base = math.log(share / (1 - share))
        f = np.full(len(y), self.base)
        nodes = 2**self.depth - 1
        self.feature, self.cut, self.leaf = np.zeros((self.rounds, nodes), dtype=np.int64), np.full((self.rounds, nodes), np.inf, dtype=np.float32), np.zeros((self.rounds, nodes + 1), dtype=np.float64)
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                cut_bin = np.zeros(count, dtype=np.int64)
                for j in live:
                    key = (at - first) * self.bins + binned[:, j]
                    sg = np.bincount(key, weights=g, minlength=count * self.bins).reshape(count, self.bins).cumsum(axis=1)
                    sh = np.bincount(key, weights=h, minlength=count * self.bins).reshape(count, self.bins).cumsum(axis=1)
                    all_g, all_h = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (all_g - sg) ** 2 / (all_h - sh + 1) - all_g**2 / (all_h + 1)
                    gain[:, len(edges[j]) :] = 0
                    at_bin = gain.argmax(axis=1)
                    better = gain[np.arange(count), at_bin] > best
                    best[better] = gain[np.arange(count), at_bin][better]
                    self.feature[r, first : first + count][better] = j
                    self.cut[r, first : first + count][better] = [edges[j][min(b, len(edges[j]) - 1)] for b in at_bin[better]]
                    cut_bin[better] = at_bin[better]
                feature, cut = self.feature[r, at], self.cut[r, at]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature] > cut)
            leaf = at - nodes
            sg, sh = np.bincount(leaf, weights=g, minlength=nodes + 1), np.bincount(leaf, weights=h, minlength=nodes + 1)
            self.leaf[r] = -self.rate * sg / (sh + 1)
            f += self.leaf[r][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for r in range(self.rounds):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[r, at]] > self.cut[r, at])
            f += self.leaf[r][at - (2**self.depth - 1)]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the best labelling in which nothing is kept below a dropped node."""
    keep, drop = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        gain = float(odds[i]) * math.sqrt(10 + x.own) * (1.0 if x.own else 0.25)
        keep[i] += gain
        drop[i] -= gain
        if i:
            p = x.parent.index
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
    out = np.zeros(len(nodes), dtype=bool)
    out[0] = True
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent.index] and keep[i] > drop[i]
    return out


def joined(nodes: list[Node], kept: np.ndarray) -> str:
    runs = sorted((r for x, k in zip(nodes, kept) if k for r in x.runs), key=lambda r: r[0])
    blocks = (" ".join("".join(parts).split()) for _, parts in runs)
    return "\n".join(b for b in blocks if b)


# Pages whose parts are known


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice("aeiou" if i % 2 else "bcdfglmnprst") for i in range(r.randrange(2, 9))) for _ in range(r.randrange(low, high))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def _text(r: random.Random) -> str:
    parts = []
    for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
        s = _sentence(r, 1, 22)
        k = r.random()
        parts.append(f'<a href="/{r.randrange(99)}">{s[:9]}</a> {s[9:]}' if k < 0.1 else f"<b>{s}</b>" if k < 0.15 else f"<b>{s}<br>" if k < 0.18 else s)
    return " ".join(parts)


def _attrs(r: random.Random, words: str) -> str:
    k = r.random()
    if k < 0.2:
        return ""
    w = r.choice(words.split())
    other = r.choice(["", "", f" c{r.randrange(999)}", "-inner", "-box", f"-{r.randrange(9)}", " wrap", " row"])
    return f' {"class" if k < 0.8 else "id"}="{r.choice(["", "", "", "site-", "js-", "page-"])}{w}{other}"'


def _part(tag: str, attrs: str, inner: str, part: int) -> str:
    return f'<{tag}{attrs} data-part="{part}">{inner}</{tag}>'


def _links(r: random.Random, n: int) -> str:
    form = r.random()
    items = [f'<a href="/{r.randrange(999)}">{_sentence(r, 1, 5)}</a>' for _ in range(n)]
    if form < 0.7:
        return _part("ul", _attrs(r, "menu links list nav items"), "".join(_part("li", "", i, 0) for i in items), 0)
    return " | ".join(items) if form < 0.85 else "".join(_part("div", _attrs(r, "item link menu"), i, 0) for i in items)


def _article(r: random.Random, semantic: bool) -> str:
    parts = [_part(r.choice(["h1", "h1", "h2"]), _attrs(r, "title headline entry-title") if r.random() < 0.4 else "", _sentence(r, 2, 12), 1)] if r.random() < 0.9 else []
    if parts and r.random() < 0.15:
        parts = [_part("header", _attrs(r, "entry-header article-header") if r.random() < 0.5 else "", parts[0], 1)]
    for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
        k = r.random()
        if k < 0.72:
            parts.append(_part("p", _attrs(r, "paragraph text") if r.random() < 0.1 else "", _text(r), 1) if r.random() < 0.9 else f'<p data-part="1">{_text(r)}')
        elif k < 0.8:
            parts.append(_part(r.choice(["h2", "h3", "h4"]), "", _sentence(r, 1, 9), 1))
        elif k < 0.86:
            parts.append(_part(r.choice(["ul", "ol"]), "", "".join(_part("li", "", _text(r), 1) for _ in range(r.randrange(2, 7))), 1))
        elif k < 0.9:
            parts.append(_part("blockquote", "", _part("p", "", _text(r), 1) if r.random() < 0.6 else _text(r), 1))
        elif k < 0.92:
            parts.append(_part("pre", "", _text(r), 1))
        elif k < 0.95:
            parts.append(_part("figure", "", '<img src="x">' + _part("figcaption", "", _sentence(r, 3, 12), 1), 1))
        elif k < 0.97:
            cells = "".join(_part("tr", "", "".join(_part("td", "", _sentence(r, 1, 4), 1) for _ in range(3)), 1) for _ in range(r.randrange(2, 6)))
            parts.append(_part("table", "", cells, 1))
        else:
            parts.append(_part("div", _attrs(r, "text section content"), _text(r), 1))
        if r.random() < 0.06:
            parts.append(_clutter(r, inside=True))
    if r.random() < 0.3:
        parts.append(_clutter(r, inside=True))
    body = "".join(parts)
    if r.random() < 0.3:
        body = _part("div", _attrs(r, "entry-content article-body post-body text prose"), body, 1)
    if semantic:
        return _part("article", _attrs(r, "post article entry story") if r.random() < 0.4 else "", body, 1)
    return _part(r.choice(["div", "div", "section", "td" if r.random() < 0.1 else "div"]), _attrs(r, "content post article entry main story article-body text") or ' class="content"', body, 1)


def _clutter(r: random.Random, inside: bool = False) -> str:
    k = r.randrange(12)
    short, text = _sentence(r, 2, 14), _text(r)
    p = lambda t: _part("p", "", t, 0) if r.random() < 0.6 else t
    if k < 3:
        return _part(r.choice(["div", "div", "aside", "section"]), _attrs(r, "ad ads advert advertisement banner promo sponsor sponsored ad-slot") or ' class="ad"', p(short if r.random() < 0.7 else text), 0)
    if k == 3:
        return _part("div", _attrs(r, "share social share-bar follow") or ' class="share"', _links(r, 4), 0)
    if k == 4:
        return _part(r.choice(["div", "section", "aside"]), _attrs(r, "related recommended more-links trending popular") or ' class="related"', _part(r.choice(["h2", "h3", "h4"]), "", _sentence(r, 1, 4), 0) + _links(r, r.randrange(3, 9)), 0)
    if k == 5:
        return _part("form", _attrs(r, "newsletter subscribe search signup login"), p(short) + '<input name="q"><button>Go</button>' + f"<label>{_sentence(r, 1, 3)}</label>", 0)
    if k == 6:
        return _part("div", _attrs(r, "cookie cookie-notice consent gdpr notice alert notification popup modal overlay") or ' class="notice"', p(text if r.random() < 0.5 else short) + (f"<button>{_sentence(r, 1, 3)}</button>" if r.random() < 0.6 else ""), 0)
    if k in (7, 8):
        items = "".join(_part(r.choice(["li", "div", "article"]) if r.random() < 0.9 else "p", _attrs(r, "comment reply comment-body") or ' class="comment"', (_part("p", "", _text(r), 0) if r.random() < 0.6 else _text(r)), 0) for _ in range(r.randrange(1, 7)))
        head = _part("h3", "", _sentence(r, 1, 4), 0) if r.random() < 0.6 else ""
        return _part(r.choice(["section", "div", "ul" if not head else "div"]), r.choice([' id="comments"', ' class="comments"', ' class="comment-list"', ' class="discussion"', ' id="respond"', ' class="thread replies"']), head + items, 0)
    if k == 9:
        return _part(r.choice(["nav", "div", "ol"]), r.choice([' class="breadcrumb"', ' class="breadcrumbs"', ' class="pagination"', ' class="pager"']), _links(r, r.randrange(2, 6)), 0)
    if k == 10:
        return _part(r.choice(["aside", "aside", "div"]), _attrs(r, "sidebar widget rail side") or ' class="sidebar"', (_part("h3", "", _sentence(r, 1, 3), 0) if r.random() < 0.5 else "") + (p(text) if r.random() < 0.5 else _links(r, r.randrange(2, 8))), 0)
    return _part("div", _attrs(r, "byline meta tags toolbar skip legal widget"), p(short), 0)


def made_page(r: random.Random) -> str:
    """A page in a random layout; data-part tells for each block whether it belongs to the article."""
    semantic = r.random() < 0.6
    top, bottom = [], []
    if r.random() < 0.75:
        name = _part(r.choice(["div", "h1", "h2", "h3", "p"]), _attrs(r, "logo brand title site-title") if r.random() < 0.5 else "", _sentence(r, 1, 4), 0)
        inner = name if r.random() < 0.7 else f'<a href="/">{_sentence(r, 1, 4)}</a>'
        if r.random() < 0.4:
            inner += _part("p", "", _sentence(r, 2, 9), 0)
        if r.random() < 0.3:
            inner += _part(r.choice(["nav", "div"]), _attrs(r, "menu nav"), _links(r, r.randrange(2, 7)), 0)
        top.append(_part("header", _attrs(r, "header masthead head") if r.random() < 0.6 else "", inner, 0) if r.random() < 0.65 else _part("div", r.choice([' class="header"', ' id="header"', ' class="masthead"', ' class="site-header top"']), inner, 0))
    if r.random() < 0.85:
        top.append(_part(r.choice(["nav", "nav", "div"]), _attrs(r, "nav menu navbar navigation main-menu") or ' class="menu"', _links(r, r.randrange(3, 12)), 0))
    for _ in range(r.choice([0, 1, 1, 2, 3])):
        (top if r.random() < 0.4 else bottom).append(_clutter(r))
    if r.random() < 0.85:
        foot = _sentence(r, 2, 12) if r.random() < 0.5 else _links(r, r.randrange(2, 7)) + _part("p", "", "&copy; " + _sentence(r, 2, 9), 0)
        if r.random() < 0.3:
            foot = _part(r.choice(["h2", "h3", "h4"]), "", _sentence(r, 1, 4), 0) + _part("p", "", _text(r), 0) + foot
        bottom.append(_part("footer", _attrs(r, "footer foot site-footer"), foot, 0) if r.random() < 0.7 else _part("div", ' class="footer"', foot, 0))
    middle = _article(r, semantic)
    if r.random() < 0.4:
        side = "".join(_clutter(r) for _ in range(r.randrange(1, 3)))
        side = _part(r.choice(["div", "aside"]), _attrs(r, "sidebar side rail aside right") or ' class="sidebar"', side, 0)
        middle = side + middle if r.random() < 0.4 else middle + side
    if r.random() < 0.5:
        middle = _part("main" if semantic and r.random() < 0.6 else "div", _attrs(r, "main container wrapper layout page content wrap"), middle, 1)
    inner = "".join(top) + middle + "".join(bottom)
    if r.random() < 0.3:
        inner = _part("div", _attrs(r, "page wrapper container layout"), inner, 1)
    return f'<!DOCTYPE html><html data-part="1"><head><title>{_sentence(r, 2, 9)}</title><style>p{{}}</style></head><body data-part="1">{inner}</body></html>'


@functools.lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 8) -> Trees:
    r = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        nodes = parse(made_page(r))
        labelled = [i for i, n in enumerate(nodes) if n.part]
        xs.append(features(nodes)[labelled])
        ys += [float(nodes[i].part) for i in labelled]
        ws += [1 / math.sqrt(len(nodes))] * len(labelled)
    return Trees().fit(np.concatenate(xs), np.array(ys), np.array(ws))


def kept_trees(spark: SparkSession) -> Trees:
    """The trained trees, from the shared folder if an earlier driver left them there."""
    name = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:20]
    path = f"{common.shared_dir(spark)}/skein-trees-{name}"
    if common.exists(spark, f"{path}/_SUCCESS"):
        return pickle.loads(spark.read.parquet(path).first()["trees"])
    trees = trained()
    spark.createDataFrame([(bytearray(pickle.dumps(trees)),)], "trees binary").coalesce(1).write.mode("overwrite").parquet(path)
    return trees


def extract_many(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.concatenate([features(n) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append(joined(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    common.small_batches(pages.sparkSession, 500)
    trees = kept_trees(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract_many(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(common.tidy(run), "page_id long, url string, text string, n_chars long")
