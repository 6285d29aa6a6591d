"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree. A node's own potential comes from what it is and holds (tag, class
words, links, length); potentials between parent and child from how often each keeps the other's label. One sum-product
pass up and one down give every node's exact marginal of being content; the text of nodes above one half is kept.
Potentials are trained on pages with labels: a few by hand, and a bounded sample of the table's own pages whose semantic
elements (article, main against nav, footer and the like) label them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled_pages import PAGES

#: Bound of the pages that are taken from the table to train on.
FIT_PAGES = 300

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
HIDDEN = frozenset("head script style textarea title noscript template iframe svg math object canvas button select option datalist input label form nav footer aside menu dialog".split())
BLOCK = frozenset("html body head div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend label button select option datalist blockquote pre figure figcaption address details summary dialog menu center hr svg math object canvas".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
CLOSES = {  # an opening tag ends these open elements, up to a limit that holds them
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
# Words of class, id and role that tell what a part of a page is.
BAD_WORDS = "nav menu header footer sidebar side aside ad ads advert advertisement banner cookie consent gdpr promo sponsor sponsored share social comment comments reply respond disqus form login signin signup newsletter subscribe subscription related recommended recommendations breadcrumb breadcrumbs popup modal notice notification alert widget copyright pager pagination tags toolbar search skip masthead contentinfo navigation complementary dialog bottom top feedback discussion rating hidden toc overlay thread".split()
GOOD_WORDS = "article content main post entry story body text page blog news".split()

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_TAGS = sorted(BLOCK)
_FEATURES = {name: i for i, name in enumerate([*(f"t:{t}" for t in _TAGS), *(f"b:{w}" for w in BAD_WORDS), *(f"g:{w}" for w in GOOD_WORDS), "bad", "good", "bad above", "hidden", *(f"l{i}" for i in range(6)), *(f"n{i}" for i in range(10)), *(f"p{i}" for i in range(4)), "stops", "in article", "in main", "bias"])}
_BAD, _GOOD = frozenset(BAD_WORDS), frozenset(GOOD_WORDS)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    words: frozenset[str]
    off: bool
    label: str | None
    chars: int = 0
    linked: int = 0
    stops: int = 0
    paragraphs: int = 0
    features: list[int] = field(default_factory=list)


def parse(html: str, by_hand: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (the first is the page), and the text blocks with their elements.

    The attribute y is read as a label only on hand-labelled pages.
    """
    nodes = [Node("html", -1, frozenset(), False, None)]
    stack, blocks, buffer = [0], [], []
    link, at, n = 0, 0, len(html)

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((stack[-1], text))

    def add(data: str) -> None:
        if "&" in data:
            data = unescape(data)
        buffer.append(data)
        own = nodes[stack[-1]]
        size = len(data.strip())
        own.chars += size
        own.linked += size * (link > 0)
        own.stops += data.count(".") + data.count(",")

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            elif tag in BLOCK:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag), 0)
                if depth:
                    flush()
                    del stack[depth:]
                    link = 0
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            buffer.append(" ")
        elif tag == "hr":
            flush()
        elif tag in RAW:
            end = _END[tag].search(html, at)
            at = end.end() if end else n
        elif tag in BLOCK:
            flush()
            link = 0
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag in ends:
                        del stack[i:]
                        break
                    if nodes[stack[i]].tag in within:
                        break
            elif nodes[stack[-1]].tag == "p":  # a block ends a paragraph
                stack.pop()
            words, off, label = frozenset(), False, None
            if m[3].strip():
                held, seen = [], set()
                for a in _ATTR.finditer(m[3]):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name in seen:  # the first of a name counts
                        continue
                    seen.add(name)
                    if name in ("class", "id", "role"):
                        held += [w.lower() for w in _WORDS.findall(value)]
                    elif name == "y" and by_hand:
                        label = value
                    elif name == "hidden" or name == "style" and _GONE.search(value) or name == "aria-hidden" and value.strip().lower() == "true":
                        off = True
                words = frozenset(held)
            nodes.append(Node(tag, stack[-1], words, off, label))
            if not m[0].endswith("/>"):
                stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks


def featured(nodes: list[Node]) -> None:
    """Fills in what nodes hold below them, and their features."""
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        c, p = nodes[i], nodes[nodes[i].parent]
        c.paragraphs += c.tag == "p"
        if c.tag not in HIDDEN:
            p.chars += c.chars
            p.linked += c.linked
            p.stops += c.stops
            p.paragraphs += c.paragraphs
    f = _FEATURES
    above: list[tuple[bool, bool, bool]] = []
    for node in nodes:
        bad_above, in_article, in_main = above[node.parent] if node.parent >= 0 else (False, False, False)
        bad, good = node.words & _BAD, node.words & _GOOD
        own = [f[f"t:{node.tag}"], f["bias"], f[f"l{min(5, int(5.999 * node.linked / node.chars)) if node.chars else 0}"], f[f"n{min(9, node.chars.bit_length())}"], f[f"p{min(3, node.paragraphs)}"]]
        own += [f[f"b:{w}"] for w in bad] + [f[f"g:{w}"] for w in good]
        own += [f["bad"]] * bool(bad) + [f["good"]] * bool(good) + [f["bad above"]] * bad_above + [f["hidden"]] * node.off
        own += [f["stops"]] * (node.stops * 40 > node.chars > 0) + [f["in article"]] * in_article + [f["in main"]] * in_main
        node.features = own
        above.append((bad_above or bool(bad) and not good, in_article or node.tag == "article", in_main or node.tag == "main"))


def labels(nodes: list[Node]) -> list[int] | None:
    """By hand where y is given, else by semantic elements; None if a page has neither."""
    by_hand = any(x.label is not None for x in nodes)
    if not by_hand and not any(x.tag in ("article", "main") for x in nodes):
        return None
    out: list[int] = []
    for x in nodes:
        up = out[x.parent] if x.parent >= 0 else 0
        if x.tag in HIDDEN:
            out.append(0)
        elif by_hand:
            out.append(up if x.label is None else int(x.label == "1"))
        else:
            out.append(0 if x.words & _BAD or x.off else int(up or x.tag in ("article", "main")))
    return out


@dataclass
class Potentials:
    weights: np.ndarray
    prior: float
    #: [text element or not][parent's label][child's label]
    kept: list

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Exact marginals of content: messages from the leaves to the page, then back."""
        n, w = len(nodes), self.weights
        own = []
        for x in nodes:
            z = 0.0
            for i in x.features:
                z += w[i]
            z = max(-30.0, min(30.0, z - self.prior))
            own.append((0.0, 1.0) if x.tag in HIDDEN or x.off else (2.718281828459045**z, 1.0))
        up1, up0 = [o[0] for o in own], [o[1] for o in own]
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            k = self.kept[nodes[i].tag in TEXT_TAGS]
            a, b = up1[i], up0[i]
            m1, m0 = k[1][1] * a + k[1][0] * b, k[0][1] * a + k[0][0] * b
            scale = m1 + m0
            m1, m0 = m1 / scale, m0 / scale
            sent[i] = (m1, m0)
            p = nodes[i].parent
            up1[p] *= m1 * 2
            up0[p] *= m0 * 2
            scale = up1[p] + up0[p]
            up1[p] /= scale
            up0[p] /= scale
        down = [(0.5, 0.5)] * n
        out = [0.0] * n
        for i, x in enumerate(nodes):
            if i:
                p = x.parent
                k = self.kept[x.tag in TEXT_TAGS]
                # what the parent knows without this child
                r1 = up1[p] * down[p][0] / max(sent[i][0], 1e-300)
                r0 = up0[p] * down[p][1] / max(sent[i][1], 1e-300)
                d1, d0 = k[1][1] * r1 + k[0][1] * r0, k[1][0] * r1 + k[0][0] * r0
                scale = d1 + d0 or 1.0
                down[i] = (d1 / scale, d0 / scale)
            a, b = up1[i] * down[i][0], up0[i] * down[i][1]
            out[i] = a / (a + b) if a + b else 0.0
        return out

    def text(self, html: str) -> str:
        nodes, blocks = parse(html)
        featured(nodes)
        share = self.marginals(nodes)
        inside = [False] * len(nodes)  # within an element that is never content
        for i, x in enumerate(nodes):
            inside[i] = x.tag in HIDDEN or x.off or x.parent >= 0 and inside[x.parent]
        return "\n".join(text for i, text in blocks if share[i] >= 0.5 and not inside[i])


def train(pages: list[str]) -> Potentials:
    """Potentials from the labelled ones of these pages and the hand-labelled ones, which weigh as much together."""
    rows, ys, weights = [], [], []
    counts = [[[1.0, 1.0], [1.0, 1.0]], [[1.0, 1.0], [1.0, 1.0]]]
    own = [(html, 1.0, False) for html in pages]
    for html, weight, by_hand in [*own, *((h, max(1.0, len(own) / len(PAGES)), True) for h in PAGES)]:
        nodes, _ = parse(html, by_hand)
        y = labels(nodes)
        if y is None:
            continue
        featured(nodes)
        for i, x in enumerate(nodes):
            if x.tag in HIDDEN:
                continue
            rows.append(x.features)
            ys.append(y[i])
            weights.append(weight)
            if i:
                counts[x.tag in TEXT_TAGS][y[x.parent]][y[i]] += weight
    x = np.zeros((len(rows), len(_FEATURES)))
    for i, r in enumerate(rows):
        x[i, r] = 1.0
    y, g = np.array(ys, float), np.array(weights)
    g /= g.sum()
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (g * (p - y)) + 3e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    share = float(np.clip((g * y).sum(), 0.05, 0.95))
    kept = [[[c / sum(row) for c in row] for row in table] for table in counts]
    return Potentials(w, log(share / (1 - share)), kept)


def fit(pages: DataFrame, html: str = "html", most: int = FIT_PAGES) -> Potentials:
    """Trained on hand-labelled pages and about `most` of the table's, picked by hash."""
    n = pages.count()
    spot = F.pmod(F.xxhash64(F.lit(23), pages[html]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = pages.where(pages[html].isNotNull() & (spot < most / max(n, 1))).select(pages[html].alias("h")).orderBy(F.xxhash64("h"), "h").limit(2 * most).collect()  # a bounded sample
    return train([r["h"] for r in rows])


def main_text(html: Column, model: Potentials, spark) -> Column:
    """Main text of each whole page; null and empty pages have an empty one."""
    sent = spark.sparkContext.broadcast(model)  # some hundred weights

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([sent.value.text(h) if h else "" for h in series], dtype=object)

    return run(html)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Potentials | None = None) -> DataFrame:
    """(keep, text, n_chars) for every row; fits the model unless one is given.

    Null, empty and tagless pages are handled (text without any element is judged as the page's own); unclosed and stray
    tags end as HTML's rules say for paragraphs, lists and tables. Very long pages are read whole; repeated rows each get
    a row; an empty table gives none; other columns are not read.
    """
    model = model or fit(pages, html)
    rows = pages.select(*[pages[c] for c in keep], main_text(pages[html], model, pages.sparkSession).alias("__t"))
    return rows.select(*keep, F.col("__t").alias("text"), F.char_length("__t").cast("long").alias("n_chars"))
