"""Main text of HTML pages: boosted trees over DOM nodes, decoded hierarchically.

A page is parsed into elements; each gets features of itself and its
surroundings: subtree text and link density, attribute tokens, depth, and how it
compares with its siblings.  Trees tell how likely an element is main text.

Decoding chooses a cut through the tree: a subtree is kept whole, dropped whole,
or left to its children, whichever has the greatest likelihood in all, weighted
by text.  A kept element thus never holds a dropped one, nor the reverse.

The trees are fitted on at most ``FIT_PAGES`` pages whose markup says what their
main text is (``article`` or ``main`` elements, ``role=main``); those marks are
hidden from the features, so pages without them are judged alike.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.boosting import Boosted, fit
from strandline.llm.common import tidy

#: Pages that are read for fitting, by a seeded hash of their id.
FIT_PAGES, SEED, TOKEN_BUCKETS = 600, 3, 16
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:\-]*)|[^<]+|<", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea")}
_HEAD = frozenset(("head", "title"))
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_TAGS = ("div", "p", "span", "a", "li", "ul", "table", "td", "section", "nav", "header", "footer", "aside", "form", "b", "pre", "blockquote")
_HEADING = re.compile(r"h[1-6]$")
_MAIN = ("article", "main")
_STOP = re.compile(r"[.!?]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "children", "parts", "main", "chars", "links", "words", "stops", "size")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.main = bool(parent and parent.main)
        self.chars = self.links = self.words = self.stops = 0
        self.size = 1


class _Tags:
    """Ends of a page's tags, each character being read once, save where a quote has no end."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Where the ``>`` of the tag stands whose attributes begin at ``at``; -1 without one."""
        if at > self.last[">"]:
            return -1
        pos = at
        while (pos := _PLAIN.match(self.page, pos).end()) < len(self.page):
            c = self.page[pos]
            if c == ">":
                return pos
            if pos >= self.last[c]:
                break
            pos = self.page.index(c, pos + 1) + 1
        # a quote without an end, or with one that leaves no end to the tag, is none
        return self.page.find(">", at)


def parse(page: str) -> list[Node]:
    """Elements in document order; the first is the root, which stands for the page.

    Unclosed, crossed and unknown tags are accepted: an end tag closes up to its
    element if that is open, and is ignored otherwise.
    """
    root = Node("#root", "", None)
    nodes, top, open_count = [root], root, {}
    at, tags = 0, _Tags(page)
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag, attrs = m[2], ""
        if tag is not None:
            end = tags.end(at)
            if end < 0:
                tag, at = None, m.start() + 1
            else:
                attrs, at = page[at:end], end + 1
        if tag is None:
            text = page[m.start() : at]
            if text[0] != "<" or text == "<":
                if top.tag not in _HEAD and not text.isspace():
                    top.parts.append(text)
            elif text.startswith("<![CDATA["):
                top.parts.append(text[9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if open_count.get(tag):
                while top.tag != tag:
                    open_count[top.tag] -= 1
                    top = top.parent
                open_count[tag] -= 1
                top = top.parent
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        while top.tag in _CLOSES and tag in _CLOSES[top.tag]:
            open_count[top.tag] -= 1
            top = top.parent
        node = Node(tag, attrs, top)
        if tag in _MAIN or (node.attrs and re.search(r"role\s*=\s*[\"']?main", node.attrs, re.I)):
            node.main = True
        top.parts.append(node)
        if tag == "br":
            continue
        top.children.append(node)
        nodes.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            top = node
            open_count[tag] = open_count.get(tag, 0) + 1
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                n = len(part.strip())
                node.chars += n
                node.words += part.count(" ") + 1
                node.stops += len(_STOP.findall(part))
            elif part.tag != "br":
                node.chars += part.chars
                node.words += part.words
                node.stops += part.stops
                node.links += part.links
                node.size += part.size
        if node.tag == "a":
            node.links = node.chars
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), 25 + len(_TAGS) + TOKEN_BUCKETS), np.float32)
    total = max(1, nodes[0].chars)
    number = {id(n): i for i, n in enumerate(nodes)}
    # siblings by tag, counted once for all of them
    tags = {id(n): Counter(c.tag for c in n.children) for n in nodes if n.children}
    for i, n in enumerate(nodes):
        p = n.parent or n
        brothers = p.children or [n]
        own = sum(len(x) for x in n.parts if isinstance(x, str))
        chars = p.chars or 1
        same = tags[id(p)][n.tag] if n.parent else 1
        out[i, :25] = (
            n.depth, np.log1p(n.chars), n.chars / total, n.links / max(1, n.chars), n.size, n.chars / n.size, np.log1p(n.words), n.stops / max(1, n.words), own / max(1, n.chars), len(n.children),
            n.chars / max(1, n.words), len(brothers), n.chars / chars, n.chars * len(brothers) / chars, same, p.links / chars, np.log1p(p.chars), chars / p.size, p.stops / max(1, p.words), i / len(nodes),
            float(bool(_HEADING.match(n.tag))), float(p.tag in ("ul", "ol", "nav")), float(n.tag in _VOID), p.depth, max((c.chars for c in n.children), default=0) / max(1, n.chars),
        )
        tag = "div" if n.tag in _MAIN else n.tag
        if tag in _TAGS:
            out[i, 25 + _TAGS.index(tag)] = 1
        if n.attrs:
            for _, a, b, c in _ATTR.findall(n.attrs):
                for token in re.findall(r"[a-z]+", (a or b or c).lower()):
                    if token not in _MAIN:
                        out[i, 25 + len(_TAGS) + zlib.crc32(token.encode()) % TOKEN_BUCKETS] = 1
        # what a parent is marked with holds for its children as well
        if n.parent is not None:
            out[i, 25:] = np.maximum(out[i, 25:], 0.5 * (out[number[id(p)], 25:] > 0.2))
    return out


def decode(nodes: list[Node], p: np.ndarray) -> list[Node]:
    """Roots of the kept subtrees, in document order."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    keep, drop, best, choice = (np.zeros(len(nodes)) for _ in range(4))
    number = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        own = sum(len(x.strip()) for x in n.parts if isinstance(x, str))
        kids = [number[id(c)] for c in n.children]
        weight = np.log1p(own)
        keep[i] = weight * np.log(p[i]) + sum(keep[k] for k in kids)
        drop[i] = weight * np.log(1 - p[i]) + sum(drop[k] for k in kids)
        # text of its own must go one way; an element with none may leave it to its children
        mixed = sum(best[k] for k in kids) + (weight * max(np.log(p[i]), np.log(1 - p[i])) if own == 0 else -np.inf)
        scores = (drop[i], keep[i], mixed)
        choice[i] = int(np.argmax(scores)) if kids else int(keep[i] > drop[i])
        best[i] = scores[int(choice[i])]
    out, stack = [], [nodes[0]]
    while stack:
        n = stack.pop()
        c = choice[number[id(n)]]
        if c == 1:
            out.append(n)
        elif c == 2:
            stack.extend(reversed(n.children))
    return out


def text_of(nodes: list[Node]) -> str:
    """Text of subtrees: blocks on lines of their own, white space collapsed, entities resolved."""
    out: list[str] = []
    stack: list = [x for n in reversed(nodes) for x in ("\n", n, "\n")]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        edge = "\n" if x.tag in _BLOCK else ""
        stack.append(edge)
        for part in reversed(x.parts):
            stack.append(part if isinstance(part, Node) else entities.unescape(part).replace("\n", " "))
        stack.append(edge)
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def fit_pages(pages: list[str]) -> Boosted | None:
    """Trees from pages whose markup names their main text; None if none does."""
    x, y = [], []
    for page in pages:
        nodes = parse(page or "")
        if any(n.main for n in nodes) and not all(n.main for n in nodes[1:]):
            f = features(nodes)
            some = np.array([n.chars > 0 and n.tag not in ("html", "body", "#root", *_MAIN) for n in nodes])
            x.append(f[some])
            y.append(np.array([float(n.main) for n in nodes])[some])
    return fit(np.concatenate(x), np.concatenate(y), trees=30, depth=4) if x and sum(map(len, x)) else None


def fit_on(pages: DataFrame, most: int = FIT_PAGES, seed: int = SEED, id_col: str = "page_id", html_col: str = "html") -> Boosted | None:
    """Fit on at most ``most`` pages, the first by a seeded hash; of rows that repeat an id, one is read."""
    ids = pages.filter(F.col(html_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__page")).distinct()
    rows = ids.orderBy(F.xxhash64(F.lit(seed), "__page"), "__page").limit(most)
    chosen = pages.join(F.broadcast(rows), F.col(id_col) == F.col("__page")).groupBy("__page").agg(F.min(html_col).alias("html")).toArrow().to_pylist()
    model = fit_pages([r["html"] for r in sorted(chosen, key=lambda r: r["__page"])])
    del chosen
    tidy()
    return model


def extract_pages(pages: list[str | None], model: Boosted | None) -> list[tuple[str | None, int, int]]:
    """(text, elements, kept subtrees) of each page; null for null."""
    parsed = [parse(p) if p is not None else [] for p in pages]
    sizes = [len(n) for n in parsed]
    if model is None or not sum(sizes):
        p = np.ones(sum(sizes))
    else:
        p = model.predict(np.concatenate([features(n) for n in parsed if n]))
    out, at = [], 0
    for nodes in parsed:
        if not nodes:
            out.append((None, 0, 0))
            continue
        kept = decode(nodes, p[at : at + len(nodes)])
        at += len(nodes)
        out.append((text_of(kept), len(nodes) - 1, len(kept)))
    return out


def extract(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_elements, n_kept) for each row of ``pages``.

    Null HTML has null text; empty HTML, or a page without text, has an empty
    one.  Without a model every text is kept.  Pages of any length are read
    whole; repeated rows are treated alike; other columns are ignored; an empty
    table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandline.llm.common import chunks

        for b in batches:
            html = b.column(1).to_pylist()
            for s, e in chunks([len(h or "") for h in html], 2_000_000):
                found = extract_pages(html[s:e], model)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s, e - s), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())],
                    ["page_id", "text", "n_elements", "n_kept"],
                )

    own = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, f"page_id {kind}, text string, n_elements int, n_kept int")
