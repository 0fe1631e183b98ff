"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

A page's block elements are its nodes. Each gets features of its tag, attribute
tokens, depth, subtree density (text, links, tags), siblings and surroundings, and
gradient-boosted trees give the log odds that it holds main text. Decoding picks the
labelling of largest sum of log odds in which no node under a boilerplate node is
content, so ancestors and descendants cannot contradict each other.

The trees are fitted on generated pages of many layouts (``training_pages``) and on
at most ``sample`` pages of the input, those of smallest hash of page_id, labelled by
their semantic elements; the bound is a parameter. The model is a few KB. Pages are
read once and never shuffled.

Defined cases: null html is empty; pages without main text give an empty text; tags
that are not closed, or closed twice, follow the usual repair rules (a block closes an
open paragraph, an item the last item; of an unclosed button, svg or the like only the
start tag is left out, an unclosed script reaches the end of the page); a cut-off tag at the end is markup; repeated
page_ids are rows of their own.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bound_batches, trimmed

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button", "object", "head"}
TEXT = {"script", "style", "textarea", "title"}  # no tags inside; without an end tag they reach the page's end
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WALL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
GROUPS = [
    "content article post entry story text body main prose copy".split(),
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner".split(),
    "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager skip".split(),
    "footer copyright colophon foot legal".split(),
    "sidebar aside related widget rail recommended trending tags more".split(),
    "comment comments disqus reply replies respond discussion thread".split(),
    "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup toast".split(),
    "share social sharing follow byline meta login search form".split(),
    "header masthead topbar top hero logo brand".split(),
]
TOKEN = {t: 1 << i for i, g in enumerate(GROUPS) for t in g}
TAGS = ["p", "h1", "h2", "h3", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body"]
PLACE = {t: i for i, t in enumerate(TAGS)}
AROUND = ["article", "main", "nav", "header", "footer", "aside", "form", "li"]


class Node:
    __slots__ = ("attrs", "bits", "kids", "letters", "link", "marked", "parent", "parts", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list[Node] = []
        self.parts: list = []  # text pieces, and child nodes in their place
        self.bits, self.marked, self.tags, self.link, self.letters = 0, None, 0, 0, 0
        for m in _ATTR.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "data-y":
                self.marked = value == "1"
            else:
                for w in _NAME.findall(value):
                    self.bits |= TOKEN.get(w, 0)


def pairs(page: str) -> dict[int, int]:
    """Where elements that are left out end, by where their start tags end; those without an end tag are not in it."""
    at, ends, started = 0, {}, {}
    while m := _TOKEN.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag not in RAW:
            continue
        if m[1]:
            if started.get(tag):
                ends[started[tag].pop()] = at
        elif not m[3].endswith("/"):
            if tag in TEXT:
                close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            else:
                started.setdefault(tag, []).append(at)
    return ends


def parse(page: str) -> Node:
    """The tree of block elements; inline markup is dissolved."""
    root = node = Node("html", None)
    stack: list[tuple[str, Node]] = []  # open elements with the node they belong to
    at, links, end = 0, 0, len(page)
    ends = None  # pairs(page), once it is needed

    def say(text: str) -> None:
        if text:
            node.parts.append(text)
            n = len(text) - text.count(" ")
            node.letters += n
            if links:
                node.link += n

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    node = stack[-1][1] if stack else root
                    break
                if stack[i][0] in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        node.tags += 1
        if tag in RAW:
            if not m[3].endswith("/"):
                if ends is not None and tag not in TEXT:
                    at = ends.get(at, at)
                    continue
                close = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                if tag in TEXT or (close and not re.compile(rf"<{tag}[\s/>]", re.I).search(page, at, close.start())):
                    at = close.end() if close else end
                else:
                    ends = pairs(page)
                    at = ends.get(at, at)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                node.parts.append(" ")
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" or t in CLOSES.get(tag, ()) or (t in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    node = stack[-1][1] if stack else root
                    if t not in CLOSES.get(tag, ()) or tag in ("li", "dt", "dd"):
                        break
                elif t in WALL.get(tag, ()) or (t in BLOCK and tag not in CLOSES):
                    break
            if tag in ("html", "body"):
                if tag == "body":
                    root.bits, root.attrs = root.bits | Node("body", None, m[3]).bits, m[3]
                continue
            new = Node(tag, node, m[3])
            node.kids.append(new)
            node.parts.append(new)
            node = new
        elif tag == "a":
            links += 1
        stack.append((tag, node))
    return root


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(node, text) of all blocks under node, in page order."""
    out, run = [], []

    def flush(own: Node) -> None:
        if run:
            if text := " ".join(entities.unescape("".join(run)).split()):
                out.append((own, text))
            run.clear()

    def walk(own: Node) -> None:
        for p in own.parts:
            if isinstance(p, str):
                run.append(p)
            else:
                flush(own)
                walk(p)
        flush(own)

    deep(walk, node)
    return out


def deep(walk, node: Node) -> None:
    """Runs a recursive walk; very deep pages get the room they need."""
    import sys

    was = sys.getrecursionlimit()
    depth, level = 0, [node]
    while level:
        depth += 1
        level = [k for x in level for k in x.kids]
    sys.setrecursionlimit(max(was, 3 * depth + 500))
    try:
        walk(node)
    finally:
        sys.setrecursionlimit(was)


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """All nodes in page order and their features."""
    order: list[tuple[Node, int, int, int]] = []
    todo = [(root, 0, 0, 0)]
    while todo:
        node, depth, around, bits = todo.pop()
        order.append((node, depth, around, bits))
        inside = around | (1 << AROUND.index(node.tag) if node.tag in AROUND else 0)
        for k in reversed(node.kids):
            todo.append((k, depth + 1, inside, bits | node.bits))
    sub: dict[int, list[int]] = {}
    for node, *_ in reversed(order):
        s = [node.letters, node.link, node.tags + 1, sum(p.count(",") + p.count(".") for p in node.parts if isinstance(p, str)), 1]
        for k in node.kids:
            for i, v in enumerate(sub[id(k)]):
                s[i] += v
        sub[id(node)] = s
    whole, before = max(1, sub[id(root)][0]), 0
    near: dict[int, tuple[float, dict[str, int]]] = {}  # by parent: mean letters of its children, and how many there are of each tag
    for node, *_ in order:
        if node.kids:
            kinds: dict[str, int] = {}
            for k in node.kids:
                kinds[k.tag] = kinds.get(k.tag, 0) + 1
            near[id(node)] = sum(sub[id(k)][0] for k in node.kids) / len(node.kids), kinds
    x = np.zeros((len(order), len(TAGS) + 2 * len(GROUPS) + len(AROUND) + 14))
    for i, (node, depth, around, bits) in enumerate(order):
        letters, link, tags, stops, nodes = sub[id(node)]
        row, at = x[i], len(TAGS)
        if node.tag in PLACE:
            row[PLACE[node.tag]] = 1
        for j in range(len(GROUPS)):
            row[at + j], row[at + len(GROUPS) + j] = node.bits >> j & 1, bits >> j & 1
        at += 2 * len(GROUPS)
        for j in range(len(AROUND)):
            row[at + j] = around >> j & 1
        at += len(AROUND)
        long, kinds = near[id(node.parent)] if node.parent else (letters, {node.tag: 1})
        same = kinds[node.tag]
        first = next((p.strip() for p in node.parts if isinstance(p, str) and p.strip()), "")
        row[at:] = [
            depth, np.log1p(letters), link / max(1, letters), tags / max(1, letters) * 10, stops / max(1, letters) * 10, len(node.kids), same, np.log1p(long),
            before / whole, letters / whole, np.log1p(node.letters), first[:1] in "©" and first != "" or first[:6] == "&copy;", nodes, np.log1p(letters / nodes),
        ]
        before += node.letters
    return [o[0] for o in order], x


class Boosted:
    """Gradient-boosted regression trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, least: int = 8):
        self.bias, self.rate, self.trees, self.least = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), rate, [], least
        cuts = [np.unique((u := np.unique(np.quantile(c, np.linspace(0, 1, 33))))[:-1] + np.diff(u) / 2) for c in x.T]
        bins = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        f = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, cuts, y - p, p * (1 - p), np.arange(len(y)), depth)
            self.trees.append(tree)
            f += rate * self._apply(tree, x)

    def _grow(self, bins, cuts, g, h, rows, depth):
        leaf = float(g[rows].sum() / (h[rows].sum() + 1))
        if not depth or len(rows) < 2 * self.least:
            return leaf
        best, where = 1e-3, None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = bins[rows, j]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, where = gain[i], (j, i)
        if not where:
            return leaf
        j, i = where
        low = bins[rows, j] <= i
        return j, float(cuts[j][i]), self._grow(bins, cuts, g, h, rows[low], depth - 1), self._grow(bins, cuts, g, h, rows[~low], depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(tree, np.arange(len(x)))]
        while todo:
            t, rows = todo.pop()
            if isinstance(t, float):
                out[rows] = t
            elif len(rows):
                low = x[rows, t[0]] <= t[1]
                todo += [(t[2], rows[low]), (t[3], rows[~low])]
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum(self._apply(t, x) for t in self.trees)


#: Elements that never hold main text.
NEVER = {"nav", "form", "aside", "footer", "menu", "dialog", "search"}


def decode(nodes: list[Node], odds: np.ndarray) -> set[int]:
    """ids of content nodes: the best labelling in which content has only content above it."""
    gain: dict[int, float] = {}
    for node, s in zip(reversed(nodes), reversed(odds.tolist()), strict=True):
        own = -1e9 if node.tag in NEVER else s
        gain[id(node)] = own + sum(max(0.0, gain[id(k)]) for k in node.kids)
    out, todo = set(), [nodes[0]]
    gain[id(nodes[0])] = max(gain[id(nodes[0])], 1e-9)  # the page as a whole is not boilerplate
    while todo:
        node = todo.pop()
        if gain[id(node)] > 0:
            out.add(id(node))
            todo += node.kids
    return out


def training_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Pages of varied layouts whose main blocks carry data-y="1"."""
    r = random.Random(seed)
    syll = ["ta", "lor", "en", "shi", "mu", "re", "ka", "vo", "ni", "del", "or", "ish", "pa", "zu"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 4)))
    sent = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["", ".", ".", "."])
    text = lambda a, b: " ".join(sent(4, 16) for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(a, b)))

    def pick(*names):
        return r.choice(names)

    def extra():
        return pick(
            lambda: f'<div class="{pick("ad", "ads", "advert", "banner sponsored", "promo")}">{pick(sent(2, 14), text(1, 2))}</div>',
            lambda: f'<div class="{pick("cookie-notice", "consent", "newsletter", "notice", "alert popup")}">{pick("", "<p>")}{text(1, 2)}</div>',
            lambda: f'<aside class="{pick("sidebar", "related", "")}"><h3>{sent(1, 4)}</h3><ul>{links(2, 8)}</ul><p>{text(1, 2)}</p></aside>',
            lambda: f'<div class="{pick("sidebar", "widget related", "rail")}"><h3>{sent(1, 4)}</h3><p>{text(1, 3)}</p><ul>{links(1, 5)}</ul></div>',
            lambda: f'<form class="{pick("search", "signup", "")}"><label>{sent(1, 4)}</label><input name="q"><p>{sent(2, 9)}</p></form>',
            lambda: f'<section id="{pick("comments", "discussion", "respond")}"><h2>{sent(1, 3)}</h2>' + "".join(f'<div class="comment"><p>{text(1, 3)}</p></div>' for _ in range(r.randint(1, 5))) + "</section>",
            lambda: f'<ul class="comments">' + "".join(f'<li class="{pick("comment", "")}"><p>{text(1, 3)}</p></li>' for _ in range(r.randint(1, 5))) + "</ul>",
            lambda: f'<div class="{pick("share", "social", "byline meta")}">{sent(1, 5)}</div>',
            lambda: f'<nav class="breadcrumb"><ul>{links(2, 4)}</ul></nav>',
        )()

    def main_block():
        k = r.random()
        y = ' data-y="1"'
        if k < 0.7:
            return f"<p{y}>{text(1, 6)}</p>"
        if k < 0.78:
            return f"<p{y}>{sent(1, 4)}</p>"
        if k < 0.86:
            h = pick(2, 3)
            return f"<h{h}{y}>{sent(1, 6)}</h{h}>"
        if k < 0.92:
            return "<ul>" + "".join(f"<li{y}>{sent(3, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.96:
            return f"<blockquote><p{y}>{text(1, 3)}</p></blockquote>"
        return f"<p{y}>{text(1, 2)} <a href='#'>{sent(2, 6)}</a> {text(1, 3)}</p>"

    out = []
    for _ in range(n):
        body = [f'<h1 data-y="1">{sent(2, 9)}</h1>'] * (r.random() < 0.8) + [main_block() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            body.insert(r.randint(1, len(body)), extra())
        open_, close = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><div class="entry">', "</div></div>"), ("<main><article class='story'>", "</article></main>"), ("<section class='article-body'>", "</section>"), ("<div>", "</div>"))
        head = pick("", f"<header class='masthead'><div class='logo'>{sent(1, 3)}</div><p>{sent(2, 8)}</p></header>", f"<div id='top' class='header'>{sent(1, 6)}</div>")
        nav = pick(f"<nav><ul>{links(3, 9)}</ul></nav>", f"<div class='menu'><ul>{links(3, 9)}</ul></div>", f"<ul>{links(4, 9)}</ul>")
        foot = pick(f"<footer>&copy; {word()}.example &middot; {sent(3, 12)}</footer>", f"<div class='footer'><p>&copy; {sent(3, 10)}</p></div>", f"<footer><p>{text(1, 2)}</p><ul>{links(1, 5)}</ul></footer>")
        parts = [head, nav, *(extra() for _ in range(r.randint(0, 2))), open_, *body, close, *(extra() for _ in range(r.randint(0, 3))), foot]
        out.append(f"<html><head><title>{sent(2, 5)}</title></head><body>{''.join(parts)}</body></html>")
    return out


def _labels(nodes: list[Node], good) -> np.ndarray:
    """1 where a node or one under it is good."""
    y = {id(n): bool(good(n)) for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None and y[id(n)]:
            y[id(n.parent)] = True
    return np.array([y[id(n)] for n in nodes], float)


def _semantic(node: Node) -> bool:
    """A leaf in an article or main element, with nothing of boilerplate's tokens or elements around it."""
    if not node.letters:
        return False
    inside = False
    while node is not None:
        if node.bits & ~1 or node.tag in NEVER or node.tag == "header":
            return False
        inside |= node.tag in ("article", "main")
        node = node.parent
    return inside


def fit(pages: list[str] = ()) -> Boosted:
    xs, ys = [], []
    made = training_pages()
    for k, page in enumerate([*made, *pages]):
        nodes, x = features(parse(page))
        generated = k < len(made)
        if not generated and not any(n.tag in ("article", "main") for n in nodes):
            continue
        xs.append(x)
        ys.append(_labels(nodes, (lambda n: n.marked) if generated else _semantic))
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def main_text(root: Node, nodes: list[Node], odds: np.ndarray) -> str:
    kept = decode(nodes, odds)
    return "\n".join(text for node, text in blocks(root) if id(node) in kept)


def report(pages: DataFrame, sample: int = 200, sample_chars: int = 200_000) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    The trees' sample has at most ``sample`` pages of under ``sample_chars`` characters each, which bounds what the
    driver holds; text is extracted from every page, of any length.
    """
    pages = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    whole = pages.filter("html is not null and page_id is not null").filter(F.length("html") < sample_chars)
    # ids first, so that tasks send their smallest ids to be merged and not their pages
    ids = [r.page_id for r in whole.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    chosen = [r.html for r in whole.filter(F.col("page_id").isin(ids)).select("html", "page_id").orderBy("page_id", "html").limit(sample).collect()] if ids else []
    shared = pages.sparkSession.sparkContext.broadcast(fit(chosen))

    def fn(batches):
        model = shared.value
        for batch in batches:
            out = []
            htmls = batch.column(2).to_pylist()
            for lo in range(0, len(htmls), 64):
                trees = [parse(h or "") for h in htmls[lo : lo + 64]]
                found = [features(t) for t in trees]
                odds = model.odds(np.concatenate([x for _, x in found]))
                at = 0
                for root, (nodes, x) in zip(trees, found, strict=True):
                    out.append(main_text(root, nodes, odds[at : at + len(x)]))
                    at += len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    kind = dict(pages.dtypes)
    return pages.mapInArrow(trimmed(fn), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
