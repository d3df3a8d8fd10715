"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text node is a variable: content or not.  A node's own potential comes from
features of its tag, its class, id and role, its text's length, links and punctuation; a potential for
each parent-child edge couples the two.  Sum-product messages go up the tree and down again and
give exact marginals; text whose marginal is at least a half is kept.  The weights are fitted by
gradient ascent on the likelihood of labelled pages, with the same messages for expectations.

Blocks are joined in page order by one line feed, white space within a block is one space.  Defined
cases: null, empty and tagless input are pages too (bare text is content if the model says so);
scripts, styles, titles and form controls never give text; repeated rows give repeated rows; ids are whole
numbers (text ids are cast, one that is no number is an error) and may be null; an empty table gives no rows; further
columns are ignored.  A title in a header within the article goes with that header; labels of drawings in the article stay.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import labelled_pages
from quillon.llm.dom import Page, parse

GROUPS = {
    "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "label": "form", "legend": "form", "dialog": "dialog",
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "blockquote": "quote", "pre": "pre", "li": "li", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li",
    "table": "table", "tbody": "table", "tr": "row", "td": "cell", "th": "cell", "a": "a", "figure": "figure", "figcaption": "figure", "address": "address", "ins": "ins", "body": "body", "html": "html", "center": "div", "time": "time", "small": "small",
}
#: Parts of class, id and role names and what they speak for, the first that occurs counting.
NAMES = [
    (re.compile(p), kind)
    for p, kind in (
        (r"comment|disqus|reply|replies|discussion|feedback", "comment"),
        (r"cookie|consent|gdpr|notice|banner|alert|popup|modal|overlay|announce|warning|toast", "notice"),
        (r"(^|[-_ ])(ad|ads|adv|advert\w*|sponsor\w*|promo\w*|dfp|adsense)([-_ \d]|$)|advert|sponsor", "ad"),
        (r"sidebar|side-bar|rail|widget|related|recommend|trending|popular|also|more-", "side"),
        (r"breadcrumb|nav|menu|toolbar|pagination|pager|tabs|toc|skip", "nav"),
        (r"foot|copyright|legal|colophon", "footer"),
        (r"share|social|follow|subscribe|newsletter|signup|login|search|form", "form"),
        (r"masthead|topbar|site-head|header|branding|logo", "header"),
        (r"article|post|entry|story|content|main|body|text|prose|page", "content"),
    )
]


def named(attrs: dict | None) -> str | None:
    """What an element's names speak for."""
    names = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower() if attrs else ""
    return next((kind for p, kind in NAMES if p.search(names)), None) if names.strip() else None


def comments_of(page: Page) -> list[bool]:
    """Whether each node stands in an element named for comments that does not hold the page's own title or main part."""
    n = len(page.tag)
    holds, within = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i] or page.tag[i] in ("h1", "main")
    for i in range(1, n):
        own = page.tag[i] not in ("", "html", "body", "main") and not holds[i] and named(page.attrs[i]) == "comment"
        within[i] = own or within[page.parent[i]]
    return within


def features(page: Page) -> list[list[str]]:
    """Names of each node's active features."""
    n = len(page.tag)
    size, linked, ends = [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[i] == "a"
        if not page.tag[i]:
            text = page.text[i].strip()
            size[i] = len(text)
            linked[i] = len(text) if inside[i] else 0
            ends[i] = sum(map(text.count, ".!?。"))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
    found: list[list[str]] = [["root"]]
    discussed = comments_of(page)
    for i in range(1, n):
        tag, parent = page.tag[i], page.tag[page.parent[i]]
        own = [f"size{min(12, size[i].bit_length())}"]
        if size[i]:
            own.append(f"links{int(4 * linked[i] / size[i])}")
            own.append(f"ends{min(3, ends[i])}")
        if not tag:
            found.append(["text", f"under-{GROUPS.get(parent, 'other')}", *(f"text-{x}" for x in own), *["in-comments"] * discussed[i]])
            continue
        group = "title" if tag == "h1" else "heading" if re.fullmatch("h[2-6]", tag) else GROUPS.get(tag, "other")
        # Elements that by their meaning hold a page's text may hold little of it.
        found.append(["element", f"tag-{group}", *([] if group in ("article", "main") else own)])
        if discussed[i]:
            found[-1].append("in-comments")
        attrs = page.attrs[i]
        if attrs:
            kind = named(attrs)
            if kind:
                found[-1] += [f"name-{kind}", f"tag-{group} name-{kind}"]
            if "hidden" in attrs:
                found[-1].append("hidden")
    return found


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def marginals(parent: list[int], own: list[float], kind: list[int], edges: list[tuple]) -> tuple[list[float], list[float], list[float]]:
    """P(content) of each node, and of each edge that both, or only the child, are content.

    ``own`` are log-odds of the nodes' potentials; ``edges[kind]`` = log-potentials (00, 01, 10, 11)
    of (parent, child).  Messages are log-odds.
    """
    n = len(parent)
    up, belief = [0.0] * n, list(own)
    for i in range(n - 1, 0, -1):  # children stand behind their parents
        e, b = edges[kind[i]], belief[i]
        # log of sum over the child's states, for either state of the parent
        up[i] = (e[2] + _softplus(e[3] - e[2] + b)) - (e[0] + _softplus(e[1] - e[0] + b))
        belief[parent[i]] += up[i]
    full = list(belief)
    both, child = [0.0] * n, [0.0] * n
    for i in range(1, n):
        e, b = edges[kind[i]], belief[i]
        above = full[parent[i]] - up[i]  # the parent without this child
        # log-weights of (parent, child) relative to (0, 0)
        w01, w10, w11 = e[1] - e[0] + b, e[2] - e[0] + above, e[3] - e[0] + above + b
        top = max(0.0, w01, w10, w11)
        x00, x01, x10, x11 = math.exp(-top), math.exp(w01 - top), math.exp(w10 - top), math.exp(w11 - top)
        total = x00 + x01 + x10 + x11
        both[i], child[i] = x11 / total, x01 / total
        p = min(max((x01 + x11) / total, 1e-300), 1 - 1e-16)
        full[i] = math.log(p) - math.log1p(-p)
    return [_sigmoid(x) for x in full], both, child


class Model:
    """Weights of features, and of edges by kind."""

    def __init__(self, weights: dict[str, float], edges: list[tuple]):
        self.weights, self.edges = weights, edges

    def content(self, page: Page) -> list[float]:
        get = self.weights.get
        own = [sum([get(f, 0.0) for f in fs]) for fs in features(page)]
        return marginals(page.parent, own, kinds(page), self.edges)[0]


EDGES = 6
#: Kind of an edge below each tag; all other edges between elements are of kind 0, those to texts of kind 1.
BELOW = {"#root": 2, "html": 2, "body": 2, "div": 3, "section": 3, "article": 4, "main": 4} | dict.fromkeys("nav menu header footer aside form dialog fieldset".split(), 5)


def kinds(page: Page) -> list[int]:
    """Kind of each node's edge to its parent: below the page itself, a box, an article and a part beside it couplings differ."""
    tag = page.tag
    return [5 if BELOW.get(tag[p]) == 5 else 1 if not own else BELOW.get(tag[p], 0) for p, own in zip(page.parent, tag)]


class Forest:
    """Labelled pages as arrays, their nodes by depth, so that messages of all pages go up and down together."""

    def __init__(self, pages: list[tuple[Page, list[int]]]):
        found = [features(page) for page, _ in pages]
        self.names = sorted({f for fs in found for own in fs for f in own})
        number = {f: i for i, f in enumerate(self.names)}
        starts = np.cumsum([0, *(len(page.tag) for page, _ in pages)])
        self.n = int(starts[-1])
        self.parent = np.concatenate([np.maximum(page.parent, 0) + a for (page, _), a in zip(pages, starts)])
        self.kind = np.concatenate([kinds(page) for page, _ in pages])
        self.label = np.concatenate([labels for _, labels in pages])
        self.node = np.repeat(np.arange(self.n), [len(own) for fs in found for own in fs])
        self.feature = np.array([number[f] for fs in found for own in fs for f in own])
        depth = np.zeros(self.n, int)
        roots = set(starts.tolist())
        for i, above in enumerate(self.parent.tolist()):
            depth[i] = 0 if i in roots else depth[above] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.children = np.flatnonzero(depth > 0)

    def expected(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As marginals(), for all pages at once."""
        e = edges[self.kind]
        soft = lambda x: np.logaddexp(0.0, x)
        belief = np.bincount(self.node, weights[self.feature], self.n)
        up, both, child = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        for own in reversed(self.levels):
            x, b = e[own], belief[own]
            up[own] = (x[:, 2] + soft(x[:, 3] - x[:, 2] + b)) - (x[:, 0] + soft(x[:, 1] - x[:, 0] + b))
            np.add.at(belief, self.parent[own], up[own])
        full = belief.copy()
        for own in self.levels:
            x, b = e[own], belief[own]
            above = full[self.parent[own]] - up[own]
            logs = np.stack([np.zeros(len(own)), x[:, 1] - x[:, 0] + b, x[:, 2] - x[:, 0] + above, x[:, 3] - x[:, 0] + above + b], axis=1)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            both[own], child[own] = odds[:, 3], odds[:, 1]
            p = np.clip(odds[:, 1] + odds[:, 3], 1e-300, 1 - 1e-16)
            full[own] = np.log(p) - np.log1p(-p)
        return 0.5 * (1 + np.tanh(full / 2)), both, child


def fit(pages: list[tuple[Page, list[int]]], rounds: int = 150, rate: float = 0.7, decay: float = 0.001) -> Model:
    """Maximum likelihood with exact expectations from messages; steps scaled by past gradients."""
    made = Forest(pages)
    weights, edges = np.zeros(len(made.names)), np.zeros((EDGES, 4))
    seen_w, seen_e = np.full(weights.shape, 1e-6), np.full(edges.shape, 1e-6)
    own, above = made.children, made.parent[made.children]
    pairs = 2 * made.label[above] + made.label[own]
    had = np.zeros(edges.shape)
    np.add.at(had, (made.kind[own], pairs), 1)
    for _ in range(rounds):
        p, both, child = made.expected(weights, edges)
        slope = np.bincount(made.feature, (made.label - p)[made.node], len(weights)) / len(pages) - decay * weights
        expect = np.stack([1 - p[above] - child[own], child[own], p[above] - both[own], both[own]], axis=1)
        slope_e = had.copy()
        np.subtract.at(slope_e, made.kind[own], expect)
        slope_e = slope_e / len(pages) - decay * edges
        seen_w += slope**2
        seen_e += slope_e**2
        weights += rate * slope / np.sqrt(seen_w)
        edges += rate * slope_e / np.sqrt(seen_e)
    return Model(dict(zip(made.names, weights.tolist())), [tuple(e) for e in edges.tolist()])


def labels_of(page: Page) -> list[int]:
    """1 for a text under data-main="1", and for an element if most of its text is."""
    n = len(page.tag)
    inherited, good, size = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        mark = (page.attrs[i] or {}).get("data-main")
        inherited[i] = int(mark) if mark in ("0", "1") else inherited[page.parent[i]]
        if not page.tag[i]:
            size[i] = len(page.text[i].strip())
            good[i] = size[i] * inherited[i]
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        size[page.parent[i]] += size[i]
    return [int(2 * g > s) if s else inherited[i] for i, (g, s) in enumerate(zip(good, size))]


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model fitted on the labelled pages of this package."""
    pages = [parse(source) for source in labelled_pages.pages()]
    return fit([(page, labels_of(page)) for page in pages])


def extract(source: str | None, model: Model) -> str:
    """The page's main text."""
    page = parse(source)
    keep = model.content(page)
    blocks: list[list[str]] = []
    last = None
    for i in range(1, len(page.tag)):
        text = page.text[i]
        if not text:
            continue
        if page.tag[i]:  # a line break is white space of its block
            if last == page.block[i] and blocks:
                blocks[-1].append(" ")
        elif keep[i] >= 0.5:
            if last != page.block[i]:
                blocks.append([])
                last = page.block[i]
            blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    model = model or trained()

    def run(batches):
        for batch in batches:
            found = [extract(x.as_py(), model) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
