"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree in one pass. Each node that can be a block gets features: its
tag and attribute tokens against short word lists (own and of ancestors), subtree text, tag
and link density, punctuation, depth, place among siblings. Gradient-boosted trees (numpy,
histogram splits) give the odds that it belongs to the article. The decoder then picks the best
consistent labelling of the tree: below a dropped node nothing is kept.

Labels come from the pages themselves: nodes inside ``article`` or ``main`` are article, nodes
inside navigation, headers, footers, asides, forms or blocks named so are not, others teach
nothing. Every example is also shown with the density and structure of another node, so that
names decide where there are any, and without names, so that density and structure decide on
pages that do not name their parts.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import sampled, slices, table

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<loose>[^>]*)(?:>|\Z))",
    re.S,
)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements of the HTML standard by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
NEVER = RAW | frozenset("head select option button svg canvas object audio video map datalist dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt".split())
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])), "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
OUTSIDE_TAGS = frozenset("nav header footer aside form".split())
INSIDE_TAGS = frozenset("article main".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share social sharing follow comment comments reply replies disqus "
    "respond cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login search form toolbar "
    "pagination pager copyright legal disclaimer skip toc tags tag meta complementary contentinfo".split()
)
INSIDE_WORDS = frozenset("article content main post entry story body text maincontent articlebody prose".split())


@dataclass
class Page:
    """Tree of block nodes; texts in page order with the node they are directly in."""

    tag: list = field(default_factory=list)
    parent: list = field(default_factory=list)
    words: list = field(default_factory=list)  # hits in (outside, inside) word lists
    never: list = field(default_factory=list)
    tags: list = field(default_factory=list)  # elements opened directly in the node
    links: list = field(default_factory=list)  # characters directly in the node and a link
    texts: list = field(default_factory=list)  # (node, text, starts a new block)


def parse(source: str) -> Page:
    """One pass over tags; unclosed and stray ones are mended as browsers do, roughly.

    An element is a node if it is a block, is never text, or is named like a page part;
    other elements belong to the node around them.
    """
    page = Page()

    def add(tag, parent, hits, never):
        for store, value in zip((page.tag, page.parent, page.words, page.never, page.tags, page.links), (tag, parent, hits, never, 0, 0)):
            store.append(value)
        return len(page.tag) - 1

    stack = [("", add("", -1, (0, 0), False))]  # (element, its node)
    names: dict[str, int] = {}  # open elements by name
    at, fresh = 0, True

    def text(piece):
        nonlocal fresh
        node = stack[-1][1]
        if not page.never[node]:
            piece = html.unescape(piece) if "&" in piece else piece
            page.texts.append((node, piece, fresh))
            fresh = False
            if names.get("a"):
                page.links[node] += len(piece.strip())

    def pop_to(i):
        nonlocal fresh
        for tag, _ in stack[i:]:
            names[tag] -= 1
            fresh = fresh or tag in BLOCK
        del stack[i:]

    def close(targets, stops):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in targets:
                pop_to(i)
                return
            if stack[i][0] in stops:
                return

    length = len(source)
    for m in TAG.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("end"):
            if names.get(name):
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name)
                pop_to(i)
            elif name == "br":
                fresh = True
            continue
        node = stack[-1][1]
        page.tags[node] += 1
        if name in VOID:
            fresh = fresh or name in ("br", "hr")
            continue
        if name in ENDS_P and names.get("p"):
            close(frozenset(["p"]), frozenset("button table td th caption object".split()))
        if name in CLOSES and any(names.get(t) for t in CLOSES[name][0]):
            close(*CLOSES[name])
            if name == "tr":
                close(frozenset(["tr"]), CLOSES[name][1])
        node = stack[-1][1]
        attrs = m.group("attrs") or m.group("loose") or ""
        hits, hidden = (0, 0), False
        if attrs:
            found = {w.lower() for v in NAMED.findall(attrs) for w in WORDS.findall("".join(v))}
            hits, hidden = (len(found & OUTSIDE_WORDS), len(found & INSIDE_WORDS)), bool(HIDDEN.search(attrs))
        if name in BLOCK or name in NEVER or hits[0] or hidden:
            node = add(name, node, hits, page.never[node] or name in NEVER or hidden)
        stack.append((name, node))
        names[name] = names.get(name, 0) + 1
        fresh = fresh or name in BLOCK
        if attrs.rstrip().endswith("/") and name in ("svg", "path", "use"):
            pop_to(len(stack) - 1)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else length
            pop_to(len(stack) - 1)
    if at < length:
        text(source[at:])
    return page


FEATURES = 20
#: Features that name a node's part (its own and its ancestors' tags and attribute words).
NAMES = slice(0, 4)


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the nodes and the characters directly in each."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, stops, commas, words = (np.zeros(n) for _ in range(4))
    for node, t, _ in page.texts:
        t = t.strip()
        if t:
            own[node] += len(t)
            stops[node] += t.count(".") + t.count("!") + t.count("?")
            commas[node] += t.count(",")
            words[node] += t.count(" ") + 1
    links, tags = np.array(page.links, float), np.array(page.tags, float)
    total = np.stack([own, links, tags, stops, commas, words], axis=1)
    direct = total.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    x = np.zeros((n, FEATURES))
    hits = np.array(page.words, float).reshape(n, 2)
    depth, nth, children = np.zeros(n), np.zeros(n), np.zeros(n)
    heads, items, paragraphs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        p = parent[i]
        tag = page.tag[i]
        outside = tag in OUTSIDE_TAGS or hits[i, 0] > 0
        part = -1 if outside else int(tag in INSIDE_TAGS or hits[i, 1] > 0)
        x[i, 0], x[i, 1], x[i, 2] = outside, part > 0, part
        heads[i], items[i], paragraphs[i] = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag in ("li", "dt", "dd"), tag in ("p", "blockquote", "pre")
        if p >= 0:
            depth[i] = depth[p] + 1
            nth[i] = children[p]
            children[p] += 1
            # The part the node lies in: nothing below another part is article again.
            x[i, 2] = -1 if x[p, 2] < 0 else part or x[p, 2]
            x[i, 3] = x[p, 2]
    order = np.cumsum(own) - own
    x[:, 4], x[:, 5], x[:, 6] = heads, items, paragraphs
    x[:, 7] = np.log1p(total[:, 0])
    x[:, 8] = total[:, 0] / (total[:, 2] + 1)
    x[:, 9] = total[:, 1] / np.maximum(total[:, 0], 1)
    x[:, 10] = total[:, 3] / np.maximum(total[:, 5], 1)
    x[:, 11] = total[:, 4] / np.maximum(total[:, 5], 1)
    x[:, 12] = np.log1p(direct[:, 5])
    x[:, 13] = depth
    up = np.maximum(parent, 0)
    x[:, 14] = nth / np.maximum(children[up], 1)
    x[:, 15] = np.log1p(children[up])
    x[:, 16] = total[:, 0] / np.maximum(total[up, 0], 1)
    x[:, 17] = total[:, 0] / max(total[0, 0], 1)
    x[:, 18] = (order + own / 2) / max(own.sum(), 1)
    x[:, 19] = np.log1p(children)
    return x, own


def weak_labels(page: Page) -> np.ndarray:
    """1 inside an article, 0 inside another part, -1 unknown; the nearest part decides."""
    label = np.full(len(page.tag), -1)
    for i in range(1, len(page.tag)):
        p = page.parent[i]
        label[i] = label[p]
        if page.tag[i] in OUTSIDE_TAGS or page.words[i][0] or page.never[i]:
            label[i] = 0
        elif page.tag[i] in INSIDE_TAGS and label[p] != 0:
            label[i] = 1
    return label


@dataclass
class Trees:
    """Boosted regression trees of equal depth: per level-order node a feature and a cut."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """Logistic gradient boosting with histogram splits (second-order gains).

    Rows of one kind only, or none, give a constant: their smoothed log-odds.
    """
    inner = 2**depth - 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not len(y) or y.min() == y.max():
        return Trees(feature[:0], cut[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            best = {}
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * bins + binned[:, j]
                gs, hs = (np.cumsum(np.bincount(cell, w, 2**level * bins).reshape(2**level, bins), axis=1) for w in (g, h))
                lg, lh, tg, th = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
                for k, b in enumerate(gain.argmax(axis=1)):
                    if gain[k, b] > best.get(k, (1e-6,))[0]:
                        best[k] = (gain[k, b], j, b)
            for k, (_, j, b) in best.items():
                feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        gs, hs = (np.bincount(at - inner, w, inner + 1) for w in (g, h))
        leaf[t] = -rate * gs / (hs + ridge)
        score += leaf[t][at - inner]
    return Trees(feature, cut, leaf, base)


def decode(page: Page, logit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Best labelling in which nothing below a dropped node is kept.

    A node weighs by its own text, a node without text a little, so that containers follow
    their contents.
    """
    value = np.clip(logit, -6, 6) * (0.1 + np.sqrt(own))
    value[np.array(page.never)] = -1e9
    value[0] = 0
    keep, drop = value.copy(), -value
    for i in range(len(value) - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    chosen = np.zeros(len(value), bool)
    chosen[0] = keep[0] >= drop[0]
    for i in range(1, len(value)):
        chosen[i] = chosen[page.parent[i]] and keep[i] > drop[i]
    return chosen


def main_text(page: Page, chosen: np.ndarray) -> str:
    """Kept texts in page order; blocks and any white space become single spaces."""
    out, skipped = [], False
    for node, text, new in page.texts:
        skipped |= new
        if chosen[node]:
            out.append(f" {text}" if skipped else text)
            skipped = False
    return " ".join("".join(out).split())


#: Pages from which the trees are learned, picked by hash.
MAX_PAGES = 400


def fit(pages: DataFrame, key: str, source: str, bound: int = MAX_PAGES, seed: int = 3) -> Trees:
    """Trees learned from weak labels of at most ``bound`` pages of up to 50 000 characters."""
    rows = pages.select(key, source).filter(F.length(source) <= 50_000)
    picked = sampled(rows, [key, source], bound, 4).select(source).toArrow().column(0).to_pylist()
    xs, ys = [np.zeros((0, FEATURES))], [np.zeros(0)]
    for text in sorted(picked):
        page = parse(text)
        x, own = features(page)
        label = weak_labels(page)
        known = (label >= 0) & ~np.array(page.never)
        xs.append(x[known])
        ys.append(label[known].astype(float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    hidden, mixed = x.copy(), x.copy()
    hidden[:, NAMES] = 0
    mixed[:, NAMES.stop :] = x[np.random.default_rng(seed).permutation(len(x)), NAMES.stop :]
    return boost(np.concatenate([x, mixed, hidden]), np.concatenate([y, y, y]))


def extract(pages: DataFrame, keep: list[str], source: str, model: Trees) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``.

    A null or empty page, and one without text to keep, gives an empty text. Text outside
    any element is judged like a node. Equal pages give equal texts.
    """
    rows = pages.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keep)], F.col(source).alias("_html"))
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_html"):
                found = [parse(s or "") for s in part.column("_html").to_pylist()]
                made = [features(p) for p in found]
                logit = model.logit(np.concatenate([x for x, _ in made]))
                ends = np.cumsum([len(o) for _, o in made])
                texts = [main_text(p, decode(p, logit[e - len(o) : e], o)) for p, (_, o), e in zip(found, made, ends)]
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def op5_boosted_dom(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, ["page_id", "url"], "html", fit(pages, "page_id", "html"))
