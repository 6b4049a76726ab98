"""Main text of web pages by a tree-structured graphical model.

Every element of the page's tree carries a hidden label, content or not. Its own features
(tag, class and id words, amount of text, share of links) give a node potential, and a
table per kind of child ties it to its parent. Sum-product messages run once upward and
once downward, which makes the marginals exact on a tree; text of elements whose content
marginal reaches one half is kept. Pages of a batch are one forest, and messages of a
depth are computed together.

The weights maximise the likelihood of labelled pages (a bounded sample of pages that
mark their article themselves), with a prior that already knows the common names of page
furniture; without any labelled page the prior is the model.

A null or empty page has the empty text. Bad markup is read as far as it goes: stray end
tags are ignored, open elements end with their parent, a lone "<" is text. Repeated pages
give repeated results. White space inside a block is one space, blocks are joined by an
empty line.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.catalog import query, table
from tidewire.llm.common import lowest_hashes, map_rows

SAMPLE_PAGES = 400
SAMPLE_CHARS = 200_000       # longer pages are not used for training

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
_UNSEEN = frozenset("script style noscript template iframe noembed noframes".split())
_BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul title head option select textarea caption""".split())
_ENDS_P = _BLOCKS - frozenset("option select textarea title head html body td th tr tbody thead tfoot caption".split())
# A start tag ends the open elements named here, up to the nearest of the second set.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
             "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_TABLE_EDGE = frozenset("table td th button caption object".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")

# Names of page furniture and of articles, as used in class, id and role values.
FURNITURE = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    consent contentinfo cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar
    navigation newsletter notice pager pagination popup promo promoted recommended related respond search share sharing
    sidebar signup social sponsor sponsored subscribe tags toolbar widget""".split())
ARTICLE = frozenset("article articlebody content entry main post story".split())
FURNITURE_TAGS = frozenset("nav aside footer form menu button select dialog template noscript script style iframe "
                           "head header fieldset textarea".split())


@dataclass
class Tree:
    """A parsed page: elements in page order and the run of texts and block borders."""
    tags: list[str] = field(default_factory=lambda: ["#page"])
    words: list[frozenset] = field(default_factory=lambda: [frozenset()])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, str | None]] = field(default_factory=list)      # (element, text); None is a block border


def parse(page: str) -> Tree:
    tree, stack, at, quotes = Tree(), [0], 0, True
    open_p = 0

    def text(raw: str) -> None:
        if raw:
            tree.pieces.append((stack[-1], entities.unescape(raw)))

    def close_to(level: int) -> None:
        nonlocal open_p
        while len(stack) > level:
            tag = tree.tags[stack.pop()]
            open_p -= tag == "p"
            if tag in _BLOCKS:
                tree.pieces.append((-1, None))

    def find(names, stop) -> int:
        """Level of the nearest open element with one of the names, or 0."""
        for level in range(len(stack) - 1, 0, -1):
            tag = tree.tags[stack[level]]
            if tag in names:
                return level
            if tag in stop:
                return 0
        return 0

    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = (_TAG if quotes else _PLAIN_TAG).match(page, lt)
        if m is None and page.startswith("<!--", lt):
            text(page[at:lt])
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if m is None and page.startswith(("<!", "<?", "</"), lt):
            text(page[at:lt])
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        if m is None:
            m = _PLAIN_TAG.match(page, lt)
            quotes = quotes and m is None
        if m is None:
            text(page[at:lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
            elif tag == "p" and not open_p:
                tree.pieces.append((-1, None))
            else:
                level = find((tag,), ())
                if level:
                    close_to(level)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _ENDS_P and open_p:
            level = find(("p",), _TABLE_EDGE)
            if level:
                close_to(level)
        if tag in _SIBLINGS:
            level = find(*_SIBLINGS[tag])
            if level:
                close_to(level)
        words = frozenset(w for _, value in _ATTRIBUTE.findall(m[3]) for w in _WORD.findall(value.lower())) if m[3] else frozenset()
        tree.tags.append(tag)
        tree.words.append(words)
        tree.parent.append(stack[-1])
        tree.depth.append(len(stack))
        if tag in _BLOCKS:
            tree.pieces.append((-1, None))
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        stack.append(len(tree.tags) - 1)
        open_p += tag == "p"
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag not in _UNSEEN:
                text(page[at:stop])
            close = page.find(">", stop) if end else -1
            at = len(page) if close < 0 else close + 1
            close_to(len(stack) - 1)
    return tree


# ---- features and potentials ------------------------------------------------------------------------------------

_TAGS = ("article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure figcaption "
         "a b i em strong span code img br hr nav aside footer header form button select input label iframe script style "
         "noscript template head body html title meta link").split()
NAMES = [*(f"tag={t}" for t in _TAGS), "tag=other", "furniture tag", "furniture word", "article word", "article tag",
         *(f"text={k}" for k in range(5)), *(f"links={k}" for k in range(4)), "heading", "sentence", "always"]
_AT = {n: i for i, n in enumerate(NAMES)}
KINDS = 3        # of children: inline, block, furniture
_PRIOR = {"furniture tag": -5.0, "furniture word": -4.0, "article word": 3.0, "article tag": 6.0, "tag=p": 1.0, "heading": 0.3,
          "links=3": -1.0, "tag=body": -3.0, "tag=html": -3.0, "tag=head": -4.0, "sentence": 0.3}
# Per kind of child, by parent's and child's label; furniture says nothing about its parent.
_PRIOR_EDGES = np.array([[[1.5, -1.5], [-1.0, 1.5]], [[1.5, -1.5], [-1.0, 1.5]], [[0.0, -1.5], [0.0, 1.5]]])


def _features(tree: Tree) -> list[list[int]]:
    own, linked = [0] * len(tree.tags), [0] * len(tree.tags)
    stops = [False] * len(tree.tags)
    for node, text in tree.pieces:
        if text is not None:
            n = len(text.strip())
            own[node] += n
            stops[node] |= any(c in text for c in ".!?;")
    for i in range(len(tree.tags) - 1, 0, -1):      # text inside inline children counts for the block as well
        if tree.tags[i] not in _BLOCKS:
            own[tree.parent[i]] += own[i]
            linked[tree.parent[i]] += own[i] if tree.tags[i] == "a" else linked[i]
            stops[tree.parent[i]] |= stops[i]
    out = []
    for tag, words, n, a, stop in zip(tree.tags, tree.words, own, linked, stops):
        f = [_AT.get(f"tag={tag}", _AT["tag=other"]), _AT["always"],
             _AT["text=0"] + (0 if n == 0 else 1 if n <= 20 else 2 if n <= 80 else 3 if n <= 300 else 4)]
        if n:
            f.append(_AT["links=0"] + min(3, 4 * a // (n + 1)))
        if tag in FURNITURE_TAGS:
            f.append(_AT["furniture tag"])
        if tag in ("article", "main"):
            f.append(_AT["article tag"])
        if words & FURNITURE:
            f.append(_AT["furniture word"])
        elif words & ARTICLE:
            f.append(_AT["article word"])
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            f.append(_AT["heading"])
        if stop:
            f.append(_AT["sentence"])
        out.append(f)
    return out


class Forest:
    """Elements of several pages with their features, arranged by depth for the messages."""

    def __init__(self, trees: list[Tree]):
        self.sizes = [len(t.tags) for t in trees]
        first = np.cumsum([0] + self.sizes[:-1])
        features = [f for t in trees for f in _features(t)]
        self.of = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.ids = np.array([i for f in features for i in f], dtype=np.int64)
        self.parent = np.concatenate([np.array(t.parent) + a for t, a in zip(trees, first)])
        self.kind = np.array([2 if tag in FURNITURE_TAGS or words & FURNITURE else 1 if tag in _BLOCKS else 0
                              for t in trees for tag, words in zip(t.tags, t.words)])
        depth = np.concatenate([np.array(t.depth) for t in trees])
        order = np.argsort(depth, kind="stable")
        starts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(starts, starts[1:])]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray      # of node features, for the label content
    edges: np.ndarray        # (kind of child, parent's label, child's label)

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of every element, and pair marginals (element, parent's label, own label)."""
        n = len(forest.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(forest.of, weights=self.weights[forest.ids], minlength=n)
        message = np.zeros((n, 2))
        for level in reversed(forest.levels[1:]):
            message[level] = np.logaddexp.reduce(self.edges[forest.kind[level]] + up[level][:, None, :], axis=2)
            for y in (0, 1):
                up[:, y] += np.bincount(forest.parent[level], weights=message[level, y], minlength=n)
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            above = forest.parent[level]
            rest = up[above] + down[above] - message[level]
            joint = rest[:, :, None] + self.edges[forest.kind[level]]
            down[level] = np.logaddexp.reduce(joint, axis=1)
            joint = joint + up[level][:, None, :]
            pair[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair


def prior() -> Model:
    weights = np.zeros(len(NAMES))
    for name, value in _PRIOR.items():
        weights[_AT[name]] = value
    return Model(weights, _PRIOR_EDGES.copy())


def labels_of(tree: Tree) -> np.ndarray | None:
    """Labels of a page that marks its article; None for other pages."""
    out = np.zeros(len(tree.tags), dtype=np.int64)
    for i in range(1, len(tree.tags)):
        tag, words = tree.tags[i], tree.words[i]
        inside = out[tree.parent[i]] == 1
        if tag in ("article", "main") or "articlebody" in words:
            out[i] = 1
        elif inside:
            out[i] = not (words & FURNITURE or tag in FURNITURE_TAGS and tag != "header")
    return out if out.any() else None


def train(pages: list[str], rounds: int = 60, rate: float = 0.2, l2: float = 0.3) -> Model:
    """Gradient ascent (AdaGrad) on the likelihood of the labelled pages, with a Gaussian around the prior."""
    start = prior()
    trees = [parse(p) for p in pages if p]
    marked = [(t, y) for t in trees if (y := labels_of(t)) is not None]
    if not marked:
        return start
    forest, y = Forest([t for t, _ in marked]), np.concatenate([y for _, y in marked])
    weights, edges = start.weights.copy(), start.edges.copy()
    child = np.concatenate(forest.levels[1:])
    seen = np.zeros_like(edges)
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    size, gw, ge = len(marked), np.full_like(weights, 1e-6), np.full_like(edges, 1e-6)
    for _ in range(rounds):
        content, pair = Model(weights, edges).marginals(forest)
        step = np.bincount(forest.ids, weights=(y - content)[forest.of], minlength=len(weights)) / size
        step -= l2 * (weights - start.weights)
        edge = (seen - np.stack([pair[child][forest.kind[child] == k].sum(axis=0) for k in range(KINDS)])) / size
        edge -= l2 * (edges - start.edges)
        gw += step ** 2
        ge += edge ** 2
        weights += rate * step / np.sqrt(gw)
        edges += rate * edge / np.sqrt(ge)
    return Model(weights, edges)


def _text(tree: Tree, content: np.ndarray) -> str:
    blocks, held = [], []
    for node, text in [*tree.pieces, (-1, None)]:
        if text is None:
            words = "".join(held).split()
            if words:
                blocks.append(" ".join(words))
            held = []
        elif content[node]:
            held.append(text)
    return "\n\n".join(blocks)


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    trees = [parse(p or "") for p in pages]
    if not trees:
        return []
    content, _ = model.marginals(Forest(trees))
    out, at = [], 0
    for tree in trees:
        out.append(_text(tree, content[at:at + len(tree.tags)] >= 0.5))
        at += len(tree.tags)
    return out


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Model:
    """Train on a bounded sample of the pages, chosen by a hash of the page."""
    usable = (pages.select(F.xxhash64("page_id").alias("h"), F.col("page_id"), F.col("html").cast("string").alias("html"))
              .where(F.char_length("html").between(1, SAMPLE_CHARS)))
    # a share of the hashes first, so that a task sends a few pages and not a sample of its own
    rows = (usable.where(F.col("h") <= lowest_hashes(4 * sample, usable.count())).orderBy("h", "page_id")
            .limit(sample).select("html").collect())
    return train([r["html"] for r in rows])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars."""
    def run(page_id, url, html):
        text = []
        for at in range(0, len(html), 256):
            text += main_texts(html[at:at + 256], model)
        return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(t) for t in text]}
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return map_rows(rows, ["page_id", "url", "html"], run, "page_id bigint, url string, text string, n_chars bigint")


@query("op4_pages")
def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
