"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Every element gets features of its subtree (text, links, density), its attribute tokens and those
above it, its depth and its siblings. Boosted trees give the odds that it belongs to the main
text. Choices are then made for the whole page at once: an element can only be taken if its
parent is, and of all such choices the likeliest is found by one pass up and one down the tree.

The trees are fitted on at most ``SAMPLE_PAGES`` pages (those with the least hash of their id,
of at most ``SAMPLE_BYTES`` bytes each) with labels from the pages' own structure: what is inside
``article`` or ``main`` is main text unless a tag or an attribute token says otherwise. Each
sampled page is also used with boilerplate put between its paragraphs and with its article
renamed, so that the trees do not lean on one tag.

Block texts have their character references decoded, white space runs as one space, and are
joined by an empty line, in page order; nothing is capped. Defined results: a null or blank html
has no text; repeated rows give repeated results; an empty table gives an empty result; extra columns
are kept, and one named as a result is replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import map_columns, quoted, texts

SAMPLE_PAGES = 300
SAMPLE_BYTES = 200_000
SEED = 7
PAGES_AT_ONCE = 100

#: HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
BOILER_TAGS = frozenset("nav header footer aside form script style head title noscript iframe button select option input textarea svg template dialog menu".split())
MAIN_TAGS = frozenset("article main".split())
#: Tokens of class, id and role that tell of boilerplate or of main text.
BOILER_TOKENS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notification pagination paywall popup promo related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_TOKENS = frozenset("article body content entry main post story text".split())
#: Start tags that end an open element of the same list.
CLOSERS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

#: A tag with quoted attributes; where a quote is never closed, the tag ends at its first ``>``.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*)>)|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "depth", "own", "links", "order", "in_link")

    def __init__(self, tag: str, tokens: frozenset[str], parent: Node | None, order: int) -> None:
        self.tag, self.tokens, self.parent, self.order = tag, tokens, parent, order
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.own = self.links = 0
        #: Whether its text is a link's: it is one, or it is inline and its parent's text is.
        self.in_link = tag == "a" or (tag in INLINE and parent is not None and parent.in_link)
        if parent:
            parent.children.append(self)


class Page:
    """Elements in document order and the page's text as (element, text) in order.

    A text of None marks the border of a block.
    """

    def __init__(self, html: str) -> None:
        self.nodes = [Node("#page", frozenset(), None, 0)]
        self.flow: list[tuple[Node, str | None]] = []
        self._read(html)

    def _open(self, tag: str, attributes: str, under: Node) -> Node:
        found: set[str] = set()
        if "=" in attributes:
            for m in _ATTR.finditer(attributes):
                found.update(_TOKEN.findall((m[2] or m[3] or m[4] or "").lower()))
        node = Node(tag, frozenset(found), under, len(self.nodes))
        self.nodes.append(node)
        return node

    def _read(self, html: str) -> None:
        at, now = 0, self.nodes[0]
        #: The open elements of each tag, innermost last; the deepest of several is the nearest.
        open_tags: dict[str, list[Node]] = {}

        def pop_to(node: Node) -> Node:
            """Closes the node and all that is open inside it."""
            x = now
            while True:
                open_tags[x.tag].pop()
                if x.tag not in INLINE:
                    self.flow.append((x, None))
                if x is node:
                    return x.parent
                x = x.parent

        def nearest(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> Node | None:
            found = max((open_tags[t][-1] for t in tags if open_tags.get(t)), key=lambda x: x.depth, default=None)
            if found is not None and any(open_tags[t][-1].depth > found.depth for t in stop if open_tags.get(t)):
                return None
            return found

        end_of_tags = html.rfind(">") + 1  # what follows holds no tag
        for m in _TAG.finditer(html, 0, end_of_tags):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(now, html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(html)  # a comment that is never closed
                continue
            tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
            if m[1]:
                if (node := nearest((tag,))) is not None:
                    now = pop_to(node)
                elif tag == "br" or tag == "p":
                    self.flow.append((now, None))
                continue
            if tag == "br":
                self.flow.append((now, " "))
                continue
            if tag not in INLINE and (node := nearest(("p",), ("table", "button"))) is not None:
                now = pop_to(node)
            if tag in CLOSERS and (node := nearest(CLOSERS[tag], ("ul", "ol", "table", "dl", "select"))) is not None:
                now = pop_to(node)
            if tag in VOID:
                if tag not in INLINE:
                    self.flow.append((now, None))
                continue
            node = self._open(tag, attributes, now)
            if tag not in INLINE:
                self.flow.append((node, None))
            if tag in RAW:
                end = _END[tag].search(html, at)
                node.own = 0
                close = html.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(html)
                continue
            if not attributes.endswith("/"):
                open_tags.setdefault(tag, []).append(node)
                now = node
        if at < len(html):
            self._text(now, html[at:])

    def _text(self, node: Node, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.flow.append((node, text))
        n = len(text) - text.count(" ") - text.count("\n")
        node.own += n
        if node.in_link:
            node.links += n

    def features(self) -> np.ndarray:
        """One row per element; see the names in ``FEATURES``."""
        nodes = self.nodes
        n = len(nodes)
        text, links, tags, paras = ([0] * n for _ in range(4))
        for x in reversed(nodes):  # children come after their parents
            i = x.order
            text[i] += x.own
            links[i] += x.links
            tags[i] += 1
            paras[i] += x.tag == "p"
            if x.parent is not None:
                p = x.parent.order
                text[p] += text[i]
                links[p] += links[i]
                tags[p] += tags[i]
                paras[p] += paras[i]
        whole = max(1, text[0])
        above = [(False, False, False, False)] * n
        rows, seen = [], 0
        for x in nodes:
            i, parent = x.order, x.parent
            up = above[parent.order] if parent is not None else (False,) * 4
            own = (x.tag in MAIN_TAGS, x.tag in BOILER_TAGS, bool(x.tokens & MAIN_TOKENS), bool(x.tokens & BOILER_TOKENS))
            here = tuple(a or b for a, b in zip(up, own, strict=True))
            above[i] = here
            siblings = parent.children if parent is not None else [x]
            rest = (text[parent.order] - text[i]) / max(1, len(siblings) - 1) if parent is not None else 0.0
            rows.append((
                x.depth, text[i], x.own, links[i] / max(1, text[i]), tags[i], text[i] / tags[i], text[i] / whole, seen / whole, paras[i],
                len(siblings), rest, x.tag in INLINE, x.tag in ("ul", "ol", "li"), x.tag in ("p", "pre", "blockquote", "td") or x.tag[:1] == "h" and x.tag[1:].isdigit(),
                *own, *here,
            ))
            seen += x.own
        return np.array(rows, np.float64)

    def labels(self) -> np.ndarray | None:
        """What the page's structure says of each element; nothing if it has no article."""
        inside, boiler = [False] * len(self.nodes), [False] * len(self.nodes)
        holds = [False] * len(self.nodes)
        for x in self.nodes:
            p = x.parent.order if x.parent is not None else None
            inside[x.order] = x.tag in MAIN_TAGS or (p is not None and inside[p])
            boiler[x.order] = x.tag in BOILER_TAGS or bool(x.tokens & BOILER_TOKENS) or (p is not None and boiler[p])
        for x in reversed(self.nodes):
            holds[x.order] |= x.tag in MAIN_TAGS
            if x.parent is not None:
                holds[x.parent.order] |= holds[x.order]
        if not holds[0]:
            return None
        return np.array([(i or h) and not b for i, h, b in zip(inside, holds, boiler, strict=True)], float)

    def text(self, taken: np.ndarray) -> str:
        blocks, block = [], []
        for node, part in self.flow:
            if part is None:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif taken[node.order]:
                block.append(part)
        if block:
            blocks.append("".join(block))
        return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


FEATURES = (
    "depth text own_text link_share tags text_per_tag page_share position paragraphs siblings sibling_text inline list block "
    "main_tag boiler_tag main_token boiler_token in_main_tag in_boiler_tag in_main_token in_boiler_token"
).split()


class BoostedTrees:
    """Gradient boosting with logistic loss on binned features; trees as flat arrays."""

    def __init__(self, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        odds = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            tree = self._tree(binned, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            odds += self._one(tree, x)
        return self

    def _tree(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level by level; slot i has the children 2i+1 (at most the cut) and 2i+2."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        members = {0: np.arange(len(g))}
        while members:
            slot, rows = members.popitem()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[slot] = -self.rate * gs / (hs + self.ridge)
            if 2 * slot + 2 >= size or len(rows) < 2:
                continue
            best, pick = 1e-6, None
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, pick = float(gain[k]), (f, k)
            if pick:
                f, k = pick
                feature[slot], cut[slot] = f, cuts[f][k]
                low = binned[rows, f] <= k
                members[2 * slot + 1], members[2 * slot + 2] = rows[low], rows[~low]
        return feature, cut, value

    def _one(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        slot, every = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[slot]
            slot = np.where(f < 0, slot, 2 * slot + 1 + (x[every, np.maximum(f, 0)] > cut[slot]))
        return value[slot]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._one(tree, x)
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The likeliest choice in which every taken element has a taken parent.

    Log-likelihoods only matter by their difference, the odds: an element is worth its odds plus
    its children's worth where that is positive, and is taken with its parent if it is worth it.
    """
    worth = odds.astype(float).copy()
    for x in reversed(page.nodes):
        if x.parent is not None and worth[x.order] > 0:
            worth[x.parent.order] += worth[x.order]
    taken = np.zeros(len(odds), bool)
    for x in page.nodes:
        taken[x.order] = worth[x.order] > 0 and (x.parent is None or taken[x.parent.order])
    return taken


def variants(html: str, rng: random.Random) -> Iterator[tuple[Page, np.ndarray]]:
    """A page for training, as it is, and with boilerplate put in and its article renamed."""
    page = Page(html)
    if (y := page.labels()) is not None:
        yield page, y
    cuts = [m.start() for m in re.finditer(r"<p[\s>]", html)]
    said = [re.sub(r"<[^>]*>", " ", html[a:b])[:300] for a, b in zip(cuts, cuts[1:])] or ["Read more"]
    for at in sorted(rng.sample(cuts, min(3, len(cuts))), reverse=True):
        token, tag = rng.choice(sorted(BOILER_TOKENS)), rng.choice(["div", "section", "aside", "form", "div"])
        html = f'{html[:at]}<{tag} class="{token}"><p>{rng.choice(said)}</p></{tag}>{html[at:]}'
    page = Page(html)
    if (y := page.labels()) is not None:
        name = rng.choice(sorted(MAIN_TOKENS))
        for x in page.nodes:
            if x.tag in MAIN_TAGS:
                x.tag, x.tokens = "div", frozenset([name])
        yield page, y


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> BoostedTrees | None:
    """Trees from the bounded sample; its features are computed in tasks. None if there is nothing to learn from."""
    usable = pages.select(F.xxhash64(quoted(id_col).cast("string")).alias("h"), quoted(html_col).alias("html")).filter(F.octet_length("html").between(1, SAMPLE_BYTES))
    sample = usable.orderBy("h", "html").limit(SAMPLE_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for page, y in variants(html, random.Random(h ^ SEED)):
                    rows = np.column_stack([page.features(), y])
                    yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["row"])

    rows = np.array([r["row"] for r in sample.mapInArrow(run, "row array<double>").collect()])  # bounded by the sample
    if not len(rows) or len(np.unique(rows[:, -1])) < 2:
        return None
    return BoostedTrees().fit(rows[:, :-1], rows[:, -1])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None, model: BoostedTrees | None = None) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``; the model is fitted on the pages if none is given.

    Where there is nothing to learn from, an element's structure decides: all that no tag or token
    tells to be boilerplate is taken.
    """
    model = model or fit(pages, id_col, html_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    made = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        trees, out, htmls = shared.value, [], texts(columns[0])
        for k in range(0, len(htmls), PAGES_AT_ONCE):
            parsed = [Page(html) for html in htmls[k : k + PAGES_AT_ONCE]]
            x = np.concatenate([page.features() for page in parsed])
            odds = trees.odds(x) if trees is not None else np.where(x[:, -1] + x[:, -3] > 0, -1.0, 1.0)
            ends = np.cumsum([len(page.nodes) for page in parsed])
            out += [page.text(decode(page, own)) for page, own in zip(parsed, np.split(odds, ends[:-1]), strict=True)]
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    return map_columns(pages, [quoted(html_col)], pages.columns if keep is None else keep, made, work)
