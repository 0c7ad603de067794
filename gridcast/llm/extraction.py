"""HTML extraction by a tree-structured graphical model.

A page's block elements form a tree; every node is content or not. A node's own
features (tag, words of class, id and role, share of linked text, length of text)
give its evidence, and parent-child potentials tie it to its parent. Sum-product
messages go up from the leaves and down from the root, and give every node's
exact content marginal. Text whose block has a marginal of one half or more is kept.

Potentials are counted on labelled pages: pages that declare their parts (an
``article`` or ``main`` element; a sample of at most about ``SAMPLE_PAGES``, chosen by a hash), and a small set of labelled
skeleton pages built from conventional names, so that parts which a corpus never
shows in declared pages are known too.

Reading is forgiving: end tags close what they can, paragraphs, list items and
table cells end where the next begins, inline elements don't break a block, and
a page may stop anywhere. ``br`` is white space.

Edge cases: null or empty html gives an empty text; a page without content an
empty text; nodes of any depth and number are handled without recursion;
repeated rows repeat; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2_000
SKELETON_WEIGHT = 20
LONG_TEXT = 100
RESULT = "page_id long, url string, text string, n_chars long"

# HTML elements by how they shape text.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video"}
#: An element that ends when one of these begins beside it, and the elements that bound the search.
ENDS = {
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"},
}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
# Conventional names of page parts.
DECLARED = {"article", "main"}
SIDE_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "title", "textarea", "fieldset", "input", "label")
SIDE_NAMES = (
    "ad ads advert advertisement advertising sponsor sponsored promo banner navigation nav menu navbar breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget related recommended trending popular share sharing social comment comments reply replies respond discussion disqus cookie "
    "cookies consent notice alert popup modal overlay gdpr subscribe subscription newsletter signup login search form copyright legal disclaimer toolbar "
    "pagination pager tags meta byline skip hidden outbrain taboola paywall"
).split()
MAIN_NAMES = "article content post entry story body main text".split()
NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("parent", "tag", "names", "chars", "linked", "mark")

    def __init__(self, parent: int, tag: str, names: list[str], mark: str | None):
        self.parent, self.tag, self.names, self.mark = parent, tag, names, mark
        self.chars = self.linked = 0


class Page(HTMLParser):
    """Block nodes in document order (a parent before its children), and text blocks with the node that holds them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "#page", [], None)]
        self.blocks: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.text: list[str] = []
        self.links = self.unseen = 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            self.text.clear()
            if words:
                node = self.stack[-1][1]
                self.nodes[node].chars += len(words)
                self.blocks.append((node, words))

    def pop(self, depth: int) -> None:
        """Closes the elements above ``depth``."""
        if any(tag not in INLINE for tag, _ in self.stack[depth:]):
            self.flush()
        for tag, _ in self.stack[depth:]:
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "wbr"):
            self.text.append(" " if tag == "br" else "")
            return
        if tag not in INLINE:
            for depth in range(len(self.stack) - 1, 0, -1):
                open_tag = self.stack[depth][0]
                if tag in ENDS.get(open_tag, ()):
                    self.pop(depth)
                    break
                if open_tag not in INLINE and (open_tag not in ENDS or tag in BOUNDS.get(open_tag, ())) and open_tag not in ("tbody", "thead", "tfoot"):
                    break
            self.flush()
        if tag in VOID:
            return
        node = self.stack[-1][1]
        if tag not in INLINE:
            named = [v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v]
            mark = next((k for k, _ in attrs if k in ("data-keep", "data-drop")), None)
            self.nodes.append(Node(node, tag, sorted(set(NAME.findall(" ".join(named).lower()))), mark))
            node = len(self.nodes) - 1
        self.stack.append((tag, node))
        self.links += tag == "a"
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self.pop(depth)
                return
            # An inline end tag doesn't close the blocks around it.
            if tag in INLINE and self.stack[depth][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            if self.links:
                self.nodes[self.stack[-1][1]].linked += len(data)


def features(node: Node) -> list[str]:
    share = 0 if not node.chars else min(int(4 * node.linked / node.chars), 4)
    return [f"tag={node.tag}", f"link={share}", f"size={(node.chars > 0) + (node.chars >= LONG_TEXT)}", *(f"name={n}" for n in node.names)]


def labels(page: Page) -> list[int] | None:
    """Content (1) or not (0) for each node of a page that declares its parts; None for other pages.

    A node is content if content holds at least half of the text below it; text
    is content below a declared part, unless a part that is none lies between.
    """
    sure = any(n.mark == "data-keep" or n.tag in DECLARED for n in page.nodes)
    if not sure:
        return None
    inside: list[int] = []
    for n in page.nodes:
        above = inside[n.parent] if n.parent >= 0 else 0
        side = n.mark == "data-drop" or n.tag in SIDE_TAGS or (n.tag not in DECLARED and any(x in SIDE_SET for x in n.names))
        inside.append(0 if side else 1 if n.mark == "data-keep" or n.tag in DECLARED else above)
    below = [(n.chars * k, n.chars) for n, k in zip(page.nodes, inside)]
    for i in range(len(page.nodes) - 1, 0, -1):
        p = page.nodes[i].parent
        below[p] = (below[p][0] + below[i][0], below[p][1] + below[i][1])
    return [k if n.chars or not total else int(2 * kept >= total) for n, k, (kept, total) in zip(page.nodes, inside, below)]


SIDE_SET = set(SIDE_NAMES)


def skeletons() -> list[str]:
    """Labelled pages built from the conventional names: parts beside the content, parts inside it, and its containers."""
    long, short = "word " * 60, "word " * 6
    inside = f"<h1>word</h1><h2>word</h2><p>{long}</p><p>{short}</p><p>word</p><div><p>{long}</p></div><ul><li><a>word</a></li><li>{short}</li></ul><table><tr><td>word</td></tr></table>"
    parts = [f"<{t} data-drop>{short}{inside}<a>{short}</a></{t}>" for t in SIDE_TAGS if t not in ("head", "title", "input")]
    parts += [f'<div class="{n}" data-drop>{short}{inside}</div>' for n in SIDE_NAMES]
    body = f"<h1>{short}</h1><p>{long}</p><p>{short}</p><h2>word</h2><ul><li>{short}</li></ul><blockquote>{long}</blockquote><div><p>{long}</p><p>word</p></div><table><tr><td>word</td></tr></table><pre>{short}</pre><p>{long}</p>"
    containers = [f"<{t} data-keep>" for t in sorted(DECLARED)] + [f'<div class="{n}" data-keep>' for n in MAIN_NAMES]
    pages = []
    for i, part in enumerate(parts):
        open_tag = containers[i % len(containers)]
        close = f"</{open_tag[1:].split()[0]}>"
        pages.append(f"<html><head><title>{short}</title></head><body>{part}<div>{open_tag}{body}{close}</div></body></html>")
        pages.append(f"<html><body>{open_tag}{body}{part}<p>{long}</p>{close}<footer data-drop>{short}</footer></body></html>")
    return pages


def count(html: str) -> Counter:
    """(kind, what, label) counts of one labelled page; empty if it isn't labelled."""
    page = Page(html)
    known = labels(page)
    out: Counter = Counter()
    if known is None:
        return out
    for node, label in zip(page.nodes, known):
        out["node", "", label] += 1
        if node.parent >= 0:
            out["edge", str(known[node.parent]), label] += 1
        for f in features(node):
            out["feature", f, label] += 1
    return out


class Model:
    """Evidence per feature and parent-child potentials, from counts."""

    def __init__(self, counts: dict[tuple[str, str, int], float]):
        get = lambda *k: counts.get(k, 0)
        sizes = [get("node", "", y) + 1 for y in (0, 1)]
        self.evidence = {
            what: math.log((get("feature", what, 1) + 0.5) / (sizes[1] + 1)) - math.log((get("feature", what, 0) + 0.5) / (sizes[0] + 1))
            for kind, what, _ in counts
            if kind == "feature"
        }
        self.edge = [[(get("edge", str(p), y) + 1) / (get("edge", str(p), 0) + get("edge", str(p), 1) + 2) for y in (0, 1)] for p in (0, 1)]
        # Evidence is relative to how often either class occurs, which the edges already hold.
        self.prior = math.log(sizes[1] / sizes[0])

    def marginals(self, page: Page) -> list[float]:
        """Each node's probability of being content: messages up, then down, normalised on the way."""
        nodes, e = page.nodes, self.edge
        n = len(nodes)
        own = []
        for node in nodes:
            odds = max(-30.0, min(30.0, sum(self.evidence.get(f, 0.0) for f in features(node))))
            p = 1 / (1 + math.exp(-odds))
            own.append((1 - p, p))
        below = list(own)
        up = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            b0, b1 = below[i]
            m0, m1 = e[0][0] * b0 + e[0][1] * b1, e[1][0] * b0 + e[1][1] * b1
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            p = nodes[i].parent
            q0, q1 = below[p][0] * up[i][0], below[p][1] * up[i][1]
            below[p] = (q0 / (q0 + q1), q1 / (q0 + q1))
        root = 1 / (1 + math.exp(-self.prior))
        belief = [(0.0, 0.0)] * n
        q0, q1 = below[0][0] * (1 - root), below[0][1] * root
        belief[0] = (q0 / (q0 + q1), q1 / (q0 + q1))
        for i in range(1, n):
            p0, p1 = belief[nodes[i].parent]
            # What the parent believes without this child's own message.
            c0, c1 = p0 / max(up[i][0], 1e-300), p1 / max(up[i][1], 1e-300)
            q0 = below[i][0] * (c0 * e[0][0] + c1 * e[1][0])
            q1 = below[i][1] * (c0 * e[0][1] + c1 * e[1][1])
            belief[i] = (q0 / (q0 + q1), q1 / (q0 + q1))
        return [b for _, b in belief]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page)
        return "\n".join(words for node, words in page.blocks if content[node] >= 0.5)


def train(pages: DataFrame) -> Model:
    """Counts over the skeletons and over a sample of declared pages; only sums of counts reach the driver."""
    total = pages.count()
    share = min(1.0, SAMPLE_PAGES / max(total, 1))
    chosen = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < share * (1 << 30)).select(F.col("html").cast("string").alias("html"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                if html:
                    counts.update(count(html))
        rows = list(counts.items())
        arrays = [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "what", "label", "n"])

    found = chosen.mapInArrow(per_batch, "kind string, what string, label long, n long").groupBy("kind", "what", "label").agg(F.sum("n").alias("n"))
    counts: dict[tuple[str, str, int], float] = {(r["kind"], r["what"], r["label"]): r["n"] for r in found.collect()}
    # A name that one page uses once says little; the skeletons hold the names that count everywhere.
    for html in skeletons():
        for k, v in count(html).items():
            counts[k] = counts.get(k, 0) + v * SKELETON_WEIGHT
    return Model(counts)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page. The model, potentials of a bounded sample, goes with the tasks."""
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = train(read)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h) for h in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return read.mapInArrow(per_batch, RESULT)
