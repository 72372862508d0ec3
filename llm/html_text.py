"""Main text of web pages by composite text density.

Every page becomes a tree.  For each node the parser keeps characters C, tags
T, link characters LC and link tags LT of its subtree.  The composite density
is the characters per tag, adjusted by how they divide between links and text:

    D = C/T * log(C/LC * T/LT) / log(base),  base = ln(C/PC * LC + BLC/BC * C + e)

where PC are the node's characters outside links, BLC and BC the body's, and
counts of zero are taken as one.  A node's density sum adds the densities of
its child blocks, and its own if text stands in it directly.

The container of the greatest sum is the core of the article.  The threshold is the
least density on the path from the body to the core.  Beside that path, a
subtree stays that reaches the threshold and whose sum is a fair part of the
core's, so that an article in several parts is found whole and a notice or a
list of links beside it is not; so do headings, and text blocks in the core's
own surroundings, that are not mostly links.  Lists on tags, roles and names are a second filter, on what is inside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they do to the text.
NEVER_TEXT = frozenset("script style noscript template svg math iframe object embed canvas audio video head title meta link base select option datalist textarea button input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class and id names that mark what is no article text.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login cookie cookies consent gdpr notice popup modal overlay pagination pager tags copyright legal".split()
)
#: Of these, names that articles give to parts of their own too; prose is not dropped for them.
AMBIGUOUS_NAMES = frozenset("banner header footer side sidebar aside widget comment comments respond reply replies share sharing social related recommended notice tags copyright legal".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT_BLOCKS = frozenset("p blockquote pre figure table ul ol dl".split())
CONTAINERS = BLOCKS - TEXT_BLOCKS - HEADINGS - frozenset("br hr li dt dd tr thead tbody tfoot th caption figcaption legend summary address".split())
#: Skipped elements whose text browsers read up to their end tag or the end of the page.
RAW = frozenset("script style template textarea title iframe".split())
#: A subtree beside the core belongs to the article from this part of the core's density sum on.
FAIR_PART = 0.2
#: Elements that an opening block ends, when they are still open (HTML's implied end tags).
CLOSES_P = BLOCKS - {"br"}
SAME_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article section div main body table td th ul ol dl aside nav header footer form blockquote figure html".split())


class Node:
    __slots__ = ("tag", "parent", "children", "marked", "named", "skipped", "closed", "chars", "tags", "link_chars", "link_tags", "density", "density_sum", "block")

    def __init__(self, tag, parent=None, marked=False, named=frozenset(), skipped=False):
        self.tag, self.parent, self.marked, self.named, self.skipped = tag, parent, marked, named, skipped
        self.children: list = []  # nodes and strings in page order
        self.closed = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0
        self.block = tag in BLOCKS  # or holds a block

    def nodes(self) -> list:
        return [c for c in self.children if isinstance(c, Node)]


def is_marked(tag: str, attrs) -> bool:
    """Whether tag, role or visibility say: not article text."""
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in BOILERPLATE:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in BOILERPLATE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def boilerplate_names(tag: str, attrs) -> frozenset:
    """Words of class and id that say: perhaps not article text."""
    if tag in ("html", "body", "main", "article"):
        return frozenset()
    return frozenset(w for name, value in attrs if name in ("class", "id") for w in re.split(r"[^a-z]+", (value or "").lower())) & BOILERPLATE_NAMES


def mark_named(root: Node) -> None:
    """Mark named nodes that their content does not speak against.

    A subtree with an <article> or <main> stays; on a page without, so does one
    with most of the page's plain text.  So does prose, half of it outside links at least, under an
    ambiguous name: in an article or as a text block of its own.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, inside) for c in node.children if isinstance(c, Node))
    plain, links, holds = {}, {}, {}
    for node, _ in reversed(order):
        nodes = [c for c in node.children if isinstance(c, Node) and not c.marked]
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        plain[node], links[node] = own + sum(plain[c] for c in nodes), sum(links[c] for c in nodes)
        if node.tag == "a":
            plain[node], links[node] = 0, links[node] + plain[node]
        holds[node] = any(c.tag in ("article", "main") or holds[c] for c in nodes)
    for node, inside in order:
        if not node.named or holds[node] or not holds[root] and 2 * plain[node] > plain[root]:
            continue
        block = inside or node.tag in ("p", "section", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")
        node.marked |= not (block and node.named <= AMBIGUOUS_NAMES and plain[node] > links[node])


class TreeBuilder(HTMLParser):
    """Builds the tree as browsers do for unclosed paragraphs, items and cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root
        self.open: Counter = Counter()

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._leave({"head"})
        if tag in VOID and tag in NEVER_TEXT:
            return
        if tag in CLOSES_P:
            self._leave({"p"})
        if tag in SAME_CLOSE:
            self._leave(SAME_CLOSE[tag])
        node = Node(tag, self.at, is_marked(tag, attrs), boilerplate_names(tag, attrs), tag in NEVER_TEXT)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag]:
            self._close(lambda node: node.tag == tag)
            # The element was met on the way, so that it was the last one to be closed.
            self.last.closed = True

    def _close(self, found) -> None:
        """Close open elements up to the first that is ``found``."""
        while self.at is not self.root:
            self.last, self.at = self.at, self.at.parent
            self.open[self.last.tag] -= 1
            if found(self.last):
                return

    def _leave(self, tags):
        """Close the nearest open element of ``tags`` unless a container stands between."""
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node is not self.root:
            if node.tag in tags:
                return self._close(lambda n: n is node)
            if node.tag in SCOPES or node.skipped:
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def release_unclosed(root: Node) -> None:
    """Skipped elements without an end tag skip only what stands before their first block."""
    stack = [root]
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, Node) and child.skipped and not child.closed and child.tag not in RAW:
                first = next((i for i, c in enumerate(child.children) if isinstance(c, Node) and c.tag in BLOCKS), len(child.children))
                rest, child.children = child.children[first:], child.children[:first]
                kept.append(child)
                for c in rest:
                    if isinstance(c, Node):
                        c.parent = node
                kept.extend(rest)
            else:
                kept.append(child)
        node.children = kept
        stack.extend(c for c in kept if isinstance(c, Node) and not (c.skipped and (c.closed or c.tag in RAW)))


def drop_skipped(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not c.skipped]
        stack.extend(node.nodes())


def parse(page: str, lists: bool = True) -> Node:
    """The page's tree; without ``lists`` no tag, role or name marks anything."""
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    # Released content may hold unclosed elements of its own, which come up in turn.
    release_unclosed(builder.root)
    drop_skipped(builder.root)
    if lists:
        mark_named(builder.root)
    else:
        stack = [builder.root]
        while stack:
            node = stack.pop()
            node.marked = False
            stack.extend(node.nodes())
    return builder.root


def measure(root: Node) -> Node:
    """Fill counts and densities bottom-up; returns the body, or the root where there is none."""
    order, stack, body = [], [root], root
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "body" and body is root:
            body = node
        stack.extend(node.nodes())
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            else:
                node.block |= child.block
                node.chars += child.chars
                node.tags += 1 + child.tags
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    for node in order:
        node.density = composite_density(node, body)
    for node in reversed(order):
        node.density_sum = sum(c.density for c in node.nodes() if c.block and not c.marked)
        if any(not c.isspace() if isinstance(c, str) else c.chars and not c.block and not c.marked for c in node.children):
            node.density_sum += node.density
    return body


def composite_density(node: Node, body: Node) -> float:
    if not node.chars:
        return 0.0
    c, t = node.chars, max(1, node.tags)
    lc, lt = max(1, node.link_chars), max(1, node.link_tags)
    plain = max(1, c - node.link_chars)
    base = math.log(c / plain * node.link_chars + body.link_chars / max(1, body.chars) * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 0.1)


def core_and_threshold(body: Node) -> tuple[Node, float]:
    """The container of the greatest density sum outside of marked ones, the outermost of equals, and the path's least density.

    A paragraph, list, table or heading is no article by itself; what holds it is.
    """
    core, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.density_sum > core.density_sum and node.tag in CONTAINERS:
            core = node
        stack.extend(c for c in reversed(node.nodes()) if not c.marked)
    threshold, node = core.density, core
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    return core, threshold


def content_nodes(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order."""
    body = measure(root)
    core, threshold = core_and_threshold(body)
    before, after, node = [], [], core
    while node is not body:
        parent, met = node.parent, False
        left, right = [], []
        for child in parent.children:
            met |= child is node
            if child is node or isinstance(child, str) or child.marked or not child.chars:
                continue
            text = child.tag in HEADINGS or child.tag in TEXT_BLOCKS and parent is not body
            if text and 2 * child.link_chars < child.chars or child.density >= threshold and child.density_sum >= FAIR_PART * core.density_sum:
                (right if met else left).append(child)
        before, after, node = left + before, after + right, parent
    return [*before, core, *after]


def is_menu(node: Node, threshold: float) -> bool:
    """A block of several links and little else, below the threshold."""
    return node.tag in BLOCKS and node.link_tags > 1 and node.density < threshold and 3 * node.link_chars >= 2 * node.chars


def block_texts(node: Node, drop=lambda n: False) -> list[str]:
    """Texts of the subtree's blocks in page order, each with single spaces."""
    blocks, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    stack = [iter(node.children)]
    ends = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(child, str):
            run.append(child)
        elif not child.marked and not drop(child):
            block = child.tag in BLOCKS
            if block:
                flush()
            stack.append(iter(child.children))
            ends.append(block)
    flush()
    return blocks


def main_text(page: str | None, lists: bool = True) -> str:
    """The article's text: blocks in page order joined by a space; empty where there is none."""
    if not page or not page.strip():
        return ""
    kept = content_nodes(parse(page, lists))
    least = min((n.density for n in kept), default=0.0)
    return " ".join(text for n in kept for text in block_texts(n, lambda c: is_menu(c, least)))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text``, ``n_chars``.

    Null, empty and blank pages give an empty text and 0.  Text without any
    markup is one block.  Repeated rows stay; other columns are not read.
    """

    def extract(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(extract, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
