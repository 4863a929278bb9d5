"""Main text of web pages by wrapper induction.

Every page of a host is parsed into a DOM tree and aligned by simple tree matching with one of them,
the reference. Nodes of the reference whose text is the same in most other pages are the site's
template, the others are slots; the smallest subtree that holds the slots with running text is the
content region. The wrapper of a host is that region's path. Each page is then aligned with it and
the region's blocks are its text.

Inside the region a passage that pages share stays (articles quote and repeat), but elements that
say what they are, such as navigation, forms, adverts or comments, go wherever they stand. A host
without two different pages, or a page without the region, is judged by its own tree in the
same way.

The reference is the page whose length is nearest to the mean of its host; equal pages count once. What
a page has in common with it are some numbers, which are counted per host and node and merged per
task before the shuffle, so a host with a third of all pages sends little more than any other. References
and wrappers are one row per host: while they fit they are broadcast and pages stay where they are
read; beyond that both are shuffled, and a host with many pages is cut into pieces by its measured number.

Defined results: NULL and empty pages, and pages without an article, have the empty text. A page
with a NULL url belongs to the host of empty name. Repeated rows are kept. Malformed declarations are
comments. Nothing is cut.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from stagecast.llm.common import grouped_rows, materialise, ready
from stagecast.llm.url_filter import host_path
from stagecast.operators.lookup import lookup_join, row_counts

#: Characters of references whose trees a task keeps at a time.
KEPT_CHARS = 4_000_000
#: Levels of a page that are aligned node by node.
DEPTH = 60
#: Paired children of two nodes that are kept for the way back; more are paired once more.
KEPT_PAIRS = 32

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements that never hold main text.
NEVER = set(
    "aside button canvas dialog footer form head header iframe input label math menu nav noscript object script select style svg "
    "template textarea title".split()
)
#: Words of a class, id or role that mark such elements.
_MARKS = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disclaimer|footer|header|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[^a-z])"
)
#: Elements that a start tag of the key ends.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_SCOPES = {"ul", "ol", "table", "dl", "article", "section", "div", "body", "main", "nav", "aside", "header", "footer", "form", "td", "th", "blockquote"}


class Node:
    """An element: label (tag with class and role), children, which are nodes and texts."""

    __slots__ = ("boilerplate", "children", "inner", "label", "tag")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()):
        self.tag, (self.label, self.boilerplate) = tag, _named(tag, tuple(attrs))
        self.children: list[Node | str] = []
        self.inner: list[Node] = []  # those children that are elements

    def add(self, child: "Node | str") -> None:
        self.children.append(child)
        if isinstance(child, Node):
            self.inner.append(child)

    def elements(self) -> list["Node"]:
        return self.inner


@lru_cache(maxsize=4096)
def _named(tag: str, attrs: tuple[tuple[str, str | None], ...]) -> tuple[str, bool]:
    """Label of an element and whether it is boilerplate. Pages of a host repeat their elements, so many are known."""
    named = {k: (v or "") for k, v in attrs}
    marks = " ".join(named.get(k, "") for k in ("class", "id", "role")).lower()
    # An id names one element of one page, so it is no part of what pages have in common.
    shared = " ".join(named[k] for k in ("class", "role") if named.get(k, "").strip()).lower()
    return f"{tag}.{shared}" if shared else tag, tag in NEVER or bool(marks and _MARKS.search(marks)) or "hidden" in named


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def _close(self, tags: set[str], scopes: set[str]) -> None:
        """Close the innermost open element of ``tags``, with all it holds, unless a scope is between."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                del self.open[depth:]
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close({"p"}, _SCOPES)
        if tag in _ENDS:
            self._close(_ENDS[tag], {"ul", "ol", "table", "dl", "select"} if tag != "tr" else {"table"})
        node = Node(tag, attrs)
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, set())

    def handle_data(self, data):
        self.open[-1].add(data)

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def parse_html_declaration(self, i):
        # Only "<!DOCTYPE" and "<!--" mean anything in HTML; "<![if ..]>" and the like are comments.
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order; boilerplate is left out."""
    done, current = [], []

    def end() -> None:
        text = " ".join("".join(current).split())
        if text:
            done.append(text)
        current.clear()

    # Depth first without recursion: pages may be nested deeply.
    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            current.append(item)
        elif item is node or not item.boilerplate:
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            if item.tag == "br":
                current.append(" ")
            stack.extend(reversed(item.children))
    end()
    return done


def text_of_node(node: Node) -> str:
    return "\n".join(blocks(node))


def _leaf(node: Node) -> bool:
    return node.boilerplate or not node.inner


def _trim(left: list[Node], right: list[Node]) -> tuple[int, int]:
    """Equal leaves at both beginnings, then at both ends: a best match may pair them in order."""
    most, begin, end = min(len(left), len(right)), 0, 0
    while begin < most and left[begin].label == right[begin].label and _leaf(left[begin]) and _leaf(right[begin]):
        begin += 1
    while end < most - begin and left[-1 - end].label == right[-1 - end].label and _leaf(left[-1 - end]) and _leaf(right[-1 - end]):
        end += 1
    return begin, end


#: For two nodes, the size of their match and the children it pairs.
_Sizes = dict[tuple[int, int], tuple[int, list[tuple[Node, Node]] | None]]


def _children_matched(a: Node, b: Node, depth: int, sizes: _Sizes) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the best match of two child lists, and the children it pairs.

    Rows of the table are vectors: a row is the running maximum of what each pair would add. Of
    each row only a bit per cell is kept for the way back.
    """
    left, right = a.elements(), b.elements()
    begin, end = _trim(left, right)
    pairs = [*zip(left[:begin], right[:begin]), *(zip(left[len(left) - end :], right[len(right) - end :]) if end else ())]
    left, right = left[begin : len(left) - end], right[begin : len(right) - end]
    if not left or not right:
        return len(pairs), pairs
    names = {label: k for k, label in enumerate(dict.fromkeys(n.label for n in [*left, *right]))}
    right_names, right_leaf = np.array([names[n.label] for n in right]), np.array([_leaf(n) for n in right])
    row, taken, moved = np.zeros(len(right) + 1, np.int64), [], []
    for x in left:
        equal = right_names == names[x.label]
        gain = equal.astype(np.int64)
        if not _leaf(x):
            for j in np.flatnonzero(equal & ~right_leaf).tolist():
                gain[j] = _matched(x, right[j], depth + 1, sizes)
        paired = np.where(equal, row[:-1] + gain, 0)
        fresh = np.zeros(len(right) + 1, np.int64)
        np.maximum.accumulate(np.maximum(row[1:], paired), out=fresh[1:])
        moved.append(np.packbits(fresh[1:] == fresh[:-1]))     # the right one may stay alone
        taken.append(np.packbits(fresh[1:] == row[1:]))        # the left one may stay alone
        row = fresh
    i, j = len(left), len(right)
    while i and j:
        bit, byte = 7 - (j - 1) % 8, (j - 1) // 8
        if taken[i - 1][byte] >> bit & 1:
            i -= 1
        elif moved[i - 1][byte] >> bit & 1:
            j -= 1
        else:
            pairs.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
    return begin + end + int(row[-1]), pairs


def _matched(a: Node, b: Node, depth: int, sizes: _Sizes) -> int:
    key = id(a), id(b)
    if key not in sizes:
        if depth > DEPTH or _leaf(a) or _leaf(b):
            sizes[key] = 1, []
        else:
            most, pairs = _children_matched(a, b, depth, sizes)
            sizes[key] = 1 + most, pairs if len(pairs) <= KEPT_PAIRS else None
    return sizes[key][0]


def tree_matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest order-preserving match of two trees, and its pairs.

    Roots match if their labels are equal; then the children are aligned by dynamic programming
    over the sizes of their own matches. Boilerplate is aligned as a whole, and so is what lies
    ``DEPTH`` levels deep, where no region begins. Memory is a number and up to ``KEPT_PAIRS`` paired children per
    pair of inner nodes with equal labels, and a bit or two per pair of siblings.
    """
    if a.label != b.label:
        return 0, []
    sizes: _Sizes = {}
    total, pairs, open_pairs = _matched(a, b, 0, sizes), [], [(a, b, 0)]
    while open_pairs:  # only what is part of the match is walked again for its pairs
        x, y, depth = open_pairs.pop()
        pairs.append((x, y))
        if depth <= DEPTH and not _leaf(x) and not _leaf(y):
            held = sizes[id(x), id(y)][1] if (id(x), id(y)) in sizes else None
            open_pairs.extend((u, v, depth + 1) for u, v in (_children_matched(x, y, depth, sizes)[1] if held is None else held))
    return total, pairs


def _parents(root: Node) -> dict[int, Node]:
    parents, stack = {}, [root]
    while stack:
        node = stack.pop()
        for child in node.elements():
            parents[id(child)] = node
            if not child.boilerplate:
                stack.append(child)
    return parents


def _weights(root: Node, fixed: set[int]) -> dict[int, int]:
    """Characters of running text, not constant and not in links, in the subtree of each element."""
    weights: dict[int, int] = {}
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, done, quiet = stack.pop()
        quiet = quiet or node.tag == "a" or node.boilerplate or id(node) in fixed
        if done:
            own = 0 if quiet else sum(len(c.strip()) for c in node.children if isinstance(c, str))
            weights[id(node)] = own + sum(weights.get(id(c), 0) for c in node.elements())
        elif not node.boilerplate:
            stack.append((node, True, quiet))
            stack.extend((c, False, quiet) for c in node.elements())
    return weights


def region(root: Node, fixed: set[int]) -> Node | None:
    """The content region: the deepest element that holds four fifths of the running text of the slots.

    If an article or main element on the way holds as much, or one below the last holds the larger
    part of it, it is that one: the tag decides between regions that the text leaves open.
    """
    weights, node, named = _weights(root, fixed), root, None
    total = weights.get(id(root))
    if not total:
        return None
    while True:
        inner = max((c for c in node.elements() if c.tag in BLOCKS), key=lambda c: weights.get(id(c), 0), default=None)
        if inner is None or 5 * weights.get(id(inner), 0) < 4 * weights[id(node)] or inner.tag == "p":
            break
        node = inner
        if node.tag in ("article", "main") and 5 * weights[id(node)] >= 4 * total:
            named = node
    if named:
        return named
    stack = node.elements()
    while stack:
        item = stack.pop()
        if item.tag in ("article", "main") and 2 * weights.get(id(item), 0) > weights[id(node)] and (
            named is None or weights[id(item)] > weights[id(named)]
        ):
            named = item
        stack.extend(c for c in item.elements() if not c.boilerplate)
    return named or node


def path_to(root: Node, node: Node) -> list[str]:
    parents, path = _parents(root), []
    while node is not root:
        path.append(node.label)
        node = parents[id(node)]
    return path[::-1]


def leaves(root: Node) -> list[Node]:
    """Elements without elements, in a fixed order, which is their number."""
    found, stack = [], [root]
    while stack:
        inner = (node := stack.pop()).elements()
        stack.extend(inner)
        if not inner:
            found.append(node)
    return found


def in_common(first: Node, texts: dict[int, tuple[int, str]], other: Node) -> list[int]:
    """Numbers of the leaves of ``first`` that have the same text in ``other``; ``texts`` are of :func:`leaf_texts`."""
    met = ((texts[id(x)], y) for x, y in tree_matching(first, other)[1] if id(x) in texts)
    return [number for (number, text), y in met if text == text_of_node(y)]


def leaf_texts(root: Node) -> dict[int, tuple[int, str]]:
    """Number and text of each leaf."""
    return {id(node): (number, text_of_node(node)) for number, node in enumerate(leaves(root))}


def _wrapper(first: Node, shared: dict[int, int], others: int) -> list[str] | None:
    """Label path of the content region of ``first``; ``shared`` says with how many of the others a leaf is shared."""
    constant = {id(node) for number, node in enumerate(leaves(first)) if 2 * shared.get(number, 0) > others}
    found = region(first, constant)
    return path_to(first, found) if found is not None and found is not first else None


def induce(pages: list[str]) -> list[str] | None:
    """Label path of the content region that pages of one host have in common, if it can be told.

    The first page is the reference.
    """
    trees = [parse(p) for p in dict.fromkeys(pages)]
    if len(trees) < 2:
        return None
    first, others = trees[0], trees[1:]
    texts = leaf_texts(first)
    return _wrapper(first, Counter(n for other in others for n in in_common(first, texts, other)), len(others))


def extract(html: str, wrapper: list[str] | None) -> str:
    """Main text of one page, by its host's wrapper or, where that doesn't fit, by itself."""
    root = parse(html)
    held = [root]
    for label in wrapper or ():
        held = [c for node in held for c in node.elements() if c.label == label]
    if not wrapper or not held:
        own = region(root, set())
        held = [] if own is None else [own]
    return "\n".join(t for t in map(text_of_node, held) if t)


def references(pages: DataFrame) -> DataFrame:
    """One row per host, stored: host, reference, the page whose length is nearest to the mean."""
    filled = pages.where(F.length("html") > 0).select("host", "html")
    means = materialise(filled.groupBy("host").agg(F.avg(F.length("html")).alias("mean")), "mean-lengths")
    placed = lookup_join(filled, means, ["host"], row_counts(filled, ["host"]))
    order = F.struct(F.abs(F.length("html") - F.col("mean")), F.xxhash64("html"))
    return materialise(placed.groupBy("host").agg(F.min_by("html", order).alias("reference")), "references")


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (JSON), learned from all its pages. ``pages`` has host and html."""
    chosen = references(pages)
    filled = pages.where(F.length("html") > 0).select("host", "html")
    others = lookup_join(filled, chosen, ["host"], row_counts(filled, ["host"])).where("html <> reference")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, chars = {}, 0
        for hosts, htmls, firsts in grouped_rows(batches, ["host", "html", "reference"]):
            numbers = []
            for html, first in zip(htmls, firsts):
                if first not in kept:
                    if chars > KEPT_CHARS:
                        kept, chars = {}, 0
                    root = parse(first)
                    kept[first], chars = (root, leaf_texts(root)), chars + len(first)
                # The number -1 counts the pages themselves.
                numbers.append([-1, *in_common(*kept[first], parse(html))])
            digests = [xxh3_128_digest(html.encode("utf-8", "surrogatepass")) for html in htmls]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(numbers, pa.list_(pa.int32()))], ["host", "page", "shared"]
            )

    aligned = others.mapInArrow(align, "host string, page binary, shared array<int>")
    distinct = aligned.groupBy("host", "page").agg(F.first("shared").alias("shared"))  # equal pages share the same
    counts = distinct.select("host", F.explode("shared").alias("leaf")).groupBy("host", "leaf").agg(F.count(F.lit(1)).alias("n"))
    by_host = counts.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "n"))).alias("counts"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, firsts, counted in grouped_rows(batches, ["host", "reference", "counts"]):
            shared = [dict(c or ()) for c in counted]
            made = [json.dumps(_wrapper(parse(first), s, s[-1]) if s else None) for first, s in zip(firsts, shared)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.string())], ["host", "wrapper"])

    return chosen.join(by_host, "host", "left").mapInArrow(learn, "host string, wrapper string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    ready(pages.sparkSession)
    host, _ = host_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    learned = materialise(wrappers(rows), "wrappers")
    met = lookup_join(rows, learned, ["host"], row_counts(rows, ["host"]), "left").select(id_col, url_col, "html", "wrapper")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(html, json.loads(wrapper) if wrapper else None)
                for htmls, found in grouped_rows([batch], ["html", "wrapper"]) for html, wrapper in zip(htmls, found)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column(url_col), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    kinds = dict(rows.dtypes)
    return met.mapInArrow(apply, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
