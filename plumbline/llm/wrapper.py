"""HTML extraction by wrapper induction.

The pages of a host come from a few templates.  Their trees are laid over each
other by simple tree matching: the largest number of nodes that can be paired
without crossing.  What they share is the host's template, a tree whose nodes know
on how many pages they stand, how much text and how many links they hold, and how
many different texts they had.  Nodes whose text hardly varies are template;
the node that holds most of the text that varies is the article's slot.  A page is
then laid over its host's template, and its text is what stands in the slot.

Repeated siblings (paragraphs, list items) count as one node, so a template is
small.  Templates merge like sums do: each task merges its pages', a salted round
merges tasks', and one more merges hosts', each as a stream that holds one host.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.htmltree import Element, blocks, parse
from plumbline.llm.scratch import Scratch, column, without
from plumbline.llm.url_filter import url_parts

_REPEATED = frozenset(("p", "li", "tr", "dt", "dd", "option", "br", "hr"))
_CONTAINERS = frozenset(("html", "body", "div", "section", "article", "main", "center", "td", "tr", "tbody", "table", "details", "fieldset"))
_SKETCH = 32
_SAME_KEY = 8
_FEW = 8


class Node:
    """A node of a template: sums over the pages that have it, and a sketch of its different texts.

    ``sketch`` holds the least 32 hashes of the texts seen.  ``members`` are the
    elements of the one page that the node was made of.
    """

    __slots__ = ("key", "tag", "dropped", "kept", "pages", "chars", "links", "sketch", "children", "members", "constant", "size")

    def __init__(self, key: str, tag: str, dropped: bool, kept: int, pages: int, chars: int, links: int, sketch: list[int], children: list[Node], members: list[Element] | None = None):
        self.key, self.tag, self.dropped, self.kept = key, tag, dropped, kept
        self.pages, self.chars, self.links, self.sketch, self.children = pages, chars, links, sketch, children
        self.members, self.constant = members or [], False
        self.size = 1 + sum(c.size for c in children)

    def plain(self) -> list:
        return [self.key, self.tag, int(self.dropped), self.kept, self.pages, self.chars, self.links, self.sketch, [c.plain() for c in self.children]]

    @classmethod
    def of(cls, x: list) -> Node:
        return cls(x[0], x[1], bool(x[2]), *x[3:8], [cls.of(c) for c in x[8]])

    def distinct(self) -> float:
        """How many different texts the node had, about."""
        if len(self.sketch) < _SKETCH:
            return len(self.sketch)
        return (_SKETCH - 1) * 2.0**64 / max(self.sketch[-1], 1)


def _merged_sketch(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:_SKETCH]


def matching(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of siblings: the pairs of the heaviest matching that doesn't cross.

    Nodes pair if their keys are equal; a pair weighs as many nodes as pair below
    it and itself, and a little more if both had the same text.
    """
    keys = [x.key for x in a]
    if keys == [x.key for x in b] and len(set(keys)) == len(keys):
        return [(i, i) for i in range(len(a))]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    weight = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            w = 0.0
            if x.key == y.key:
                w = weight[i, j] = 1 + _weight(x.children, y.children) + (0.5 if not set(x.sketch).isdisjoint(y.sketch) else 0)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _weight(a: list[Node], b: list[Node]) -> float:
    return sum(1 + _weight(a[i].children, b[j].children) for i, j in matching(a, b)) if a and b else 0.0


def _fewer(nodes: list[Node]) -> list[Node]:
    """Siblings of a key that comes more than 8 times are one node, so that templates stay small."""
    counts: dict[str, int] = {}
    for x in nodes:
        counts[x.key] = counts.get(x.key, 0) + 1
    if max(counts.values(), default=0) <= _SAME_KEY:
        return nodes
    out, first = [], {}
    for x in nodes:
        if counts[x.key] <= _SAME_KEY:
            out.append(x)
        elif x.key in first:
            together(first[x.key], x, same_page=True)
        else:
            first[x.key] = x
            out.append(x)
    return out


def together(a: Node, b: Node, same_page: bool = False) -> None:
    """Lay ``b`` over ``a``, which takes it in.  Siblings of one page add no page."""
    a.chars, a.links, a.sketch = a.chars + b.chars, a.links + b.links, _merged_sketch(a.sketch, b.sketch)
    a.pages, a.kept = (max(a.pages, b.pages) if same_page else a.pages + b.pages), max(a.kept, b.kept)
    a.members += b.members
    a.children = overlaid(a.children, b.children, same_page)
    a.size = 1 + sum(c.size for c in a.children)


def overlaid(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    """Two lists of siblings as one: pairs are merged, others keep their place."""
    out, i, j = [], 0, 0
    for x, y in [*matching(a, b), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            together(a[x], b[y], same_page)
            out.append(a[x])
        i, j = x + 1, y + 1
    return _fewer(out)


def _alike(a: Element, b: Element) -> bool:
    if a.key != b.key:
        return False
    x, y = {c.key for c in a.children()}, {c.key for c in b.children()}
    return 2 * len(x & y) >= len(x | y)


def siblings(elements: list[Element]) -> list[Node]:
    """Nodes of sibling elements; runs of like ones are one node."""
    runs: list[list[Element]] = []
    for x in elements:
        if x.dropped:
            continue
        if runs and _alike(runs[-1][-1], x):
            runs[-1].append(x)
        else:
            runs.append([x])
    out = []
    for run in runs:
        if len(run) >= 3 or run[0].tag in _REPEATED:
            out.append(node_of(run))
        else:
            out += [node_of([x]) for x in run]
    return _fewer(out)


def node_of(run: list[Element]) -> Node:
    """One node for a run of like elements of a page."""
    first, digest = run[0], 0
    for x in run:
        digest = (digest * 0x9E3779B97F4A7C15 + x.digest) & 0xFFFFFFFFFFFFFFFF
    children = siblings(first.children())
    for x in run[1:]:
        if more := siblings(x.children()):
            children = overlaid(children, more, same_page=True)
    return Node(first.key, first.tag, first.dropped, first.kept, 1, sum(x.chars for x in run), sum(x.links for x in run), [digest], children, list(run))


def _mass(node: Node) -> float:
    """Characters outside links of what varies below a node."""
    if node.constant:
        return 0.0
    own = node.chars - sum(c.chars for c in node.children)
    own_links = node.links - sum(c.links for c in node.children)
    return max(0, own - max(own_links, 0)) + sum(map(_mass, node.children))


def settle(root: Node) -> Node | None:
    """Mark what is template and return the article's slot, or None if there is no text.

    On a template of 8 pages or more, a node of 8 or more is template if its texts
    vary at most a tenth as much as whole pages do (a text over and over is also
    template), or if it is a list of links on most pages.  The slot is the deepest article element that holds half of the
    text that varies, else the deepest by its class, else the deepest container
    that holds seven tenths of it.
    """
    nodes, stack = [], [root]
    while stack:
        nodes.append(stack.pop())
        stack += nodes[-1].children
    most = root.distinct()
    for x in nodes:
        few = most >= _FEW and x.pages >= _FEW and x.distinct() <= max(1.0, 0.1 * x.pages * most / root.pages)
        links = root.pages >= _FEW and x.pages >= 0.8 * root.pages and x.tag not in ("p", "body") and x.links > 0.9 * x.chars
        x.constant = x is not root and (few or links)
    total = _mass(root)
    if not total:
        return None
    found = {0: root, 1: None, 2: None}

    def down(node: Node) -> None:
        mass = _mass(node)
        if node.constant or mass < 0.5 * total:
            return
        if node.kept and (node.kept == 2 or node.tag in _CONTAINERS):
            found[node.kept] = node
        if node.tag in _CONTAINERS and mass >= 0.7 * total:
            found[0] = node
        for child in node.children:
            down(child)

    down(root)
    return found[2] or found[1] or found[0]


def page_tree(html: str | None) -> tuple[Element, Node]:
    element = parse(html)
    return element, node_of([element])


def wrapper_of(root: Node) -> str:
    """A settled template as text: keys, and by each node whether it is the slot or template."""
    slot = settle(root)

    def plain(x: Node) -> list:
        return [x.key, x.sketch[:4], 2 if x is slot else int(x.constant), [plain(c) for c in x.children]]

    return json.dumps([root.pages, plain(root)], separators=(",", ":"))


@lru_cache(maxsize=512)
def _read(wrapper: str) -> Node:
    def node(x: list) -> Node:
        out = Node(x[0], "", False, x[2], 0, 0, 0, x[1], [node(c) for c in x[3]])
        out.constant = x[2] == 1
        return out

    return node(json.loads(wrapper)[1])


def article(html: str | None, wrapper: str | None) -> str:
    """The page's text by its host's wrapper; a page without its slot is settled by itself."""
    element, page = page_tree(html)
    slots: list[Element] = []
    left_out: set[int] = set()

    def lay(template: Node, node: Node) -> None:
        if template.constant:
            left_out.update(map(id, node.members))
        if template.kept == 2:
            slots.extend(node.members)
        for i, j in matching(template.children, node.children):
            lay(template.children[i], node.children[j])

    if wrapper:
        lay(_read(wrapper), page)
    if not any(x.chars for x in slots):
        own = settle(page)
        slots, left_out = own.members if own else [], set()
    return "\n".join(line for x in slots for line in blocks(x, left_out))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the templates of rows ``(host, salt, tree)`` that follow each other with the same host and salt."""
    last, tree = None, None
    for batch in batches:
        hosts, salts, trees = [], [], []
        for host, salt, text in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "tree"))):
            node = Node.of(json.loads(text))
            if (host, salt) == last:
                together(tree, node)
                continue
            if last:
                hosts.append(last[0])
                salts.append(last[1])
                trees.append(json.dumps(tree.plain()))
            last, tree = (host, salt), node
        if hosts:
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(salts, pa.int32()), pa.array(trees)], ["host", "salt", "tree"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([json.dumps(tree.plain())])], ["host", "salt", "tree"])


_TREE = "host string, salt int, tree string"


def induce(pages: DataFrame, salts: int = 32) -> DataFrame:
    """``(host, pages, wrapper)``: the template of all pages ``(host, html)`` of each host.

    ``salts`` is the number of parts in which a host's templates are merged first.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Node] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                _, node = page_tree(html.as_py())
                if host in found:
                    together(found[host], node)
                else:
                    found[host] = node
                _forget(found[host])
            trees = pa.array([json.dumps(x.plain()) for x in found.values()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), trees], ["host", "tree"])

    trees = pages.select("host", "html").mapInArrow(learn, "host string, tree string").withColumn("salt", F.pmod(F.xxhash64("tree"), F.lit(salts)).cast("int")).select("host", "salt", "tree")
    parts = trees.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_streamed, _TREE)
    whole = parts.select("host", F.lit(0).alias("salt"), "tree").repartition("host").sortWithinPartitions("host").mapInArrow(_streamed, _TREE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Node.of(json.loads(x)) for x in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([x.pages for x in found], pa.int64()), pa.array([wrapper_of(x) for x in found], pa.string())], ["host", "pages", "wrapper"])

    return whole.mapInArrow(finish, "host string, pages long, wrapper string")


def _forget(node: Node) -> None:
    """Let go of the page's elements, once it is merged."""
    node.members = []
    for child in node.children:
        _forget(child)


def extract(pages: DataFrame, salts: int = 32) -> DataFrame:
    """Add ``text``, the main text of each page, and ``n_chars``, its code points; they replace columns of those names.

    Pages of a host (A-Z of it lower-cased; none for a URL without ``://``) are
    laid over the template of all of them.  Null and empty ``html`` have an empty
    text.  A host of one page is judged by that page.  Very long pages are read
    whole.  Repeated rows are pages each, and have equal texts.  An empty table
    gives no rows.  Other columns are kept.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    wrappers = scratch.put(induce(pages.select(url_parts(F.col("url"))[0].alias("host"), "html"), salts), "wrappers")
    kept = without(pages.columns, ("text", "n_chars"))
    carried = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)])
    rows = pages.select(carried.alias("row"), url_parts(F.col("url"))[0].alias("host"), "html").join(wrappers.select("host", "wrapper"), "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(html.as_py(), wrapper) for html, wrapper in zip(batch.column("html"), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    found = rows.select("row", "html", "wrapper").mapInArrow(work, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    back = [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)]
    return found.select(*back, "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
