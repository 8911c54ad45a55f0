"""Main text of web pages by wrapper induction.

Pages are parsed into trees of blocks. For every host, and for every layout of a host that has several (which elements stand in
which on the first levels), one page (the smallest key) is the reference, and simple tree
matching aligns each other page of the host or layout with it. A block of the reference that is aligned with the same words on
nearly all of them is constant, so it belongs to the host's template; what varies is a content slot. Extraction
leaves out the template's blocks, inside article elements too, and the elements that hold no article by their kind (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments; class names count only where something
else is left). What remains is the article: inside
article elements if the page has any, else inside main, else in the body. A block is its words and the names of the
elements around it, so the same words elsewhere in a page are no template. Pages of equal trees count as one, so copies of
a page don't make its text constant.

Only block counts and hashes move between machines; pages are parsed where they are read. A host with very many pages is
joined with its one reference row, which adaptive execution can split, and its counts are added up before they move.

Defined cases: null or empty html gives empty text; a host with fewer than LEAST_PAGES different pages, or without a URL, has no
template; a page whose blocks are all constant keeps them; a page cut off anywhere is read as far as it goes; ties for the
reference go to the smallest html; repeated rows get the same text; only key, URL and html are read, so other columns cannot
clash; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.llm.common import cut, slices
from entwine.llm.url_filter import host_of

#: A template needs so many pages of a host, and its blocks the same words on this share of them.
LEAST_PAGES, CONSTANT_SHARE = 3, 0.8
#: Template blocks that are sent to every task; beyond that the pages meet their template by a join.
MOST_SENT = 200_000
#: Elements nested deeper stand beside those at this depth in the tree, as in browsers; no text is lost. Tables of children with more cells are worked out in halves.
DEEPEST, MOST_CELLS = 512, 250_000
#: Levels of a tree that make a page's layout.
LAYOUT_LEVELS = 4
#: Weight of a pair of nodes in an alignment; a pair of equal words adds 1.
PAIR = 1 << 31
#: Element names by HTML's own rules, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_ARTICLE = frozenset("head nav header footer aside form button select option input dialog menu script style noscript template textarea title iframe svg canvas object".split())
#: Words of class, id or role that mark the same parts, fixed values.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus share sharing social related"
    " newsletter subscribe masthead header footer complementary contentinfo search".split()
)
#: An open element of the key ends when one of these begins.
ENDS = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr".split()), "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"])}
PIECE = re.compile(rf"<!--.*?(?:-->|$)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"</?([a-z][^\s/>]*)", re.I)
WORD = re.compile(r"[a-z0-9]+")
#: A name that begins so says what stands beside, as in "with-sidebar".
BESIDE = frozenset("with without has no not non".split())
#: Where a tag that is cut off by the page's end begins.
CUT_OFF = re.compile(r"<[a-z/!?]", re.I)


@dataclass
class Node:
    """An element, or a block of words (name '#')."""

    name: str
    words: str = ""
    dropped: bool = False
    marked: bool = False
    inside: str = ""
    place: int = 0
    nodes: list = field(default_factory=list)


def marked(tag: str) -> bool:
    """Whether class, id or role name a part that is no article."""
    if "=" not in tag:
        return False
    names = (WORD.findall(name) for a, b, c in ATTRIBUTE.findall(tag) for name in (a or b or c).lower().split())
    return any(words and words[0] not in BESIDE and not MARKS.isdisjoint(words) for words in names)


def parse(page: str) -> Node:
    """The page's tree. White space inside a block is one space; inline elements make no block of their own."""
    root = Node("root")
    stack, text, at = [root], [], 0

    def flush():
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            top = stack[-1]
            top.nodes.append(Node("#", words, top.dropped, top.marked, top.inside, top.place))

    for m in PIECE.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at, tag = m.end(), m.group()
        found = NAME.match(tag)
        if not found or m.group(1):
            continue
        name = found.group(1).lower()
        if name in INLINE and not (tag[1] != "/" and marked(tag)) and not (tag[1] == "/" and any(n.name == name for n in stack)):
            continue
        flush()
        if tag[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        while len(stack) > 1 and name in ENDS.get(stack[-1].name, ()):
            stack.pop()
        top = stack[-1]
        if name in VOID:
            continue
        parent = stack[min(len(stack), DEEPEST) - 1]
        inside = name if name in ("article", "main") and top.inside != "article" else top.inside
        node = Node(name, "", top.dropped or name in NO_ARTICLE, top.marked or (name not in ("html", "body", "article", "main") and marked(tag)), inside, xxhash.xxh64_intdigest(name, parent.place))
        parent.nodes.append(node)
        stack.append(node)
    cut_off = CUT_OFF.search(page, at)
    text.append(page[at : cut_off.start()] if cut_off else page[at:])
    flush()
    return root


class Matching:
    """Simple tree matching of two trees. Subtrees of one structure and with the same words have one class, so each pair of classes is matched once; words that only one of the trees has cannot be equal to others and are blank."""

    def __init__(self, one: Node, other: Node):
        self.ids: dict[tuple, int] = {}
        self.names: list[str] = []
        self.children: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.words: list[frozenset] = []
        self.blank: list[int] = []
        self.known: dict[tuple[int, int], int] = {}
        self.of: dict[int, int] = {}
        self.both = words_of(one) & words_of(other)
        self.classify(one)
        self.classify(other)

    def class_of(self, name: str, children: tuple, words) -> int:
        found = self.ids.get((name, children, words))
        if found is None:
            blank = None if words is None and all(self.blank[c] == c for c in children) else self.class_of(name, tuple([self.blank[c] for c in children]), None)
            found = self.ids[name, children, words] = len(self.names)
            self.names.append(name)
            self.children.append(np.array(children, np.int64))
            self.sizes.append(PAIR + (words is not None) + sum([self.sizes[c] for c in children]))
            self.words.append(frozenset().union(*(self.words[c] for c in set(children))) if words is None else frozenset([words]))
            self.blank.append(found if blank is None else blank)
        return found

    def classify(self, node: Node) -> int:
        words = node.words if node.name == "#" and node.words in self.both else None
        found = self.of[id(node)] = self.class_of(node.name, tuple([self.classify(n) for n in node.nodes]), words)
        return found

    def weight(self, a: int, b: int) -> int:
        """The most that a matching of two subtrees can have: PAIR for each pair of nodes, and 1 for each pair of blocks with the same words."""
        if a != b and self.words[a].isdisjoint(self.words[b]):
            a, b = self.blank[a], self.blank[b]
        if a == b:
            return self.sizes[a]
        if self.names[a] != self.names[b]:
            return 0
        found = self.known.get((a, b))
        if found is None:
            one, other = self.children[a], self.children[b]
            begin, end = same_ends(one, other)
            ends = sum(self.sizes[c] for c in [*one[:begin], *one[len(one) - end :]])
            one, other = one[begin : len(one) - end], other[begin : len(other) - end]
            found = self.known[a, b] = PAIR + ends + (int(last_row(self.rows(one, other))[-1]) if len(one) and len(other) else 0)
        return found

    def rows(self, one: np.ndarray, other: np.ndarray) -> Iterator[np.ndarray]:
        """For each of one list the weights with all of the other. Only classes that share words are looked at one by one."""
        blanks, to = np.unique([self.blank[c] for c in other.tolist()], return_inverse=True)
        places: dict = {}
        for q, c in enumerate(other.tolist()):
            for w in self.words[c]:
                places.setdefault(w, []).append(q)
        plain: dict[int, np.ndarray] = {}
        for a in one.tolist():
            blank = self.blank[a]
            if blank not in plain:
                plain[blank] = np.array([self.weight(blank, b) for b in blanks.tolist()], np.int64)
            row = plain[blank][to]
            for q in {q for w in self.words[a] for q in places.get(w, ())}:
                row[q] = self.weight(a, int(other[q]))
            yield row

    def pairs(self, one: Node, other: Node) -> Iterator[tuple[Node, Node]]:
        todo = [(one, other)]
        while todo:
            one, other = todo.pop()
            yield one, other
            a, b = (np.array([self.of[id(n)] for n in x.nodes], np.int64) for x in (one, other))
            begin, end = same_ends(a, b)
            todo += zip(one.nodes[:begin], other.nodes[:begin])
            todo += zip(one.nodes[len(a) - end :], other.nodes[len(b) - end :])
            a, b = a[begin : len(a) - end], b[begin : len(b) - end]
            if len(a) and len(b):
                todo += [(one.nodes[begin + i], other.nodes[begin + j]) for i, j in self.chosen(a, b)]

    def chosen(self, one: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of places with the most weight, in order. Tables of more than MOST_CELLS cells are halved (Hirschberg), so space is linear and the result as exact."""
        out, todo = [], [(0, len(one), 0, len(other))]
        while todo:
            i, j, k, m = todo.pop()
            if i == j or k == m:
                continue
            a, b = one[i:j], other[k:m]
            if len(a) * len(b) > MOST_CELLS and len(a) > 1:
                half = len(a) // 2
                split = k + int((last_row(self.rows(a[:half], b)) + last_row(self.rows(a[half:][::-1], b[::-1]))[::-1]).argmax())
                todo += [(i, i + half, k, split), (i + half, j, split, m)]
                continue
            table = [[0] * (len(b) + 1)]
            for row in sums(self.rows(a, b)):
                table.append(row.tolist())
            p, q = len(a), len(b)
            while p and q:
                if table[p][q] == table[p - 1][q]:
                    p -= 1
                elif table[p][q] == table[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    out.append((i + p, k + q))
        return sorted(out)


def words_of(node: Node) -> set:
    """The words of all blocks of a tree."""
    out, todo = set(), [node]
    while todo:
        node = todo.pop()
        todo += node.nodes
        if node.name == "#":
            out.add(node.words)
    return out


def same_ends(one: np.ndarray, other: np.ndarray) -> tuple[int, int]:
    """Lengths of the beginning and of the end that two lists share. Equal subtrees at an end are paired in some best matching."""
    n = min(len(one), len(other))
    differ = one[:n] != other[:n]
    begin = int(differ.argmax()) if differ.any() else n
    n -= begin
    differ = one[len(one) - n :][::-1] != other[len(other) - n :][::-1]
    return begin, int(differ.argmax()) if differ.any() else n


def sums(rows: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Most weight of every beginning of one list with every beginning of the other, a row for each of the first."""
    row = None
    for own in rows:
        if row is None:
            row = np.zeros(len(own) + 1, np.int64)
        new = np.zeros_like(row)
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + own))
        row = new
        yield row


def last_row(rows: Iterator[np.ndarray]) -> np.ndarray:
    """The last of the sums."""
    for row in sums(rows):  # noqa: B007
        pass
    return row


def aligned(one: Node, other: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes by simple tree matching: roots of the same name match, their children in order, for the largest number of pairs, and among those for the most blocks with the same words."""
    return list(Matching(one, other).pairs(one, other)) if one.name == other.name else []


def block_of(node: Node) -> int:
    """Hash of a block: its words and the names of the elements around it."""
    return xxhash.xxh64_intdigest(node.words, node.place) >> 1


def skeleton(node: Node) -> list:
    """A tree of names with hashes in place of words; blocks inside dropped elements are left out."""
    if node.name == "#":
        return ["#", block_of(node)]
    return [node.name, *(skeleton(n) for n in node.nodes if not n.dropped and not n.marked)]


def from_skeleton(value: list) -> Node:
    """The tree of a skeleton."""
    return Node("#", value[1]) if value[0] == "#" else Node(value[0], nodes=[from_skeleton(v) for v in value[1:]])


def layout_of(value: list) -> int:
    """Hash of a skeleton's layout: which elements stand in which, on the first levels."""
    found, todo = set(), [(value, ())]
    while todo:
        node, above = todo.pop()
        here = (*above, node[0])
        found.add("/".join(here))
        if len(here) < LAYOUT_LEVELS:
            todo += [(n, here) for n in node[1:] if n[0] != "#"]
    return xxhash.xxh64_intdigest("\n".join(sorted(found))) >> 1


def skeletons(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, host, skeleton (JSON) and layout of every page with a host."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for batch in slices(batches, "html"):
            found = [skeleton(parse(h)) for h in batch.column("html").to_pylist()]
            trees = pa.array([json.dumps(f, separators=(",", ":")) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), trees, pa.array([layout_of(f) for f in found], pa.int64())], names=["key", "host", "tree", "layout"])

    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> '' and html is not null")
    return rows.mapInArrow(run, T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("host", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("layout", T.LongType())]))


def deep() -> None:
    """Let trees of DEEPEST levels be walked: some calls a level."""
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))


def templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_PAGES, share: float = CONSTANT_SHARE) -> DataFrame:
    """host and block (see block_of): the blocks that are constant over the host's different pages, or over those of one of its layouts."""
    import json

    trees = cut(skeletons(pages, key, url, html).groupBy("host", "layout", "tree").agg(F.min("key").alias("key")), "skeletons")
    several = trees.groupBy("host").agg(F.min("layout").alias("one"), F.max("layout").alias("other")).where("one <> other").select("host")
    whole = F.lit(-1).cast("long").alias("layout")
    trees = trees.select("host", whole, "tree", "key").union(trees.join(several, "host", "left_semi").select("host", "layout", "tree", "key"))
    references = cut(trees.groupBy("host", "layout").agg(F.min(F.struct("key", "tree")).alias("r"), F.count("*").alias("n")).where(F.col("n") >= least).select("host", "layout", "n", F.col("r.tree").alias("reference")), "references")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for batch in batches:
            hosts, layouts, blocks = [], [], []
            for host, layout, tree, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "tree", "reference"))):
                one = json.loads(reference)
                pairs = aligned(from_skeleton(one), from_skeleton(one if tree == reference else json.loads(tree)))
                same = {a.words for a, b in pairs if a.name == "#" and a.words == b.words}
                hosts += [host] * len(same)
                layouts += [layout] * len(same)
                blocks += same
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(blocks, pa.int64())], names=["host", "layout", "block"])

    same = trees.join(references.drop("n"), ["host", "layout"]).select("host", "layout", "tree", "reference").mapInArrow(run, "host string, layout long, block long")
    counts = same.groupBy("host", "layout", "block").agg(F.count("*").alias("same"))
    return counts.join(references.select("host", "layout", "n"), ["host", "layout"]).where(F.col("same") >= F.col("n") * share).select("host", "block").distinct()


def main_text(page: str, template: frozenset | set = frozenset()) -> str:
    """The article of one page."""
    found: list[Node] = []

    def walk(node: Node):
        for n in node.nodes:
            if n.name == "#":
                if not n.dropped:
                    found.append(n)
            elif not n.dropped:
                walk(n)

    walk(parse(page))
    # marks decide only where something else is left
    found = [n for n in found if not n.marked] or found
    for part in ("article", "main", ""):
        blocks = [n for n in found if n.inside == part] if part else found
        if blocks:
            break
    if template:
        blocks = [n for n in blocks if block_of(n) not in template] or blocks
    return " ".join(n.words for n in blocks)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and text of every row of pages."""
    found = cut(templates(pages, key, url, html), "templates")
    sent = found.limit(MOST_SENT + 1).count() <= MOST_SENT
    by_host: dict[str, set] = {}
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    if sent:
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["block"])
    else:
        rows = rows.join(found.groupBy("host").agg(F.collect_set("block").alias("blocks")), "host", "left")
    shared = pages.sparkSession.sparkContext.broadcast(by_host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        of = shared.value
        for batch in slices(batches, "html"):
            own = [of.get(h, ()) for h in batch.column("host").to_pylist()] if sent else [set(b or ()) for b in batch.column("blocks").to_pylist()]
            texts = [main_text(h, t) if h else "" for h, t in zip(batch.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], names=[key, "url", "text"])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))
