"""HTML extraction (11): the main text of a page by tree scoring.

The markup is read into a tree of its block elements; raw-text elements, comments and everything before the body go at
once. Each paragraph then passes points to its ancestors, for its length and its commas, discounted by its share of link
text: whole to its parent, half to the grandparent, a third of that and so on further up. The container with most points is
the article's; it and its siblings within the same ``article`` or ``main`` element are kept, and elsewhere the siblings
that score a fifth of it, with the headings right before it. Menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are cut from the tree before, by element, role or a word of their class or id, wherever they are;
an element that holds the page's article isn't cut for what it is called.

Text is what is left, blocks in page order. Character references are decoded; white space inside a block, line breaks
included, becomes one space; blocks are trimmed and joined by one space.

Pages are independent rows: no shuffle, and memory is bounded by the longest page. Reading is linear in the page's length.

Defined cases: null and empty pages, and pages without text outside what is cut, give the empty text; unclosed and misnested
elements are closed by the next block or their ancestor's end; an unclosed script or comment takes the rest of the page;
incomplete character references stay as they are; repeated rows get the same answer each; other columns, whatever their
names, come back unchanged unless they are named like a result, which is an error; an empty table gives no row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the public HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open one of the named kinds, as far as the nearest element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: Elements that are no article text, whatever they hold.
NEVER = frozenset("applet audio button canvas datalist head input map math noscript object script select style svg template textarea title video".split())
#: Parts of a page beside the article, by element, role and word of a class or id.
PARTS = frozenset("aside dialog footer form header menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
REPLIES = frozenset("comment comments commentlist disqus replies respond".split())
#: Parts of one class word that tell where an element stands rather than what it is.
BESIDE = frozenset("free has no with without".split())

TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NOT_WORD = re.compile(r"[^a-z0-9]+")


class Node:
    """An element of the tree: children are nodes and (text, in a link) pairs."""

    __slots__ = ("tag", "mark", "parent", "children", "points", "holds")

    def __init__(self, tag: str, mark: str | None, parent: Node | None) -> None:
        self.tag, self.mark, self.parent = tag, mark, parent
        self.children: list = []
        self.points, self.holds = 0.0, False


def class_words(value: str) -> Iterator[frozenset[str]]:
    """The words of each name in a class or id."""
    for name in value.split():
        yield frozenset(NOT_WORD.split(CAMEL.sub("-", name).lower()))


def mark_of(tag: str, attributes: str) -> str | None:
    """Why an element may be cut: ``never``, ``reply`` or ``part``."""
    if tag in NEVER:
        return "never"
    mark = "part" if tag in PARTS else None
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "role" and value.strip().lower() in ROLES:
                mark = "part"
            elif name in ("class", "id"):
                for words in class_words(value):
                    if words & REPLIES and not words & BESIDE:
                        return "reply"
                    if words & WORDS and not words & BESIDE:
                        mark = "part"
    return mark


def tree(page: str) -> Node:
    """The page's block elements; inline ones count only as links or where they may be cut."""
    root = node = Node("html", None, None)
    open_at: dict[str, list[Node]] = {}
    depth: dict[int, int] = {id(root): 0}
    links = at = 0

    def close(target: Node) -> Node:
        current = node
        while True:
            open_at[current.tag].pop()
            depth.pop(id(current))
            parent = current.parent
            if current is target:
                return parent
            current = parent

    def nearest(names: set[str]) -> Node | None:
        best = None
        for name in names:
            if (held := open_at.get(name)) and (best is None or depth[id(held[-1])] > depth[id(best)]):
                best = held[-1]
        return best

    while at < len(page):
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            node.children.append((text, links > 0))
        if not found:
            break
        at = found.end()
        slash, tag, attributes = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "p" and not open_at.get("p"):
                node.children.append(Node("br", None, node))
            elif (held := open_at.get(tag)) and tag not in ("html", "body"):
                edge = None if block else nearest(BLOCKS & open_at.keys())
                if edge is None or depth[id(held[-1])] > depth[id(edge)]:
                    node = close(held[-1])
                    links = 0 if block else links
            elif tag == "body":
                links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("html", "body"):
            if tag == "body" and open_at.get("head"):
                node = close(open_at["head"][-1])
            continue
        if open_at.get("head") and tag not in HEAD:
            node = close(open_at["head"][-1])
        if tag == "br" or tag == "hr":
            node.children.append(Node(tag, None, node))
            if tag == "br":
                continue
        if tag == "a":
            links = 1
            continue
        mark = mark_of(tag, attributes)
        if tag in VOID or (not block and not mark):
            continue
        if block:
            if open_at.get("p") and (tag != "table"):
                target, barrier = open_at["p"][-1], nearest({"button", "td", "th", "caption", "object"} & open_at.keys())
                if barrier is None or depth[id(target)] > depth[id(barrier)]:
                    node = close(target)
            if tag in ENDS:
                inner, outer = ENDS[tag]
                while (target := nearest(inner)) is not None and ((edge := nearest(outer)) is None or depth[id(target)] > depth[id(edge)]):
                    node = close(target)
            if tag in HEADINGS and node.tag in HEADINGS:
                node = close(node)
            links = 0
        child = Node(tag, mark, node)
        node.children.append(child)
        if attributes.endswith("/") and not block:
            continue
        open_at.setdefault(tag, []).append(child)
        depth[id(child)] = depth[id(node)] + 1
        node = child
    return root


def walk(root: Node) -> list[Node]:
    """The nodes below ``root`` and itself, parents before children, in page order."""
    out, ahead = [], [root]
    while ahead:
        node = ahead.pop()
        out.append(node)
        ahead.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def prune(root: Node) -> list[Node]:
    """Cuts the parts beside the article; gives the nodes that are left, parents first."""
    order = walk(root)
    cut: set[int] = set()
    for node in order:  # what stands in a part that is cut for certain can't hold it back
        if id(node.parent) in cut or node.mark in ("never", "reply"):
            cut.add(id(node))
    for node in reversed(order):
        if id(node) not in cut and (node.holds or (node.tag in ("article", "main") and node.mark is None)) and node.parent is not None:
            node.parent.holds = True
    for node in order:
        if id(node.parent) in cut or (node.mark == "part" and not node.holds):
            cut.add(id(node))
    if any(node.tag == "form" and id(node) in cut for node in order):
        spare_form(order, cut)
    left = [node for node in order if id(node) not in cut]
    for node in left:
        if any(isinstance(c, Node) and id(c) in cut for c in node.children):
            node.children = [Node("br", None, node) if isinstance(c, Node) and id(c) in cut and c.tag in BLOCKS else c for c in node.children if not (isinstance(c, Node) and id(c) in cut and c.tag not in BLOCKS)]
    return left


def spare_form(order: list[Node], cut: set[int]) -> None:
    """Keeps a form that wraps the page: one that holds more paragraphs than stand outside of it."""
    paragraphs = [n for n in order if n.tag == "p"]
    for form in [n for n in order if n.tag == "form" and id(n) in cut and id(n.parent) not in cut]:
        inside = {id(n) for n in walk(form)}
        if 2 * sum(id(p) in inside for p in paragraphs) > len(paragraphs) > 0:
            cut -= inside
            for n in walk(form):
                if n is not form and (id(n.parent) in cut or n.mark is not None and not n.holds):
                    cut.add(id(n))


def score(left: list[Node]) -> None:
    """Points of every container, from the paragraphs below it."""
    for node in left:
        own = [c for c in node.children if not isinstance(c, Node)]
        if not own:
            continue
        size = linked = commas = 0
        for text, in_link in own:
            n = len(text.strip())
            size += n
            linked += n if in_link else 0
            commas += text.count(",") + text.count("、") + text.count("，")
        if not size:
            continue
        points = (1 + commas + size / 100) * (1 - linked / size)
        share, up = 1.0, node.parent if node.tag not in ("div", "section", "article", "main", "td", "body", "html") else node
        while up is not None and share > 1e-4:
            up.points += points * share
            share /= 2 if share == 1 else 3
            up = up.parent


def link_share(node: Node) -> float:
    size = linked = 0
    for n in walk(node):
        for c in n.children:
            if not isinstance(c, Node):
                k = len(c[0].strip())
                size += k
                linked += k if c[1] else 0
    return linked / size if size else 0.0


def kept_nodes(left: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    best = max(left, key=lambda n: n.points)
    up, frame = best, None
    while up is not None:
        if up.tag in ("article", "main"):
            frame = up
            if up.tag == "article":
                break
        up = up.parent
    if frame is not None:
        best = frame
    if best.parent is None or best.tag == "main":
        return [best]
    row = [c for c in best.parent.children if isinstance(c, Node)]
    here = next(i for i, c in enumerate(row) if c is best)
    keep = {here}
    for i, c in enumerate(row):
        if best.points > 0 and c.points >= best.points / 5 and c.tag not in HEADINGS and (frame is None or c.tag == "article") and link_share(c) < 0.5:
            keep.add(i)
    if frame is None:
        i = here - 1
        while i >= 0 and (row[i].tag in HEADINGS or row[i].tag in ("br", "hr")):
            keep.add(i)
            i -= 1
    return [row[i] for i in sorted(keep)]


def rendered(node: Node, out: list[str]) -> None:
    """Appends the text below ``node``; blocks are set apart by line ends."""
    ahead: list = [node]
    while ahead:
        c = ahead.pop()
        if isinstance(c, Node):
            if c.tag in BLOCKS or c.tag == "br":
                out.append("\n")
                ahead.append("\n")
            ahead.extend(reversed(c.children))
        else:
            out.append(c if isinstance(c, str) else html.unescape(c[0]))


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    left = prune(tree(page))
    score(left)
    out: list[str] = []
    for node in kept_nodes(left):
        rendered(node, out)
        out.append("\n")
    return " ".join("".join(out).split())


def extract_main_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with their main text in place of the markup; the text's column is ``into``."""
    others = [c for c in pages.columns if c != column]
    if into.lower() in {c.lower() for c in others}:
        raise ValueError("the table has a column named like the text's")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = pa.array([main_text(page.as_py()) for page in batch.column(at)], pa.string())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], texts], [*[batch.schema.names[i] for i in rest], into])

    schema = T.StructType([*[pages.schema[c] for c in others], T.StructField(into, T.StringType())])
    return pages.select(*[F.col(f"`{c}`") for c in [*others, column]]).mapInArrow(extract, schema)


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
