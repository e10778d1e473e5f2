"""Main text of web pages, with the templates of their sites removed.

A page becomes a tree.  Site templates are found by counting: every subtree that may be one is hashed, on the whole
page as it came, (host, hash, article) triples are made distinct in Spark and their articles counted, and subtrees that
stand on ``MIN_PAGES`` pages of different articles of their host are deleted.  The bar is a number of pages, whatever
the size of the host.  An article that many addresses share counts once, so it is a copy and no template.

Any block outside an article may be a template; inside one, only containers (a box of a div, a list, a form) may.
Headings, paragraphs and the like that stand in an article are its content, however many articles repeat them: near
copies of a text do.  On a page without article or main element all of the body counts as inside, and no
subtree with more than half of its words may be a template.

Then what is no article by its element, role or class (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments of readers) is cut: sites with few pages have no counts.  Where the page has an article or
main element, that is the article; else what is left of the body.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do (open
elements end with their parent, unknown entities stay, a tag that never ends hides what follows); a url without a host
forms the host ""; rows that repeat count once in templates and each get their text; very long pages are whole, and
parsing takes time in proportion to them whatever they leave open; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Pages of different articles of a host on which a template stands at least.
MIN_PAGES = 8
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe object embed svg canvas audio video button select option textarea input label fieldset dialog menu map xmp noembed noframes title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class names and ids that mark parts which are no article.
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social footer header masthead comment comments disqus replies respondents newsletter subscribe subscription signup login search pagination pager toolbar skip copyright legal disclaimer".split())
#: Words that say where or what shape such a part is; a name with any other word is not judged.
QUALIFIERS = frozenset("site page global top bottom left right primary secondary sticky fixed mobile inner outer box block bar area zone slot unit strip wrapper wrap container list links items buttons icons".split())
#: Elements whose names are judged: containers, never headings, paragraphs or what stands inside a line.
CONTAINERS = frozenset("div section ul ol dl table details article main".split())
#: Of the words, those that speak against an article element itself.
REMARKS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related teaser".split())
#: Elements that an opening tag of the first kind ends.
CLOSES_P = BLOCKS - frozenset("body html dd dt li td th tr tbody thead tfoot caption".split()) | frozenset(["p"])
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold an article's own text; inside an article they are never templates.
CONTENT = HEADINGS | frozenset("p li dt dd blockquote pre figure figcaption caption td th tr tbody thead tfoot hgroup address".split())
#: Where markup may begin; a tag's attributes, in which quotes count behind an equals sign only.
START = re.compile(r"<(?:!--|[!?]|/|[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
REST = re.compile(r"(?:[^>=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "digest", "shape", "words", "headed")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.digest, self.shape, self.words, self.headed = tag, attrs, [], 0, None, 0, False


#: Elements that an opening tag ends, up to walls: kind, what it ends, the walls.
ENDS = {
    "p": (frozenset(["p"]), frozenset("button td th li table".split())),
    **{tag: (frozenset(ended), frozenset("ul ol dl table select menu".split())) for tag, ended in SIBLINGS.items()},
}
#: Of each tag the kinds that look for it.
LOOKED_FOR = {tag: [kind for kind, (ended, walls) in ENDS.items() if tag in ended | walls] for tag in {t for ended, walls in ENDS.values() for t in ended | walls}}


class Stack:
    """Open elements, with the places of each tag and of what each kind looks for, so that no search walks over the others."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.marks: dict[str, list[int]] = {kind: [] for kind in ENDS}

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        for kind in LOOKED_FOR.get(node.tag, ()):
            self.marks[kind].append(at)

    def cut(self, at: int) -> None:
        """Close the elements from ``at`` on."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            for kind in LOOKED_FOR.get(tag, ()):
                self.marks[kind].pop()

    def end(self, tag: str) -> None:
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def end_kind(self, kind: str) -> None:
        """End the nearest open element of the kind, unless a wall stands before it."""
        marks = self.marks[kind]
        if marks and self.nodes[marks[-1]].tag in ENDS[kind][0]:
            self.cut(marks[-1])

    def head(self) -> None:
        """Note in all open elements that they hold a heading."""
        for node in reversed(self.nodes):
            if node.headed:
                break
            node.headed = True


def parse(source: str) -> Node:
    """A tree of elements and strings (entities decoded)."""
    root = Node("#root")
    stack, at, n = Stack(root), 0, len(source)
    said = 0  # where the text not yet taken begins
    while at < n:
        found = START.search(source, at)
        begin = found.start() if found else n
        kind = found[0] if found else ""
        name = NAME.match(source, begin + (kind == "</") + 1) if found else None
        if kind == "</" and not name and not source.startswith(">", begin + 2):
            kind = "<!"  # browsers take it for a comment
        if begin > said:
            stack.nodes[-1].children.append(html.unescape(source[said:begin]))
        if not found:
            break
        if kind == "<!--":
            end = re.compile("--!?>").search(source, begin + 4)
            at = said = end.end() if end else n
            continue
        if not name:
            end = source.find(">", begin)
            at = said = end + 1 if end >= 0 else n
            continue
        body = REST.match(source, name.end())
        at = said = body.end() + 1
        if body.end() >= n:  # the tag never ends
            break
        tag = name[0].lower()
        if kind == "</":
            stack.end(tag)
            continue
        if tag in CLOSES_P:
            stack.end_kind("p")
        if tag in HEADINGS:
            if stack.nodes[-1].tag in HEADINGS:
                stack.cut(len(stack.nodes) - 1)
            stack.head()
        if tag in SIBLINGS:
            stack.end_kind(tag)
        node = Node(tag, body[0])
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            node.children.append(source[at : close.start() if close else n])
            at = said = close.end() if close else n
        elif tag not in VOID and (tag in BLOCKS or not node.attrs.rstrip().endswith("/")):  # a solidus means nothing on block elements
            stack.push(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attrs)}


def named_boilerplate(names: list[str], marks: frozenset[str]) -> bool:
    """Whether a name consists of marking words and qualifiers alone: "cookie-notice" does, "related-work" doesn't."""
    for name in names:
        words = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())) - {""}
        if words & marks and words <= marks | QUALIFIERS:
            return True
    return False


def boilerplate(node: Node, inside: bool = False) -> bool:
    """Whether element, role or name says that this is no part of an article; ``inside``: within an article or main element.

    An article's own header, which holds its heading, stays; there, sections keep their ids, which are anchors.
    """
    if node.tag in DROPPED:
        return not (inside and node.tag == "header" and node.headed)
    if not node.attrs or node.tag in ("body", "html"):
        return False
    attrs = attributes(node)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if node.tag not in CONTAINERS:
        return False
    names = attrs.get("class", "").split() + ([] if inside and node.tag == "section" else attrs.get("id", "").split())
    return named_boilerplate(names, REMARKS if node.tag in ("article", "main") else DROPPED_WORDS)


def trim(root: Node) -> Node:
    """Delete boilerplate below a node."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not boilerplate(c, inside)]
        todo += [(c, inside) for c in node.children if not isinstance(c, str)]
    return root


def article_nodes(root: Node) -> list[Node]:
    """The outermost article elements of the page, else the main ones."""
    for tag in ("article", "main"):
        found: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if not isinstance(c, str)]
        if found:
            return found
    return []


def article(root: Node) -> Node:
    """The articles of the page, or its main element, or what is left of it."""
    if found := article_nodes(root):
        top = Node("#article")
        top.children = found
        return top
    return root


def measure(root: Node) -> Node:
    """Give every node its hash, by tags and text, its words, and its ``shape``, which is null without text."""
    import xxhash

    order, todo = [], [root]
    while todo:  # without recursion: pages may be nested deeply
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(order):
        digest, node.words = xxhash.xxh64(node.tag), 0
        for child in node.children:
            if isinstance(child, str):
                words = child.split()
                node.words += len(words)
                digest.update("\0" + " ".join(words))
            else:
                node.words += child.words
                digest.update((child.digest).to_bytes(8, "little"))
        node.digest = digest.intdigest()
        node.shape = node.digest - (1 << 63) if node.words else None
    return root


def may_be_template(root: Node) -> Iterator[tuple[Node, Node]]:
    """(parent, node) of the subtrees of a measured page that may be templates, outer ones first."""
    bare, todo = not article_nodes(root), [(root, False)]
    while todo:
        parent, inside = todo.pop()
        inside = inside or parent.tag in ("article", "main")
        for node in parent.children:
            if isinstance(node, str) or node.shape is None:
                continue
            if node.tag in BLOCKS and node.tag not in ("article", "main", "body", "html") and not ((inside or bare) and node.tag in CONTENT) and not (bare and 2 * node.words > root.words):
                yield parent, node
            todo.append((node, inside))


def templates_in(root: Node) -> set[int]:
    return {node.shape for _, node in may_be_template(measure(root))}


def without(root: Node, templates: set[int]) -> Node:
    """Delete the subtrees that are templates."""
    if templates:
        gone = {id(node) for _, node in may_be_template(measure(root)) if node.shape in templates}
        todo = [root] if gone else []
        while todo:
            node = todo.pop()
            node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
            todo += [c for c in node.children if not isinstance(c, str)]
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order, white space inside each turned into one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if said := SPACES.sub(" ", "".join(line)).strip():
            out.append(said)
        line.clear()

    todo: list = [node]
    while todo:  # without recursion: pages may be nested deeply
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        else:
            edge = item.tag in BLOCKS
            if edge:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return out


def extract(root: Node, templates: set[int]) -> str:
    return "\n".join(blocks(article(trim(without(root, templates)))))


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and ``key``, which pages of one host with equal html share."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    return pages.withColumn("key", F.xxhash64("host", "html"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(candidates, templates) of ``hosted`` pages: (key, spot, shape), and the (spot, articles) that reach the bar.

    ``spot`` is a host and a shape; ``articles`` how many different articles it stands beside.
    """
    import xxhash

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            articles, held = [], []
            for source in batch.column("html"):
                root = parse(source.as_py() or "")
                held.append(list(templates_in(root)))
                articles.append(xxhash.xxh64_intdigest("\n".join(blocks(article(trim(root))))) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(articles, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["host", "key", "article", "shapes"])

    found = written(pages.select("host", "key", "html").mapInArrow(shapes, "host string, key long, article long, shapes array<long>"), "shapes")
    spots = found.select("key", "article", F.explode("shapes").alias("shape"), "host").withColumn("spot", F.xxhash64("host", "shape"))
    # an article counts once a host and shape: distinct first, so that no shape's pages meet in one task
    counts = spots.select("spot", "article").distinct().groupBy("spot").agg(F.count("*").alias("articles")).where(F.col("articles") >= min_pages)
    return spots.select("key", "spot", "shape"), written(counts, "templates")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(pages.sparkSession)
    pages = hosted(pages)
    candidates, templates = site_templates(pages, min_pages)
    # a page gets its own templates only; pages that repeat share one list, which is no longer than a page
    mine = candidates.join(templates.select("spot"), "spot", "left_semi").groupBy("key").agg(F.collect_set("shape").alias("templates"))
    mine = written(mine, "lists")  # between two exchanges joins can be split where a page has very many copies

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(parse(source.as_py() or ""), set(shapes.as_py() or ())) for source, shapes in zip(batch.column("html"), batch.column("templates"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.join(mine, "key", "left").select("page_id", "url", "html", "templates").mapInArrow(pull, "page_id long, url string, text string, n_chars long")
