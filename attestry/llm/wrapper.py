"""Main text of web pages by wrapper induction."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from attestry.llm.common import map_text, stored

#: Pages of each shape that are aligned for the slots; the least distinct pages, and the share of them, that make a text template.
REFERENCES, ENOUGH, CONSTANT_SHARE = 8, 4, 0.8
#: Levels of a page that make its shape.
SHAPE_DEPTH = 4
#: Stands for all shapes of a host, and for a page as a whole among its leaves.
HOST = PAGE = 0
#: A table of wrappers is broadcast up to this size and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20
#: Trees are aligned down to this depth.
DEPTH = 60
#: Links at one place of a page that make a menu.
MENU = 3
#: What text inside article or main counts when the content path is looked for.
MARKED = 3

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - set("body head html legend li dd dt option optgroup td th tr tbody thead tfoot summary".split()) | {"li", "dd", "dt"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Elements that never hold main text.
DROPPED_TAGS = set("head script style noscript template textarea title iframe button select input svg object".split())
# Elements, roles and names that speak against main text; they only vote.
ASIDE_TAGS = set("nav aside footer form label menu dialog".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A whole class or id. Compounds vote only if every part speaks of a page's frame, or of a box around the named thing.
ASIDE_NAMES = re.compile(
    r"(?:(?:site|page|top|bottom|left|right|main|global|primary|secondary|post|entry|wp|js|user|reader|article)[_-])*"
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo(?:s|tions?)?|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"side-?bars?|nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|(?:site|page)?-?footer|comments?|replies|respond|disqus|social|"
    r"share|sharing|sharedaddy|related|recommended|newsletter|subscribe|signup|login|search|widgets?|skip-?link|copyright)"
    r"(?:[_-](?:area|bar|box|list|wrap|wrapper|container|section|block|inner|links?|buttons?|form|posts?|notice|text|slot|unit|zone|space|thread|[a-z]|\d+))*"
    r"|(?:(?:site|page|top|main|global)-?)?header", re.I)
#: What the text of a page is never in, however long it is; a form around all of a page is told by its main heading.
FIRM_NAMES = re.compile(
    r"(?:(?:user|reader|post|article|page|site)[_-])*(?:comments?|replies|respond|disqus|ads?|advert\w*|adsense|cookies?|consent|gdpr)"
    r"(?:[_-](?:area|bar|box|list|wrap|wrapper|container|section|block|inner|form|notice|text|slot|unit|zone|space|thread|[a-z]|\d+))*", re.I)
MAIN_TAGS = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "header")
# Elements that hold a piece of running text, never all of it.
TEXTUAL = ("p", "li", "h1", "h2", "h3", "td", "dd", "blockquote", "pre")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>|<[!?/][^>]*+>|<[A-Za-z][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    """An element, or a piece of text where ``tag`` is empty."""

    __slots__ = ("tag", "name", "aside", "firm", "kids", "text")

    def __init__(self, tag: str, name: str = "", aside: bool = False, text: str = ""):
        self.tag, self.name, self.aside, self.firm, self.text = tag, name, aside, False, text
        self.kids: list[Node] = []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag


def parse(page: str) -> Node:
    """The element tree; end tags that are left out are implied, stray ones are skipped."""
    root = Node("html")
    stack = [root]
    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        text = page[at : tag.start()] if tag else page[at:]
        if text:
            stack[-1].kids.append(Node("", text=text))
        if not tag:
            break
        at = tag.end()
        name = tag[2].lower() if tag[2] else re.match(r"<([A-Za-z][^\s/>]*)|", tag[0])[1]
        if not name:
            continue
        name = name.lower()
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth:]
                    break
                if name == "p" and stack[depth].tag in BLOCKS:
                    break
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if name in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SCOPES.get(name, ()):
                    break
                if stack[depth].tag in CLOSES[name]:
                    del stack[depth:]
                    break
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag[3] or "")}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        aside = name in ASIDE_TAGS or found.get("role", "").lower() in ASIDE_ROLES
        if name in BLOCKS and name not in ("html", "body", "article", "main"):
            aside = aside or any(ASIDE_NAMES.fullmatch(n) for n in names.split())
        if name == "header" and not any(n.tag in MAIN_TAGS for n in stack):
            aside = True
        if name in MAIN_TAGS:
            for around in stack:
                around.aside = False
        if name == "h1":
            for around in stack:
                around.firm = False
        node = Node(name, re.sub("[0-9]+", "#", names.lower()), aside)
        node.firm = aside and (name == "form" or any(FIRM_NAMES.fullmatch(n) for n in names.split()))
        stack[-1].kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not (tag[3] or "").endswith("/"):
            stack.append(node)
    return root


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


class Block(NamedTuple):
    """A block of text: where it is, whether it is mostly links, whether an article or main holds it.

    ``votes`` numbers the elements around it whose tag, role or name speaks against
    main text; the numbers of comments, adverts, consent boxes and forms are negative.
    """

    path: str
    text: str
    linked: bool
    marked: bool
    votes: tuple[int, ...] = ()


def blocks_of(root: Node) -> list[Block]:
    """All blocks of text that a page shows, in page order."""
    out: list[Block] = []
    pieces: list[str] = []
    state = {"path": "", "votes": (), "linked": 0, "size": 0}
    voted = 0

    def flush() -> None:
        text = clean("".join(pieces))
        if text:
            path = state["path"]
            out.append(Block(path, text, 2 * state["linked"] > state["size"], _mark_end(path) > 0, state["votes"]))
        pieces.clear()
        state["linked"] = state["size"] = 0

    todo: list[tuple[Node | None, str, bool, tuple[int, ...]]] = [(root, "", False, ())]
    while todo:
        node, path, link, votes = todo.pop()
        if not node:
            flush()
            continue
        if not node.tag:
            if not pieces:
                state["path"], state["votes"] = path, votes
            pieces.append(node.text)
            state["size"] += len(node.text)
            state["linked"] += len(node.text) if link else 0
            continue
        if node.tag in DROPPED_TAGS:
            if node.tag in BLOCKS:
                flush()
            continue
        if node.tag == "br":
            if not pieces:
                state["path"], state["votes"] = path, votes
            pieces.append(" ")
            continue
        if node.aside:
            voted += 1
            votes = (*votes, -voted if node.firm else voted)
        own = path
        if node.tag in BLOCKS or node.aside:
            flush()
            todo.append((None, path, link, votes))
            own = f"{path}/{node.label}"
        for kid in reversed(node.kids):
            todo.append((kid, own, link or node.tag == "a", votes))
    flush()
    return out


def _tag_of(part: str) -> str:
    return part.split(".", 1)[0]


def _mark_end(path: str) -> int:
    """How many parts of the path lead to the deepest article or main; 0 without one."""
    parts = path.split("/")
    return max((k + 1 for k, part in enumerate(parts) if _tag_of(part) in MAIN_TAGS), default=0)


def content_path(blocks: Iterable[Block]) -> str:
    """The deepest path that holds over half of the blocks' text.

    Text that an article or main holds counts MARKED times. A path that leads into
    one ends there, so that headings beside the longest part are under it.
    """
    size: dict[str, int] = {}
    for block in blocks:
        if block.linked and not block.marked:
            continue
        parts = block.path.split("/")
        for k in range(1, len(parts) + 1):
            path = "/".join(parts[:k])
            size[path] = size.get(path, 0) + len(block.text) * (MARKED if block.marked else 1)
    whole = size.get("", 0)
    content = max((p for p in size if 2 * size[p] > whole), key=lambda p: (p.count("/"), p), default="")
    if end := _mark_end(content):
        return "/".join(content.split("/")[:end])
    while _tag_of(content.rsplit("/", 1)[-1]) in TEXTUAL:
        content = content.rsplit("/", 1)[0]
    return content


def match(a: Node, b: Node, depth: int = 0) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-keeping pairing of equal labels below two roots."""
    if a.label != b.label:
        return 0, []
    if not a.tag or depth >= DEPTH:
        return 1, [(a, b)]
    x, y = a.kids, b.kids
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    pairs: dict[tuple[int, int], list[tuple[Node, Node]]] = {}
    for i, p in enumerate(x, 1):
        row, above = best[i], best[i - 1]
        for j, q in enumerate(y, 1):
            score, below = match(p, q, depth + 1) if p.label == q.label else (0, [])
            row[j] = max(above[j], row[j - 1], above[j - 1] + score)
            if score and row[j] == above[j - 1] + score:
                pairs[i, j] = below
    out, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if (i, j) in pairs and best[i][j] > max(best[i - 1][j], best[i][j - 1]):
            out += pairs[i, j]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, out


def skeleton(root: Node) -> Node:
    """The tree of blocks that alignment works on: one leaf for each block, its text cleaned."""
    return tree_of(blocks_of(root))[0]


def tree_of(blocks: list[Block]) -> tuple[Node, list[Node]]:
    """The tree of these blocks, and the leaf of each."""
    top = Node("html")
    places, leaves = {"": top}, []
    for block in blocks:
        at = ""
        for part in block.path.split("/")[1:]:
            if f"{at}/{part}" not in places:
                node = Node(part)
                places[at].kids.append(node)
                places[f"{at}/{part}"] = node
            at = f"{at}/{part}"
        leaves.append(Node("", text=block.text))
        places[at].kids.append(leaves[-1])
    return top, leaves


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def key_of(block: Block) -> int:
    """What is counted of a leaf: path and text, hashed."""
    return _hash(f"{block.path}\t{block.text}")


def shape_of(blocks: list[Block]) -> int:
    """The layout of a page: the places of its blocks down to SHAPE_DEPTH levels, running text left out. Never HOST."""
    places = set()
    for block in blocks:
        parts = block.path.split("/")[1 : SHAPE_DEPTH + 1]
        while parts and _tag_of(parts[-1]) in TEXTUAL:
            parts.pop()
        places.add("/".join(parts))
    return _hash("\n".join(sorted(places))) or 1


def induce(pages: list[str], constants: set[int]) -> str:
    """The content path of pages of one shape.

    Every page is aligned with the first. A leaf that is template in the whole host,
    or has the same text in at least CONSTANT_SHARE of these pages, is no slot; the
    path is that of the slots of all of them.
    """
    blocks = [varying_of(blocks_of(parse(p)), constants) for p in pages]
    trees = [tree_of(b) for b in blocks]
    pivot, leaves = trees[0]
    same: dict[int, list[int]] = {id(a): [id(a)] for a in leaves}
    for other, _ in trees[1:]:
        for a, b in match(pivot, other)[1]:
            if not a.tag and a.text == b.text:
                same[id(a)].append(id(b))
    fixed = {x for own in same.values() if len(trees) >= ENOUGH and len(own) >= CONSTANT_SHARE * len(trees) for x in own}
    slots = [b for own, (_, at) in zip(blocks, trees) for b, leaf in zip(own, at) if id(leaf) not in fixed]
    return content_path(slots or [b for own in blocks for b in own])


def varying_of(blocks: list[Block], constants: set[int]) -> list[Block]:
    """Blocks that are not template and that no vote takes away.

    Where an article or main keeps running text outside of all voted elements, every
    vote holds, whatever the sizes. Elsewhere votes against comments, adverts,
    consent boxes and forms hold if running text is left, and any other vote fails on
    an element with over half of the varying text that is then left.
    """
    varying = [b for b in blocks if key_of(b) not in constants]
    plain = [b for b in varying if not b.votes]
    if any(b.marked and _running(b) for b in plain):
        return plain
    firmly = [b for b in varying if all(vote > 0 for vote in b.votes)]
    if any(_running(b) for b in firmly):
        varying = firmly
    size: dict[int, int] = {}
    for block in varying:
        for vote in block.votes:
            size[vote] = size.get(vote, 0) + len(block.text)
    whole = sum(len(b.text) for b in varying)
    gone = {vote for vote, n in size.items() if 2 * n <= whole}
    return [b for b in varying if gone.isdisjoint(b.votes)] or varying


def _running(block: Block) -> bool:
    """Running text: no heading, and not mostly links."""
    return not block.linked and _tag_of(block.path.rsplit("/", 1)[-1]) not in HEADINGS


def _menus(blocks: list[Block], content: str) -> set[int]:
    """Identities of links in menus and lists of teasers: at least MENU at one path outside article and main, where most text is links.

    A list that follows running text of the content element, and hangs directly
    below it, belongs to the text.
    """
    texts: dict[str, list[Block]] = {}
    started = False
    for block in blocks:
        own = block.path[len(content) + 1 :].split("/") if block.path.startswith(content + "/") else []
        started = started or (len(own) == 1 and _running(block))
        if not block.marked and not (started and len(own) == 2 and _tag_of(own[0]) in ("ul", "ol")):
            texts.setdefault(block.path, []).append(block)
    return {
        id(link) for own in texts.values() for links in [[b for b in own if b.linked]]
        if len(links) >= MENU and 2 * sum(len(b.text) for b in links) > sum(len(b.text) for b in own) for link in links}


def _under(blocks: list[Block], content: str) -> list[Block]:
    """Blocks under the content path, and first headings that an article or main around it holds."""
    inside = [b.path == content or b.path.startswith(content + "/") for b in blocks]
    if not any(inside):
        return []
    parts = content.split("/")
    outer = next(("/".join(parts[: k + 1]) + "/" for k, part in enumerate(parts) if _tag_of(part) in MAIN_TAGS), None)
    return [b for b, own in zip(blocks, inside) if own or (outer and b.path.startswith(outer) and _tag_of(b.path.rsplit("/", 1)[-1]) == "h1")]


def extract(page: str | None, constants: set[int], content: str) -> list[str]:
    """Blocks of the main text of a page."""
    return main_text(blocks_of(parse(page)), constants, content) if page else []


def main_text(blocks: list[Block], constants: set[int], content: str) -> list[str]:
    """Blocks of the main text.

    Template nodes and what is voted out are left out of every page. The rest under
    the wrapper's content path is main text, or under the page's own where it has no
    such path; the links of menus go. A page of nothing but template nodes keeps
    what is under the path.
    """
    for some in (varying_of(blocks, constants), varying_of(blocks, set())):
        path = content if _under(some, content) else content_path(some)
        under, menus = _under(some, path), _menus(some, content_path(some))
        kept = [b.text for b in under if id(b) not in menus]
        if kept:
            return kept
    return []


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """Add ``blocks``, the blocks of each page's main text in page order, and ``text``, joined by empty lines.

    A leaf (path and text) on at least CONSTANT_SHARE of the distinct pages of a
    host, or of one shape of page on a host, is template; all pages are counted.
    For every shape, ``references`` distinct pages (those with the smallest hashes)
    are aligned by simple tree matching, which gives the content path of the varying
    leaves; shapes of fewer than ENOUGH distinct pages share the path of the host.
    The wrapper then runs over every page, whatever the page marks as article or
    main: that text only weighs more when the content path is looked for. Scripts
    and the like never count. Menus, headers, footers, sidebars, notices, adverts,
    forms and comments are known by element, role or the whole name of a block. Those
    that hold an article or main stay. Beside or inside an article with text of its
    own all others go, whatever their size; on other pages comments, adverts, consent
    boxes and forms go, and the rest unless it holds over half of the varying text.

    Columns named ``blocks`` or ``text`` are replaced. NULL and empty pages have no
    blocks and an empty text; pages without a host share the wrapper of no host;
    repeated rows are treated alike. Hosts of fewer than ENOUGH distinct pages have
    no template nodes: so few pages cannot tell template from copied text.

    Scale: leaves are hashed where they are parsed and counted with partial
    aggregates on (host, shape, leaf), so no task holds a host. References are chosen
    on hashes alone, with a limit that is applied before the shuffle. The table of
    wrappers has one row for each shape of ENOUGH pages; it is broadcast if it is
    small, which is measured, and joined by shuffle if not.
    """
    host = F.lower(F.coalesce(F.try_parse_url(F.col(f"`{url_col}`"), F.lit("HOST")), F.lit("")))
    named = pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html")).where(F.length("html") > 0).withColumn("h", F.xxhash64("html"))

    def leaves_of(batches):
        for batch in batches:
            at, shapes, leaves = [], [], []
            for i, page in enumerate(batch.column(2)):
                blocks = blocks_of(parse(page.as_py()))
                own = {key_of(b) for b in blocks} | {PAGE}
                at += [i] * len(own)
                shapes += [shape_of(blocks)] * len(own)
                leaves += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(shapes, pa.int64()), pa.array(leaves, pa.int64())], names=["host", "h", "shape", "leaf"])

    leaves = stored(named.select("host", "h", "html").mapInArrow(leaves_of, "host string, h long, shape long, leaf long").distinct(), "leaves")
    counts = stored(leaves.groupBy("host", "shape", "leaf").agg(F.count("*").alias("n")), "leaf_counts")
    totals = counts.where(F.col("leaf") == PAGE)
    enough = totals.where(F.col("n") >= ENOUGH).select("host", F.col("shape").alias("scope"), F.col("n").alias("whole"))
    rare = totals.groupBy("host").agg(F.sum("n").alias("whole"), F.min("n").alias("least"))
    scopes = stored(enough.union(rare.where(F.col("least") < ENOUGH).select("host", F.lit(HOST).alias("scope"), "whole")), "scopes")
    hosts = stored(rare.where(F.col("whole") >= ENOUGH).select("host", "whole"), "hosts")
    often = (F.col("n") >= ENOUGH) & (F.col("leaf") != PAGE)
    share = F.col("n") >= CONSTANT_SHARE * F.col("whole")
    by_shape = _sized_join(counts.where(often).withColumnRenamed("shape", "scope"), scopes, ["host", "scope"], 64, "inner").where(share)
    by_host = _sized_join(counts.groupBy("host", "leaf").agg(F.sum("n").alias("n")).where(often), hosts, ["host"], 64, "inner").where(share)
    by_host = _sized_join(by_host.select("host", "leaf"), scopes.select("host", "scope"), ["host"], 64, "inner")
    fixed = by_shape.select("host", "scope", "leaf").union(by_host.select("host", "scope", "leaf"))
    fixed = stored(fixed.groupBy("host", "scope").agg(F.collect_set("leaf").alias("constants")), "constants")

    at = leaves.where(F.col("leaf") == PAGE).select("host", "shape", "h")
    of_shape = at.withColumn("nth", F.row_number().over(Window.partitionBy("host", "shape").orderBy("h"))).where(F.col("nth") <= references)
    of_host = at.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("nth") <= references)
    wanted = of_shape.select("host", F.col("shape").alias("scope"), "h").union(of_host.select("host", F.lit(HOST).alias("scope"), "h"))
    chosen = stored(_sized_join(wanted, scopes.select("host", "scope"), ["host", "scope"], 64, "inner"), "references")
    sample = _sized_join(named, chosen, ["host", "h"], 64, "inner").dropDuplicates(["host", "scope", "h"]).join(fixed, ["host", "scope"], "left")

    def learn(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        constants = group["constants"].iloc[0]
        constants = [] if constants is None else [int(x) for x in constants]
        return pd.DataFrame({"host": [key[0]], "scope": [key[1]], "constants": [constants], "content": [induce(list(group["html"]), set(constants))]})

    learned = sample.groupBy("host", "scope").applyInPandas(learn, "host string, scope long, constants array<long>, content string")
    wrappers = stored(learned.select("host", "scope", F.struct("constants", "content").alias("wrapper")), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper.content") + 8 * F.size("wrapper.constants") + 200), F.lit(0)).alias("b")).first()["b"]

    def parser():
        def work(texts: pa.Array) -> list[pa.Array]:
            out, shapes = [], []
            for page in texts:
                blocks = blocks_of(parse(page.as_py())) if page.as_py() else None
                out.append(None if blocks is None else json.dumps(blocks, ensure_ascii=False))
                shapes.append(None if blocks is None else shape_of(blocks))
            return [pa.array(out, pa.string()), pa.array(shapes, pa.int64())]

        return work

    wide = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), F.col(f"`{html_col}`").alias("page"))
    parsed = map_text(wide, "page", [StructField("page", StringType()), StructField("scope", LongType())], parser)
    side = (lambda w: F.broadcast(w)) if size <= BROADCAST_BYTES else (lambda w: w)
    parsed = parsed.join(side(wrappers), ["host", "scope"], "left")
    parsed = parsed.join(side(wrappers.where(F.col("scope") == HOST).select("host", F.col("wrapper").alias("general"))), "host", "left")
    packed = parsed.select("row", F.struct("page", F.coalesce("wrapper", "general").alias("wrapper")).alias("job"))

    def make():
        memo: dict[tuple, set[int]] = {}

        def work(jobs: pa.Array) -> list[pa.Array]:
            out = []
            found = jobs.field("wrapper")
            for page, constants, content in zip(jobs.field("page"), found.field("constants"), found.field("content")):
                if not page.is_valid:
                    out.append([])
                    continue
                key = tuple(constants.as_py() or ())
                if key not in memo:
                    if len(memo) > 256:
                        memo.clear()
                    memo[key] = set(key)
                blocks = [Block(path, text, linked, marked, tuple(votes)) for path, text, linked, marked, votes in json.loads(page.as_py())]
                out.append(main_text(blocks, memo[key], content.as_py() or ""))
            return [pa.array(out, pa.list_(pa.string()))]

        return work

    done = map_text(packed, "job", [StructField("blocks", ArrayType(StringType()))], make)
    rest = [c for c in pages.columns if c.lower() not in ("blocks", "text")]
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "blocks", F.concat_ws("\n\n", "blocks").alias("text"))


def _sized_join(left: DataFrame, right: DataFrame, on: list[str], width: int, how: str) -> DataFrame:
    """Join with a stored table, broadcast if its rows of ``width`` bytes are few."""
    small = right.count() * width <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)
