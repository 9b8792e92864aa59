"""Operator 2: main text of web pages by wrapper induction.

Every host has a reference page (its smallest page_id). Siblings of a DOM tree with one label (tag and
classes) are one slot. A page's tree is matched with the reference's from the root down: labels of
sibling slots are distinct, so each finds its partner by label, however many there are and in whatever
order, and the matching is the largest there is. Texts are counted element by element: grouped
aggregation over all pages of a host counts, for every slot of the reference, the pages that match it
and on how many of them each element text stands there. An element's text is that of its whole subtree,
so parts without text neither help nor hinder. Texts that stand in a slot on nearly all pages are
template, the others vary. The wrapper of a host, one bounded row, goes back to its pages: template
elements and nodes whose tag, role or class names an apparatus part (menus, footers, adverts, comments,
...) are left out, the article elements (or main, or else the slot that holds nearly all the varying
text, with the headings before it) are taken, and every block of what stays gives a line.

Elements within a line of running text are part of it and never template by themselves. Copies of one
page count as one page. If nothing would stay, template elements are kept.

Pages are read in time that grows with their length, however deep, long or broken: tags without an
end are text, and trees are walked without recursion. Null html counts as empty: empty text. A page with null url belongs to the host "". Repeated rows
give repeated rows. Malformed markup is read as far as it goes. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivia.llm.common import cut, in_batches, quoted, table

#: A text is template if it stands in a slot on at least CONSTANT of the pages with that slot: FEW
#: pages at least, and where they are under PAGES, half of the host's pages.
FEW, PAGES, CONSTANT = 3, 20, 0.9
#: A slot with this share of a page's varying text is the container, where no element says so.
MOST = 0.9
#: Characters of all wrappers that may go to every executor, and those counted for a row besides its reference.
BROADCAST, ROW = 16_000_000, 100

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Tags of a page whose quotes may stay open; after so many, quotes count for nothing on that page.
OPEN_QUOTES = 64
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "br"} | {"li", "dd", "dt"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
_SCOPE = frozenset("html body div article section main aside nav header footer form table td th ul ol dl blockquote button figure".split())
_ENDS_AT = frozenset("p li dt dd tr td th thead tbody tfoot blockquote pre h1 h2 h3 h4 h5 h6 br".split())
_P = frozenset({"p"})
_HEADING = re.compile("h[1-6]")
_OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea input iframe svg canvas object dialog menu title math audio video datalist fieldset label".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion sidebar sidenav aside nav navbar navigation menu menubar topbar toolbar footer foot masthead breadcrumb breadcrumbs crumbs pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register search searchbox social share sharing related recommended recommendations comment comments commentlist reply replies respond disqus discussion widget skip disclaimer copyright".split()
)


class Node:
    __slots__ = ("attrs", "children", "label", "out", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children = tag, []
        self.label, self.out = _judged(tag, attrs)


@lru_cache(maxsize=50_000)
def _judged(tag: str, attrs: str) -> tuple[str, bool]:
    """A node's label for tree matching, and whether it is an apparatus part by its own account."""
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(re.split(r"[^a-z]+", names))
    out = tag in _OUT_TAGS or found.get("role", "").lower() in _OUT_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return f"{tag}.{'.'.join(sorted(found.get('class', '').lower().split()))}", out or bool(tag not in ("html", "body", "article", "main") and words & _OUT_WORDS)


def _next_tag(html: str, at: int, open_quotes: int) -> tuple[int, int, str, str, str, int] | None:
    """Start, end, slash, name and attributes of the next tag, and how many tags had open quotes by then;
    comments and declarations have no name. None if no tag ends from here on."""
    while (start := html.find("<", at)) >= 0:
        m = _TAG.match(html, start) if open_quotes < OPEN_QUOTES else None
        if m:
            return start, m.end(), m[1], m[2].lower(), m[3], open_quotes
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            return start, len(html) if end < 0 else end + 3, "", "", "", open_quotes
        m = _OPEN.match(html, start)
        if not m and html[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        end = html.find(">", start) + 1
        if not end:
            return None
        return (start, end, m[1], m[2].lower(), html[m.end() : end - 1], open_quotes + 1) if m else (start, end, "", "", "", open_quotes)
    return None


def parse(html: str) -> Node:
    """A lenient DOM tree: nodes and strings."""
    root = Node("#root")
    stack, at, open_quotes = [root], 0, 0
    opened: dict[str, int] = {}  # how often each tag is on the stack
    last = html.rfind(">") + 1

    def drop(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def close(names: set[str] | frozenset[str]) -> None:
        for n in names:
            if opened.get(n):
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                drop(k)
                return
            if stack[k].tag in _SCOPE:
                return

    while found := _next_tag(html, at, open_quotes):
        start, end, slash, tag, attrs, open_quotes = found
        if start > at:
            stack[-1].children.append(html[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                drop(k)
            continue
        if tag in _ENDS_P:
            close(_P)
        if tag in _SAME:
            close(_SAME[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in _RAW:
            ends = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at, last)
            at = ends.end() if ends else len(html)
        elif tag not in _VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def _slots(nodes: list[Node]) -> dict[str, list[Node]]:
    """The children of nodes that are not out, by label."""
    by_label: dict[str, list[Node]] = {}
    for n in nodes:
        for c in n.children:
            if isinstance(c, Node) and not c.out:
                by_label.setdefault(c.label, []).append(c)
    return by_label


class Slot:
    """A slot of a reference page: its number and the slots below it by label."""

    __slots__ = ("kids", "number")

    def __init__(self, number: int):
        self.number, self.kids = number, {}


@lru_cache(maxsize=64)
def _reference(html: str) -> Slot:
    top, number = Slot(0), 1
    todo = [([parse(html)], top)]
    while todo:
        nodes, slot = todo.pop()
        for label, own in _slots(nodes).items():
            slot.kids[label] = kid = Slot(number)
            number += 1
            todo.append((own, kid))
    return top


def align(root: Node, reference: str) -> Iterator[tuple[int, list[Node]]]:
    """Numbers of the reference's slots, and the nodes of a page that match them."""
    todo = [([root], _reference(reference))]
    while todo:
        nodes, slot = todo.pop()
        yield slot.number, nodes
        todo += [(own, slot.kids[label]) for label, own in _slots(nodes).items() if label in slot.kids]


def _said(root: Node, gone: set[int] = frozenset()) -> dict[int, tuple[bytes, int]]:
    """Hash and size of the text of each node's subtree, without what is out or gone; b"" for none."""
    found: dict[int, tuple[bytes, int]] = {}
    todo = [(root, False)]
    while todo:
        node, done = todo.pop()
        if node.out or id(node) in gone:
            found[id(node)] = b"", 0
        elif not done:
            todo.append((node, True))
            todo += [(c, False) for c in node.children if isinstance(c, Node)]
        else:
            parts, size = [], 0
            for c in node.children:
                if isinstance(c, Node):
                    part, n = found[id(c)]
                else:
                    text = " ".join(unescape(c).split())
                    part, n = (blake2b(text.encode("utf-8", "replace"), digest_size=8).digest() if text else b""), len(text)
                if part:
                    parts.append(part)
                    size += n
            found[id(node)] = (parts[0] if len(parts) == 1 else blake2b(b"".join(parts), digest_size=8).digest() if parts else b""), size
    return found


def _inline(root: Node) -> set[int]:
    """Nodes that stand within a line of running text."""
    found, todo = set(), [root]
    while todo:
        n = todo.pop()
        kids = [c for c in n.children if isinstance(c, Node)]
        if len(kids) < len(n.children) and any(isinstance(c, str) and not c.isspace() for c in n.children):
            found.update(id(c) for c in kids if c.tag not in _BLOCK)
        todo += kids
    return found


def slot_texts(root: Node, reference: str) -> Iterator[tuple[int, int, list[Node]]]:
    """Of a page: slot, text (a hash of both) and its elements; text 0 for each slot with any text."""
    said, inline = _said(root), _inline(root)
    for number, nodes in align(root, reference):
        by_text: dict[bytes, list[Node]] = {}
        for n in nodes:
            if (text := said[id(n)][0]) and id(n) not in inline:
                by_text.setdefault(text, []).append(n)
        if by_text:
            yield number, 0, []
        for text, own in by_text.items():
            yield number, int.from_bytes(blake2b(number.to_bytes(4, "big") + text, digest_size=8).digest(), "big", signed=True), own


def _blocks(node: Node, gone: set[int], inside: bool, out: list[str], buffer: list[str]) -> None:
    """Lines of a tree without what is out, in page order; buffer holds the open line."""

    def flush() -> None:
        if line := " ".join(unescape("".join(buffer)).split()):
            out.append(line)
        buffer.clear()

    todo: list = [(node, inside, False)]
    while todo:
        item, inside, done = todo.pop()
        if isinstance(item, str):
            buffer.append(item)
        elif done:
            flush()
        elif not (item.out or id(item) in gone or (item.tag == "header" and not inside)):
            block = item.tag in _BLOCK
            if block:
                flush()
                todo.append((item, inside, True))
            inner = inside or item.tag in ("article", "main")
            todo += [(c, inner, False) for c in reversed(item.children)]
    flush()


def _find(node: Node, tags: frozenset, gone: set[int]) -> list[Node]:
    """Outermost nodes with one of tags that are not out."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.out or id(n) in gone:
            continue
        if n.tag in tags:
            found.append(n)
        else:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return found


def extract(html: str, reference: str | None = None, constant: Iterable[int] = ()) -> str:
    """The main text of one page, given its host's wrapper."""
    root, constant = parse(html), frozenset(constant)
    gone: set[int] = set()
    if reference is not None and constant:
        gone = {id(n) for _, text, own in slot_texts(root, reference) if text in constant for n in own}
    lines = _content(root, gone)
    return "\n".join(lines or (_content(root, set()) if gone else []))


def _content(root: Node, gone: set[int]) -> list[str]:
    def lines(node: Node, inside: bool) -> list[str]:
        out: list[str] = []
        _blocks(node, gone, inside, out, [])
        return out

    for tags in (frozenset({"article"}), frozenset({"main"})):
        if found := _find(root, tags, set()):
            return [x for n in found for x in lines(n, True)]
    if not gone:
        return lines(root, False)
    before, nodes = _container(root, gone)
    return [x for n in [*before, *nodes] for x in lines(n, False)]


def _container(root: Node, gone: set[int]) -> tuple[list[Node], list[Node]]:
    """The deepest slot with at least MOST of all varying text, and the headings before it."""
    said = _said(root, gone)
    before, nodes, least = [], [root], MOST * said[id(root)][1]
    while True:
        slots = {k: own for k, own in _slots(nodes).items() if own[0].tag in _BLOCK or own[0].tag == "html"}
        inner = next((own for own in slots.values() if (n := sum(said.get(id(c), (b"", 0))[1] for c in own)) and n >= least), None)
        # a slot of many paragraphs is what the container holds, not the container
        if inner is None or inner[0].tag in _ENDS_AT or (len(inner) == 1 and not any(isinstance(c, Node) and c.tag in _BLOCK for c in inner[0].children)):
            return before, nodes
        first = {id(c) for c in inner}
        for n in nodes:
            for c in n.children:
                if isinstance(c, Node) and id(c) in first:
                    break
                if isinstance(c, Node) and _HEADING.fullmatch(c.tag):
                    before.append(c)
        nodes = inner


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(quoted(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def _with_host(pages: DataFrame, by_host: DataFrame, size: int, salts: int) -> DataFrame:
    """pages with the row of by_host, one per host and size characters in all, if there is one. A
    table of checked size goes to every executor, so that pages stay where they are; a larger one
    meets them under salted hosts, so that no host's pages meet in one task."""
    if size <= BROADCAST:
        return pages.join(F.broadcast(by_host), "host_id", "left")
    salted = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host_id", "_salt"], "left").drop("_salt")


def _size(by_host: DataFrame) -> int:
    return by_host.agg(F.sum(F.coalesce(F.length("reference"), F.lit(0)) + ROW)).first()[0] or 0


def wrappers(pages: DataFrame, *, salts: int = 64) -> tuple[DataFrame, int]:
    """host_id, reference, constant: one row per host of pages (page_id, url, html, host_id); and
    their size in characters."""
    there = pages.filter("html IS NOT NULL")
    first = cut(there.groupBy("host_id").agg(F.min("page_id").alias("page_id")))
    few = first.count() * ROW <= BROADCAST
    reference = cut(there.join(F.broadcast(first) if few else first, ["host_id", "page_id"]).groupBy("host_id").agg(F.min("html").alias("reference")))
    size = _size(reference)

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        for hosts, htmls, references in batches:
            out: list[list] = [[], [], [], []]
            for host, html, ref in zip(hosts, htmls, references, strict=True):
                if ref is None:
                    continue
                page = int.from_bytes(blake2b(html.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                for number, text, _ in slot_texts(parse(html), ref):
                    for column, value in zip(out, (host, number, text, page), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host_id", "node", "text", "page"])

    met = _with_host(there, reference, size, salts).select("host_id", "html", "reference")
    seen = in_batches(met, rows, "host_id long, node int, text long, page long").groupBy("host_id", "node", "text").agg(F.count("*").alias("n"), F.min("page").alias("least"), F.max("page").alias("most"))
    often = seen.filter((F.col("text") == 0) | ((F.col("n") >= FEW) & (F.col("least") != F.col("most"))))
    slots = often.filter("text = 0").select("host_id", "node", F.col("n").alias("pages"))
    whole = slots.filter("node = 0").select("host_id", F.col("pages").alias("whole"))
    enough = slots.join(whole, "host_id").filter((F.col("pages") >= PAGES) | ((F.col("pages") >= FEW) & (2 * F.col("pages") >= F.col("whole"))))
    fixed = often.filter("text <> 0").join(enough, ["host_id", "node"]).filter(F.col("n") >= CONSTANT * F.col("pages"))
    found = cut(reference.join(fixed.groupBy("host_id").agg(F.collect_list("text").alias("constant")), "host_id", "left"))
    return found, size + (found.agg(F.sum(8 * F.greatest(F.size("constant"), F.lit(0)))).first()[0] or 0)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 64) -> DataFrame:
    """page_id, url, text of every row of pages."""
    slim = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"), F.xxhash64(host_of(url_col)).alias("host_id"))

    def rows(batches: Iterable[list]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls, references, constants in batches:
            texts = [extract(h, r, c or ()) if h else "" for h, r, c in zip(htmls, references, constants, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    met = _with_host(slim, *wrappers(slim, salts=salts), salts).select("page_id", "url", "html", "reference", "constant")
    return in_batches(met, rows, "page_id long, url string, text string")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
