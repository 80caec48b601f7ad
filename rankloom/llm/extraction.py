"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree whose nodes are element paths (tag and
class names). A node's importance joins two entropies over the host's pages: how
varied its presentation is (the sequence of its children) and how specific its
content is. A text on n pages has an entropy of ln n over them; a node's content
counts exp(-mean entropy of its distinct texts), so 1 if every page has a text of
its own and 1/6 if each is on six pages, however many copies one text has. Few
pages are little evidence: importance is drawn towards 1 by ``DOUBT`` pages of no
evidence. Nodes of low importance lose their text on each page, in articles as
elsewhere; a branch without any other text is gone with them.

What an element says about itself is a term of its importance: menus, footers,
forms and what isn't shown have none by their tags and attributes; names such as
``ad`` or ``comments`` take it away unless a name such as ``post`` or ``content``
stands beside them, then the tree alone decides. Text beside an article is left
out unless what is important of it is longer than the article, which is a teaser
then. An article that would lose more than half of its text keeps all of it, and
so does a page that would lose everything: a host's pages may repeat each other,
and then the tree says nothing about them.

Text comes in blocks: character references are decoded, white space becomes one
space, blocks are joined by a line feed. Markup is read tolerantly, in one pass
whose cost grows with the length only: missing end tags are implied, unmatched
ones ignored, script and style content skipped whole.

Edge cases: null html is empty and gives an empty text; a null url has the empty
host; repeated rows are repeated; an empty table gives no rows; html of any length
is read whole; pages that tie in everything get equal texts. Only page_id, url and
html are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.lookups import fair_share, lookup
from rankloom.llm.work import table

# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = set("head script style title noscript template iframe svg canvas object embed noembed noframes textarea select button nav footer aside form menu dialog".split())
BESIDE = set(
    "ad ads adbox advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist respond disqus share sharing social related recommended widget toolbar pagination pager login signup search skip "
    "contentinfo complementary dialog form".split()
)
CONTENT = set("article body content entry main post prose story text".split())
TITLED = {"header"}  # a page's header is beside the text; an article's own holds its title
MAIN = {"article", "main"}

GAMMA = 0.9  # how much content weighs against presentation
LOW = 0.5  # texts of such a node are typically on two pages or more
DOUBT = 2.0

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAIL = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+")
ATTR = re.compile(r"(?i)(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))")
UNSHOWN = re.compile(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)")
END_OF = {t: re.compile(rf"(?i)</{t}(?=[\s/>]|\Z)") for t in RAW}
CLOSES = {"li": (("li",), {"ul", "ol", "menu"}), "dt": (("dt", "dd"), {"dl"}), "dd": (("dt", "dd"), {"dl"}), "tr": (("tr", "td", "th"), {"table"}), "td": (("td", "th"), {"tr", "table"}), "th": (("td", "th"), {"tr", "table"}), "option": (("option",), {"select"})}


class Element:
    __slots__ = ("beside", "children", "main", "node", "tag")

    def __init__(self, tag: str, node: int, beside: bool, main: bool):
        self.tag, self.node, self.beside, self.main = tag, node, beside, main
        self.children: list[str] = []


def hashed(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) >> 1


def open_element(tag: str, attrs: str, parent: Element) -> Element:
    """The element with its place in the tree (a hash of the path) and whether its text is beside the main text."""
    names: list[str] = []
    roles: set[str] = set()
    unshown = False
    if attrs:
        for kind, *values in ATTR.findall(attrs):
            kind, value = kind.lower(), next(filter(None, values), "").lower()
            if kind == "style":
                unshown |= bool(UNSHOWN.search(value))
            elif kind == "hidden":
                unshown |= value != "until-found"
            elif kind == "aria-hidden":
                unshown |= value == "true"
            else:
                roles.update(re.split(r"[^a-z0-9]+", value))
                if kind == "class":
                    names = sorted(value.split())
    side = bool(roles & BESIDE) and not roles & CONTENT
    if tag in MAIN:
        side = bool(roles & {"comment", "comments", "related", "ad", "ads"})
    elif tag in ("html", "body"):
        side = False
    beside = parent.beside or unshown or tag in NO_CONTENT or side
    if (tag in TITLED or roles & TITLED) and not parent.main:
        beside = True
    if tag in INLINE:
        return Element(tag, parent.node, beside, parent.main)
    label = ".".join([tag, *names])
    parent.children.append(label)
    # what stands directly in the page is no branch of its own
    return Element(tag, 0 if parent.node == 0 and tag in ("html", "body") else hashed(f"{parent.node}/{label}"), beside, parent.main or tag in MAIN)


class Tags:
    """Where each tag ends. Text that looks like a tag without an end is looked through once, not once a tag."""

    def __init__(self, html: str):
        self.html, self.blind, self.none_after = html, 0, len(html)

    def end(self, at: int) -> int:
        """The place of the tag's ``>``, outside of quotes if these are closed; -1 if there is none."""
        if at >= self.blind:
            stop = TAIL.match(self.html, at).end()
            if stop < len(self.html) and self.html[stop] == ">":
                return stop
            self.blind = stop
        return self.find(at)

    def find(self, at: int) -> int:
        if at >= self.none_after:
            return -1
        stop = self.html.find(">", at)
        if stop < 0:
            self.none_after = at
        return stop


def blocks(html: str) -> tuple[list[tuple[int, bool, bool, str]], list[Element]]:
    """(node, beside, in main, text) of each block in page order, and every element that holds blocks."""
    root = Element("", 0, False, False)
    stack, found, elements = [root], [], [root]
    held: list[str] = []
    open_tags: dict[str, int] = {}
    tags = Tags(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                top = stack[-1]
                found.append((top.node, top.beside, top.main, text))

    def close_to(k: int) -> None:
        if any(e.tag not in INLINE for e in stack[k:]) or any(e.beside != stack[k - 1].beside for e in stack[k:]):
            flush()
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            held.append(html[at:])
            break
        if start > at:
            held.append(html[at:start])
        m = NAME.match(html, start)
        if not m:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            end = tags.find(start) if html[start + 1 : start + 2] in ("!", "?") else -1
            if end < 0:
                held.append("<")
            at = start + 1 if end < 0 else end + 1
            continue
        end = tags.end(m.end())
        if end < 0:
            held.append("<")
            at = start + 1
            continue
        at = end + 1
        tag, attrs = m.group(1).lower(), html[m.end() : end]
        if html[start + 1] == "/":
            if tag == "br" or tag == "p" and not open_tags.get("p"):
                flush()
                continue
            if not open_tags.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            ends, within = CLOSES.get(tag, ((), set()))
            if any(open_tags.get(t) for t in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in ends:
                        close_to(k)
                        if tag != "tr":
                            break
            if open_tags.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close_to(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
        e = open_element(tag, attrs, stack[-1])
        if tag in RAW:
            closing = END_OF[tag].search(html, at)
            stop = closing.start() if closing else n
            if not e.beside:
                held.append(html[at:stop])
            end = tags.find(stop) if closing else -1
            at = end + 1 if end >= 0 else n
            continue
        if e.beside != stack[-1].beside:
            flush()
        if not attrs.endswith("/") or tag not in INLINE:
            stack.append(e)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag not in INLINE:
                elements.append(e)
    flush()
    return found, elements


def text_of(html: str, low: frozenset[int] = frozenset()) -> str:
    """The main text: blocks of the branch that holds most of it, without low or side branches."""
    found = [b for b in blocks(html)[0] if not b[1]]
    kept = [b for b in found if b[0] not in low]
    size = lambda some: sum(len(b[3]) for b in some)
    article, rest = [b for b in found if b[2]], [b for b in kept if not b[2]]
    if article and size(rest) <= size(article):
        main = [b for b in kept if b[2]]
        found = main if 2 * size(main) >= size(article) else article  # where articles repeat each other, low says nothing
    else:
        found = kept or found  # a page that would lose everything isn't described by its host's tree
    return "\n".join(b[3] for b in found)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1)).otherwise(F.lit(""))
    return F.translate(F.regexp_replace(F.coalesce(rest, F.lit("")), r"(?s)[?#].*$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, main, pages, texts (distinct ones), importance: every node of every host's merged tree.

    Tasks count what they have seen before the shuffle; a host's pages never meet in one task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "node", "main", "kind", "feature", "n"]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        counts: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            cols = zip(*((*k, n) for k, n in counts.items()))
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            counts.clear()
            return batch

        for batch in batches:
            for host, html in zip(*(c.to_pylist() for c in batch.columns)):
                found, elements = blocks(html)
                looks: dict[tuple[int, bool], list[str]] = {}
                for e in elements:
                    looks.setdefault((e.node, e.main), []).extend(e.children)
                keys = {(host, node, main, False, hashed("|".join(kids))) for (node, main), kids in looks.items()}
                keys |= {(host, node, main, True, hashed(text)) for node, _, main, text in found if node}
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
                if len(counts) > 50_000:
                    yield out()
        if counts:
            yield out()

    seen = pages.mapInArrow(run, "host string, node long, main boolean, kind boolean, feature long, n long")
    features = seen.groupBy("host", "node", "main", "kind", "feature").agg(F.sum("n").alias("n"))
    ln = F.col("n") * F.log("n")
    nodes = features.groupBy("host", "node", "main").agg(
        F.sum(F.when(~F.col("kind"), F.col("n"))).alias("pages"),
        F.sum(F.when(~F.col("kind"), ln)).alias("looks"),
        F.count(F.when(F.col("kind"), F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind"), F.log("n"))).alias("text_ln"),
    )
    base = F.log("pages")
    look = F.when(F.col("pages") > 1, 1 - F.col("looks") / F.col("pages") / base).otherwise(F.lit(1.0))
    content = F.when(F.col("texts") > 0, F.exp(-F.col("text_ln") / F.col("texts")))
    told = F.when(content.isNull(), look).otherwise((1 - GAMMA) * look + GAMMA * content)
    sure = F.col("pages") / (F.col("pages") + DOUBT)
    return nodes.select("host", "node", "main", "pages", "texts", (1 - (1 - told) * sure).alias("importance"))


def low_nodes(tree: DataFrame) -> DataFrame:
    """host, n (its pages), low: the nodes that lose their text, for hosts that have any; a stored table.

    A low node is seen on several pages, so a host lists far fewer than it has elements.
    """
    low = F.collect_set(F.when((F.col("texts") > 0) & (F.col("importance") < LOW), F.col("node")))
    return table(tree.groupBy("host").agg(F.max(F.when(F.col("node") == 0, F.col("pages"))).alias("n"), F.sort_array(low).alias("low")).where("size(low) > 0"), "style-tree")


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A host of very many pages has its nodes broadcast to them; the other hosts' pages meet theirs in a join.
    """
    pages = df.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    low = low_nodes(style_tree(pages.select("host", "html")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [text_of(html, frozenset(nodes or ())) for html, nodes in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    listed = low.agg(F.sum("n")).first()[0] or 0
    joined = lookup(pages, low, "host", fair_share(listed, df)) if listed else pages.withColumn("low", F.lit(None).cast("array<long>"))
    joined = joined.select("page_id", "url", "html", "low")
    kind = dict(df.dtypes)
    return joined.mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
