"""HTML extraction: a site style tree.

The DOMs of a host's pages are merged by path (tags with their classes from the body
down). In the merged tree a path's content importance is one minus the mean spread of the
contents found there over the pages, so what many pages repeat scores low. An element's
presentation importance is the same of its styles (sequences of child elements): a menu is
built alike on every page, an article is not. It counts in relation to that of the element
around the host's main content, the path that holds most of its distinct text; within that element,
and where the body itself is the element or its styles don't differ, it is 1. A path's importance is
the product of its content's and of its enclosing element's presentation. Paths of low importance are
taken out of each page, and with them all that lies in a
branch of which nearly all text is on such paths. The main path stays with what it lies in, as does
everything on hosts with too few pages to compare.

Navigation, headers, footers, asides, forms, adverts, notices and comments, by tag, role or
class, are judged in the tree like all else, and a list of their names takes what the tree
leaves of them (``by_name=False`` goes without it); words of a class, id or role
don't count on hosts whose important text lies nowhere but there. On pages without a
host and hosts with few pages there is the list alone. Head, scripts and comments of the
source are no part of the tree.

A page is parsed once. Its blocks and the hashes of its merged-tree rows are written;
only hashes are shuffled to build the trees. Each host's unimportant paths are broadcast
to the pages' blocks, or joined to them by a shuffle where they are many.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import BROADCAST_ROWS, counted, type_of, written
from tessera.session import checkpoint

#: the least importance that stays, pages of a host that allow a judgement, and the least share of a
#: branch's text that is important
LEAST_IMPORTANCE, LEAST_PAGES, LEAST_WITHIN = 0.5, 5, 0.1

# a tag's attributes end before the next tag, so that tags without an end cost no scan each
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^<>]*/>|<(script|style|template|noscript|svg|iframe|object|math|canvas|audio|video)\b"
                   r"[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: of these, what is left by an attribute with such a sign
_NO_TEXT = frozenset("script style template noscript svg iframe object math canvas audio video".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>|<[!?/][^>]*>|<(?:[a-zA-Z/!?][^>]*)\Z""")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements within a block's text
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby
s samp small span strike strong sub sup time tt u var""".split())
#: elements that are never article text
OUTSIDE = frozenset("""head title nav footer aside form menu dialog button select option textarea input fieldset
datalist frameset frame applet""".split())
#: words of a class, id or role that mark a branch as other than article text: a whole token, or all its hyphenated parts
_OTHER = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr popup modal newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar aside
widget footer header masthead topbar toolbar share sharing social related recommended comment comments commentlist disqus
replies respond notice notices alert disclaimer copyright login signup search pagination pager skip tag tags complementary
contentinfo searchbox site-header site-footer site-nav site-navigation main-nav main-menu main-navigation search-box""".split())
#: of them and of the elements above, those that list other articles, or comments as articles
_LISTS = frozenset("nav footer aside related recommended comment comments commentlist disqus replies respond".split())
_CLOSED_BY_BLOCK = "p"
_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}


def _host(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", url or "")
    return m[1].lower() if m else None


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


ROOT = _key("")


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(attrs):
        found.setdefault(name.lower(), a or b or c)
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return (attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").strip().lower() == "true"
            or bool(_NO_DISPLAY.search(attributes.get("style", ""))))


def _others(marks: list[str]) -> set[str]:
    """The words by which marks name a branch as other than article text."""
    found = set()
    for mark in marks:
        parts = re.split(r"[-_]+", mark.strip("-_"))
        if mark in _OTHER:
            found.add(mark)
        elif all(x in _OTHER for x in parts):
            found.update(parts)
    return found


WORD, TAG, META = 1, 2, 3


class Element:
    """An open or closed element; its path is a hash of its parent's path and its name. ``listed`` if a mark (WORD), its tag or an attribute (TAG) excludes it
    or it is no part of the body (META); ``out`` if it or what it lies in is."""

    __slots__ = ("tag", "path", "parent", "listed", "lists", "in_article", "children", "out")

    def __init__(self, tag: str, path: int, parent: Element | None):
        self.tag, self.path, self.parent = tag, path, parent
        self.listed, self.lists, self.out = 0, False, 0
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        self.children: list[str] = []

    def up(self):
        e = self
        while e is not None:
            yield e
            e = e.parent


class Page:
    """Blocks (path, text) of a page outside of excluded branches, and the child
    sequences of its elements.

    A branch that holds the page's article or main is not excluded; lists of other articles
    and comments are, if an article or main lies outside of them."""

    def __init__(self, source: str):
        self._found: list[tuple[Element, str]] = []
        self._elements: list[Element] = [Element("", ROOT, None)]
        self._stack: list[Element] = self._elements[:1]
        self._within: Counter = Counter()      # open elements by tag
        self._text: list[str] = []
        self._main, self._in_lists = False, []
        self._parse(_SKIP.sub(" ", source))
        if not self._main:
            for e in self._in_lists:
                e.listed = 0
        for e in self._elements:
            e.out = max(e.listed, e.parent.out if e.parent else 0)
        #: (element, text, how it is listed) of all branches of the body
        self.found = [(e, t, e.out) for e, t in self._found if e.out != META]
        self.blocks: list[tuple[int, str]] = [(e.path, t) for e, t, out in self.found if not out]
        #: (path, parent's path, child sequence)
        self.styles: list[tuple[int, int, str]] = [(e.path, e.parent.path, ",".join(e.children)) for e in self._elements[1:] if e.out != META]

    def _flush(self):
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self._found.append((self._stack[-1], text))

    def _close(self, depth: int):
        while len(self._stack) > depth:
            self._flush()
            self._within[self._stack.pop().tag] -= 1

    def _open(self, tag: str, attrs: str):
        self._flush()
        if self._stack[-1].tag == _CLOSED_BY_BLOCK:
            self._close(len(self._stack) - 1)
        if tag in _SAME:
            for d in range(len(self._stack) - 1, 0, -1):
                at = self._stack[d].tag
                if at in _SAME[tag]:
                    break
                if at == tag or (tag in ("dt", "dd") and at in ("dt", "dd")) or (tag in ("td", "th") and at in ("td", "th")):
                    self._close(d)
                    break
        attributes = _attributes(attrs) if attrs else {}
        marks = " ".join(attributes[k] for k in attributes if k in ("class", "id", "role")).lower().split() if attributes else []
        parent = self._stack[-1]
        name = f"{tag}.{marks[0]}" if marks else tag
        parent.children.append(name)
        e = Element(tag, parent.path if tag in ("html", "body") else _key(f"{parent.path}/{name}"), parent)
        self._elements.append(e)
        if tag in ("body", "article", "main"):
            self._spare(parent, tag)
        elif tag != "html":
            words = _others(marks) if marks else set()
            if e.in_article:
                words.discard("header")  # the article's own
            if tag in ("head", "title") or tag in _NO_TEXT:
                e.listed = META
            elif tag in OUTSIDE or (tag == "header" and not e.in_article) or (attributes and _hidden(attributes)):
                e.listed = TAG
            elif words:
                e.listed = WORD
            e.lists = bool(e.listed) and (tag in _LISTS or not words.isdisjoint(_LISTS))
        self._stack.append(e)
        self._within[tag] += 1

    def _spare(self, parent: Element, tag: str):
        """What holds a body, article or main is not excluded."""
        above = list(parent.up())
        lists = [e for e in above if e.lists] if tag == "article" else []
        for e in above:
            if e.listed and e not in lists:
                e.listed = 0
        if lists:
            self._in_lists += lists
        elif tag != "body":
            self._main = True

    def _parse(self, source: str):
        at = 0
        for m in _TAG.finditer(source):
            if m.start() > at:
                self._between(source[at:m.start()])
            at = m.end()
            if m[2]:
                self._tag(m[1], m[2].lower(), m[3])
        if at < len(source):
            self._between(source[at:])
        self._close(1)
        self._flush()

    def _between(self, text: str):
        """Text, in which a tag with an unclosed quote may be left."""
        at = 0
        if "<" in text:
            for m in _BROKEN.finditer(text):
                self._text.append(text[at:m.start()])
                self._tag(m[1], m[2].lower(), m[3])
                at = m.end()
        self._text.append(text[at:])

    def _tag(self, slash: str, tag: str, attrs: str):
        if tag in INLINE:
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            else:
                self._text.append(" ")
            return
        if not slash:
            self._open(tag, attrs)
            return
        self._flush()
        if not self._within[tag]:
            return
        for d in range(len(self._stack) - 1, 0, -1):
            if self._stack[d].tag == tag:
                self._close(d)
                return
            if self._stack[d].tag in ("article", "body", "td") and tag not in ("body", "html", "table", "tr", "article", "main"):
                return  # a stray end tag doesn't close what it lies in


BLOCK_TYPE = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string()), ("listed", pa.int8())]))
STYLE_TYPE = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("value", pa.int64())]))
#: the paths with text, each with the paths of its elements from itself to the body
UP_TYPE = pa.list_(pa.struct([("path", pa.int64()), ("up", pa.list_(pa.int64()))]))


def _parse_fn(by_name: bool):
    def run(batches):
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(lo, 256)
                hosts, marks, blocks, styles, ups = [], [], [], [], []
                for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    page = Page(source or "")
                    found = page.found if by_name else [(e, t, 0) for e, t, _ in page.found]
                    hosts.append(_host(url))
                    marks.append(_key("\n".join([t for _, t, out in found if out < TAG] or [t for _, t, _ in found])))
                    blocks.append([{"path": e.path, "text": t, "listed": out} for e, t, out in found])
                    styles.append([{"path": p, "parent": up, "value": _key(s)} for p, up, s in dict.fromkeys(page.styles)])
                    ups.append([{"path": e.path, "up": list(dict.fromkeys(x.path for x in e.up()))}
                                for e in {e.path: e for e, _, _ in found}.values()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(marks, pa.int64()),
                     pa.array(blocks, BLOCK_TYPE), pa.array(styles, STYLE_TYPE), pa.array(ups, UP_TYPE)],
                    ["page_id", "url", "host", "mark", "blocks", "styles", "ups"])
    return run


def parsed(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """Blocks, styles and paths of every page; without ``by_name`` no branch of the body is listed."""
    schema = (f"page_id {type_of(pages, 'page_id')}, url STRING, host STRING, mark BIGINT, "
              "blocks ARRAY<STRUCT<path: BIGINT, text: STRING, listed: TINYINT>>, "
              "styles ARRAY<STRUCT<path: BIGINT, parent: BIGINT, value: BIGINT>>, "
              "ups ARRAY<STRUCT<path: BIGINT, up: ARRAY<BIGINT>>>")
    return pages.select("page_id", "url", "html").mapInArrow(_parse_fn(by_name), schema)


def _spread(n, m):
    """Of a path: the mean share of log(m) that the logarithm of a value's pages takes: 0 if every value is
    on a page of its own, 1 if one value is on all pages."""
    return F.sum(n * F.log(n)) / F.sum(n) / F.log(F.max(m))


def style_tree(rows: DataFrame) -> DataFrame:
    """The merged trees of parsed pages: (host, path, importance, pages, m, chars, listed, main,
    by_tree, low) a path with text, of ``m`` pages. Pages of a host with equal text count as one
    together. A path is low by its own importance, or as it lies in an element of whose text, over
    all pages, less than LEAST_WITHIN is on important paths and that doesn't hold the main one.
    The main path is not a listed one, unless a host has important text nowhere but in branches
    that a word excludes: then it is ``by_tree``, and its words don't count."""
    same = rows.where("host IS NOT NULL").groupBy("host", "mark").agg(F.count("*").alias("c"))
    total = same.groupBy("host").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_PAGES)
    at = F.xxhash64("host")
    weight = F.coalesce(1.0 / F.col("c"), F.lit(1.0))
    pages = (rows.where("host IS NOT NULL").join(counted(same.where("c > 1")), ["host", "mark"], "left")
             .select(at.alias("h"), weight.alias("w"), "blocks", "styles"))
    many = total.select(at.alias("h"), "host", "m")
    # a text twice on a page counts once there
    text = (pages.select("h", "w", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(
        b["path"].alias("path"), F.xxhash64(b["text"]).alias("value"), F.length(b["text"]).alias("chars"), b["listed"].alias("listed"))))).alias("x"))
        .groupBy("h", "x.path", "x.value").agg(F.sum("w").alias("n"), F.max("x.chars").alias("chars"), F.min("x.listed").alias("listed"))
        .join(many, "h"))
    one = F.greatest("n", F.lit(1.0))
    content = text.groupBy("host", "path").agg((1 - _spread(one, F.col("m"))).alias("content"),
                                               F.sum("chars").alias("chars"), F.sum(F.col("n") * F.col("chars")).alias("mass"),
                                               F.min("listed").alias("listed"), F.max("m").alias("m"))
    style = (pages.select("h", "w", F.explode("styles").alias("x"))
             .groupBy("h", "x.path", "x.parent", "x.value").agg(F.sum("w").alias("n")).join(many, "h"))
    node = style.groupBy("host", "path", "parent").agg((1 - _spread(one, F.col("m"))).alias("style"), F.sum("n").alias("n"))
    on = node.select("host", "path", "parent", F.col("n").alias("pages"))
    out = written(
        content.join(on, ["host", "path"])
        .join(node.select("host", F.col("path").alias("parent"), "style"), ["host", "parent"], "left")
        .select("host", "path", "parent", "pages", "m", "chars", "mass", "listed", "content", F.coalesce("style", F.lit(0.0)).alias("style")), "tree")
    told = F.col("content") >= LEAST_IMPORTANCE
    hosts = out.groupBy("host").agg((~F.max(told & (F.col("listed") == 0)) & F.max(told & (F.col("listed") == WORD))).alias("by_tree"))
    named = out.join(hosts, "host").withColumn("may", F.when(F.col("by_tree"), told & (F.col("listed") == WORD)).otherwise(F.col("listed") == 0))
    main = named.where("may").groupBy("host").agg(F.max_by(F.struct("path", "parent", "style"), F.struct("chars", "path")).alias("main"))
    up = (rows.where("host IS NOT NULL").select(at.alias("h"), F.explode("ups").alias("x")).groupBy("h", "x.path").agg(F.min("x.up").alias("up"))
          .join(many, "h").select("host", "path", "up"))
    inside = F.col("main.path").isNull() | (F.col("main.parent") == ROOT) | (F.col("main.style") <= 0) | F.array_contains("up", F.col("main.parent"))
    presentation = F.when(inside, 1.0).otherwise(F.least(F.lit(1.0), F.col("style") / F.col("main.style")))
    nodes = checkpoint(named.join(main, "host", "left").join(up, ["host", "path"])
                       .select("host", "path", "pages", "m", "chars", "mass", "listed", "by_tree", "up", (F.col("content") * presentation).alias("importance"),
                               F.coalesce(F.col("main.path") == F.col("path"), F.lit(False)).alias("main")))
    important = F.col("importance") >= LEAST_IMPORTANCE
    within = checkpoint(nodes.select("host", "path", "mass", "main", important.alias("good"), F.explode("up").alias("at")))
    branch = (within.groupBy("host", "at").agg(F.sum(F.when(F.col("good"), F.col("mass")).otherwise(0.0)).alias("good"),
                                               F.sum("mass").alias("mass"), F.max("main").alias("main"))
              .where(~F.col("main") & (F.col("good") < LEAST_WITHIN * F.col("mass"))).select("host", "at"))
    cut = within.join(branch, ["host", "at"]).select("host", "path").distinct().withColumn("cut", F.lit(True))
    return (nodes.join(cut, ["host", "path"], "left")
            .withColumn("low", ~F.col("main") & (~important | F.col("cut").isNotNull())).drop("cut", "mass", "up"))


def unimportant(tree: DataFrame) -> DataFrame:
    """(host, noise, by_tree): the paths to take out, an array a host."""
    return tree.groupBy("host").agg(F.sort_array(F.collect_set(F.when(F.col("low"), F.col("path")))).alias("noise"),
                                    F.max("by_tree").alias("by_tree"))


def extract(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """The main text of every page of ``pages(page_id, url, html, ...)``: (page_id, url,
    text, n_chars), blocks in page order, one a line. Without ``by_name`` the tree alone decides.

    A null or empty html, or one without article text, gives an empty text. A page whose url
    is null or names no host is judged by its own branches only. One result row per
    input row, repeated rows and null ids included; other columns are ignored."""
    rows = written(parsed(pages, by_name).withColumn("row", F.monotonically_increasing_id()), "parsed")
    tree = checkpoint(style_tree(rows))
    if tree.where("low").count() <= BROADCAST_ROWS:
        texts = rows.select("page_id", "url", "host", "blocks").join(counted(unimportant(tree), values="noise"), "host", "left")
        out = F.coalesce("noise", F.array().cast("array<bigint>"))
        texts = texts.withColumn("texts", F.transform(F.filter("blocks", lambda b: _stays(b["listed"]) & ~F.array_contains(out, b["path"])),
                                                      lambda b: b["text"]))
    else:  # the blocks meet the unimportant paths in a shuffle
        blocks = (rows.select("row", "host", F.posexplode("blocks").alias("at", "b")).select("row", "host", "at", "b.*")
                  .join(counted(tree.where("by_tree").select("host", "by_tree").distinct()), "host", "left").where(_stays(F.col("listed")))
                  .join(tree.where("low").select("host", "path"), ["host", "path"], "left_anti"))
        kept = blocks.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda b: b["text"]).alias("texts"))
        texts = rows.select("row", "page_id", "url").join(kept, "row", "left")
    text = F.array_join(F.coalesce("texts", F.array().cast("array<string>")), "\n")
    return (texts.select("page_id", "url", text.alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))


def _stays(listed):
    """Whether a block is not taken out by name."""
    return (listed == 0) | ((listed == WORD) & F.coalesce("by_tree", F.lit(False)))
