"""HTML extraction by a site style tree.

All pages of a host are merged into one tree of styles: a style node is the chain of an element's tags and
classes, known by a hash of its parent's hash and its own tag and classes, so that pages of any depth take linear time. A node's presentation importance is the entropy of its children's layout over the pages, its content
importance that of its texts; both are near zero where pages repeat one template. A container has the
importance of what is most important below it. Branches of low importance are cut from every page.

What a host of few pages cannot show is taken from what HTML itself declares (nav, footer, aside, form, article, main) and from
whole class tokens that name a template part ("sidebar", "site-footer", but not "has-sidebar" or "article-header"). A class
never takes an article with it, and inside an article only containers go by their class.

Pages are parsed once: the stored table has each page's blocks and what its tree holds.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ROW, SlotFilter, join_about, keyed, mapped, steps, stored

#: Importance below which a branch goes, and the pages of a host that must show it.
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 4
#: Weight of what is below a node in its importance, for each child.
BELOW = 0.9

RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "audio", "video", "title", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("table ul ol dl article section main body html td th".split())
#: Elements that say what a branch is.
NO_TEXT = frozenset("head nav footer aside form button select textarea input dialog menu search datalist option".split())
#: The same, where they stand before an article.
TOP_ELEMENTS = frozenset(["header", "label", "fieldset"])
#: Words that say so as a whole class, id or role token, alone or joined with one another and with words of place.
NO_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer contentinfo sidebar aside complementary widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login recommendations searchbox toolbar copyright skip".split()
)
#: The same, where they stand before an article; its own header and the words it is about stay.
TOP_WORDS = frozenset("banner header masthead form dialog search share".split())
#: Reader comments, also where each is an article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that say so in pairs only, as in "social-links".
WEAK_WORDS = frozenset("social share sharing follow links icons buttons media related recommended similar posts articles stories tags more".split())
PLACE_WORDS = frozenset("site page top bottom left right main primary secondary global container wrapper wrap area box block list bar section inner outer item items panel slot unit body text content group 1 2 3 4".split())
ARTICLE = frozenset(["article", "main"])
#: Elements of an article that no class takes from it, and those that no low importance of their own does.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre tbody tr td th figure figcaption".split())
KEPT_INSIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol table tbody tr td th dl dt dd figure figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """dropped: by what it or an element around it declares; by_class: only by classes, which an article inside is free of.
    label is its own tag and classes where it is a style node, else that of the node that it belongs to."""

    __slots__ = ("tag", "label", "style", "parent", "depth", "dropped", "by_class", "content", "children")

    def __init__(self, tag: str, up: Element | None, label: str, dropped: bool, by_class: bool, content: bool):
        self.tag, self.dropped, self.by_class, self.content, self.children = tag, dropped, by_class, content, []
        if up is None:
            self.label, self.style, self.parent, self.depth = "", 0, None, 0
        elif label:
            self.label, self.style, self.parent, self.depth = label, _signed(xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), seed=up.style & _ALL)), up.style, up.depth + 1
        else:
            self.label, self.style, self.parent, self.depth = up.label, up.style, up.parent, up.depth


_ALL = (1 << 64) - 1


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


@lru_cache(1 << 16)
def declares(token: str, inside: bool) -> str:
    """"comment" or "template" where a whole class token names such a part, else "". `inside` an article some words say nothing."""
    parts = [x.lower() for x in _PART.split(token) if x]
    known = NO_WORDS if inside else NO_WORDS | TOP_WORDS
    sure = [x for x in parts if x in known or x in COMMENT_WORDS]
    weak = [x for x in parts if x in WEAK_WORDS]
    if not all(x in known or x in COMMENT_WORDS or x in WEAK_WORDS or x in PLACE_WORDS for x in parts) or not (sure or len(weak) > 1):
        return ""
    return "comment" if any(x in COMMENT_WORDS for x in parts) else "template"


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _element(tag: str, attrs: str, up: Element, seen_article: bool) -> Element:
    classes, hidden, said, role = "", False, set(), ""
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                tokens = value.split()
                said.update(declares(t, up.content) for t in tokens)
                if key == "class":
                    classes = "".join("." + t.lower().replace("/", ".") for t in tokens)  # "/" is between labels
                role = value.lower() if key == "role" else role
            else:
                hidden |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", ""))
    article = tag in ARTICLE or role in ("main", "article")
    by_tag = hidden or tag in NO_TEXT or (tag in TOP_ELEMENTS and not up.content)
    if tag in ("html", "body") or up.content and tag in TEXT_ELEMENTS:
        by_class = False
    else:
        by_class = "comment" in said or "template" in said and not article
    free = article and up.dropped and up.by_class and not (by_tag or by_class or seen_article)  # a class around the first article does not take it
    dropped = not free and (up.dropped or by_tag or by_class)
    only_class = dropped and not by_tag and (up.by_class if up.dropped else by_class)
    label = f"/{tag}{classes}" if tag in BLOCK or classes else ""
    return Element(tag, up, label, dropped, only_class, not dropped and (up.content or article))


class Page:
    """The blocks of a page in order: (style, text, dropped, inside the article), and the elements that are style nodes."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.elements: list[Element] = []
        root = Element("", None, "", False, False, False)
        stack = [root]
        open_at: dict[str, list[int]] = {}  # places in the stack of each open tag, so that no element searches the stack
        blocks_at = [0]  # and of all elements that are blocks
        seen_article = False
        text: list[str] = []

        def block() -> None:
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if joined:
                    e = stack[-1]
                    self.blocks.append((e.style, joined, e.dropped, e.content))

        def last(tag: str) -> int:
            places = open_at.get(tag)
            return places[-1] if places else 0

        def cut(k: int) -> None:
            for e in stack[k:]:
                open_at[e.tag].pop()
            del stack[k:]
            while blocks_at[-1] >= k:
                blocks_at.pop()

        def close(tags: tuple[str, ...], walls: frozenset[str]) -> None:
            k = max(map(last, tags))
            if k and not any(last(w) > k for w in walls):
                block()
                cut(k)

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                k = last(tag)
                if k and (tag in BLOCK or k > blocks_at[-1]):  # an inline element does not end across a block
                    if tag in BLOCK or stack[k].dropped != stack[k - 1].dropped:
                        block()
                    cut(k)
                continue
            if tag in VOID:
                if tag == "hr":
                    block()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in ENDS_P:
                close(("p",), WALLS)
            if tag in SAME_KIND:
                close(SAME_KIND[tag], frozenset(("table", "ul", "ol", "dl")) if tag != "td" and tag != "th" else frozenset(("table", "tr")))
            e = _element(tag, m["attrs"], stack[-1], seen_article)
            seen_article |= e.content
            if tag in BLOCK or e.dropped != stack[-1].dropped:
                block()
            if e.style != stack[-1].style:
                stack[-1].children.append(e.label)
                self.elements.append(e)
            if not m["attrs"].endswith("/") or tag in BLOCK:
                open_at.setdefault(tag, []).append(len(stack))
                if tag in BLOCK:
                    blocks_at.append(len(stack))
                stack.append(e)
        if at < len(source):
            text.append(source[at:])
        block()

    def main(self) -> list[tuple[int, str, bool, bool]]:
        """Blocks that nothing declares to be template; only those of the article where the page has one."""
        whole = [b for b in self.blocks if not b[2]]
        return [b for b in whole if b[3]] or whole

    def text(self) -> str:
        """The text as far as one page shows it, without its site's tree."""
        return "\n".join(b[1] for b in self.main())


# ---------------------------------------------------------------- the tree of a host


_NODE = pa.struct([("style", pa.int64()), ("kind", pa.string()), ("value", pa.int64()), ("n", pa.int64())])
_LINK = pa.struct([("style", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("tag", pa.string())])
_BLOCK = pa.struct([("style", pa.int64()), ("inside", pa.bool_()), ("text", pa.string())])
_PARSED = (
    f"{ROW} long, page_id long, url string, host string, page long, nodes array<struct<style:long,kind:string,value:long,n:long>>, "
    "links array<struct<style:long,parent:long,depth:int,tag:string>>, blocks array<struct<style:long,inside:boolean,text:string>>"
)


def links(page: Page) -> dict[int, tuple[int | None, int, str]]:
    """Parent, depth and tag of each style node of a page, the root being node 0."""
    return {0: (None, 0, "")} | {e.style: (e.parent, e.depth, e.tag) for e in page.elements}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page with its host, a hash of what its tree holds, its style nodes with layout of children and texts, counted, their
    parents, and the blocks of its main part."""
    for batch in batches:
        for step in steps(batch, "html"):
            rows = []
            for url, source in zip(step.column("url").to_pylist(), step.column("html").to_pylist()):
                page = Page(source or "")
                counts: Counter[tuple[int, str, int]] = Counter()
                shown = [b for b in page.blocks if not b[2]]  # what is declared has no say in the importance of what holds it
                for e in page.elements:
                    if not e.dropped:
                        counts[e.style, "layout", hash_of("".join(e.children))] += 1
                for style, text, _, _ in shown:
                    counts[style, "content", hash_of(text)] += 1
                for style in {b[0] for b in shown}:
                    counts[style, "page", 0] += 1
                nodes = sorted(counts.items())
                known = [{"style": k, "parent": up, "depth": depth, "tag": tag} for k, (up, depth, tag) in links(page).items()]
                blocks = [{"style": b[0], "inside": b[3], "text": b[1]} for b in page.main()]
                rows.append((host(url), hash_of(repr(nodes)), [{"style": s, "kind": k, "value": v, "n": n} for (s, k, v), n in nodes], known, blocks))
            site, page, nodes, known, blocks = zip(*rows)
            made = [pa.array(site), pa.array(page, pa.int64()), pa.array(nodes, pa.list_(_NODE)), pa.array(known, pa.list_(_LINK)), pa.array(blocks, pa.list_(_BLOCK))]
            yield pa.record_batch([step.column(ROW), step.column("page_id"), step.column("url"), *made], [ROW, "page_id", "url", "host", "page", "nodes", "links", "blocks"])


def hash_of(text: str) -> int:
    """As xxhash64 of a column has it."""
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The stored table of parsed pages that the tree is made of and the texts are cut from."""
    base = keyed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return stored(mapped(base.select(ROW, "page_id", "url", "html"), _parse, _PARSED), "style-pages", compression="zstd")


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, style, parent, depth, tag, pages, layout, content: the entropies (0 to 1) of each style node over each host's different pages, null
    for nodes whose every element is dropped."""
    different = stored(parsed.where(F.size("nodes") > 0).groupBy("host", "page").agg(F.first("nodes").alias("nodes"), F.first("links").alias("links")), "style-different")  # a page counts once, however many copies a host has
    seen = different.select("host", F.explode("nodes").alias("_n")).select("host", "_n.*").groupBy("host", "style", "kind", "value").agg(F.sum("n").alias("n"))
    n = F.sum("n")
    entropy = F.when(n > 1, (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)).otherwise(1.0)
    by_kind = seen.groupBy("host", "style", "kind").agg(n.alias("n"), entropy.alias("h"))
    value = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    measured = by_kind.groupBy("host", "style").agg(F.coalesce(value("page", "n"), value("layout", "n"), F.lit(0)).alias("pages"), value("layout", "h").alias("layout"), value("content", "h").alias("content"))
    known = different.select("host", F.explode("links").alias("_n")).select("host", "_n.*").groupBy("host", "style").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "tag")])
    return known.join(measured, ["host", "style"], "left")


class Lifted:
    """Largest importance at or below each node of a tree, by doubling: after round i a node knows of 2^i levels below it, and `jumps[i]` has the
    ancestor of each node 2^i levels above it. So a tree of any depth takes as many rounds as the logarithm of its depth."""

    def __init__(self, nodes: DataFrame):
        """nodes: host, style, parent, depth, importance."""
        now = stored(nodes.select("host", "style", "importance", F.when(F.col("depth") > 1, F.col("parent")).alias("jump")), "style-lift")
        depth = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
        self.jumps = []
        for _ in range(max(0, depth - 1).bit_length()):
            self.jumps.append(now.select("host", "style", "jump"))
            above = now.select("host", F.col("style").alias("jump"), F.col("jump").alias("further"))
            pairs = now.where("jump is not null").join(above, ["host", "jump"], "left")
            both = F.array(F.struct("style", "importance", F.col("further").alias("jump")), F.struct(F.col("jump").alias("style"), "importance", F.lit(None).cast("long").alias("jump")))
            every = pairs.select("host", F.explode(both).alias("_n")).select("host", "_n.*").unionByName(now.where("jump is null"))
            now = stored(every.groupBy("host", "style").agg(F.max("importance").alias("importance"), F.max("jump").alias("jump")), "style-lift")
        self.importance = now.select("host", "style", "importance")

    def spread(self, marks: DataFrame, mark: str) -> DataFrame:
        """host, style, mark: the largest mark of each node or any that holds it, of marks (host, style, mark) of some nodes."""
        marks = stored(marks, "style-marks")
        for jumps in self.jumps:
            above = marks.select("host", F.col("style").alias("jump"), F.col(mark))
            below = jumps.where("jump is not null").join(above, ["host", "jump"]).select("host", "style", mark)
            marks = stored(marks.unionByName(below).groupBy("host", "style").agg(F.max(mark).alias(mark)), "style-marks")  # read twice by the next round
        return marks


def low_branches(tree: DataFrame) -> tuple[DataFrame, Lifted]:
    """host, style, tag of low composite importance, and the tree's lifted importance. A leaf has its content's entropy; an inner node its
    layout's and, by BELOW, the mean of what stands right below it, or what is more important anywhere below it."""
    own = F.coalesce("content", "layout")
    below = tree.where(own.isNotNull() & F.col("parent").isNotNull()).groupBy("host", F.col("parent").alias("style")).agg(F.avg(own).alias("below"), F.count("*").alias("children"))
    weight = F.pow(F.lit(BELOW), F.col("children"))
    inner = F.greatest(own, (1 - weight) * F.coalesce("layout", F.lit(0.0)) + weight * F.col("below"))
    node = tree.join(below, ["host", "style"], "left").withColumn("importance", F.when(F.col("children").isNull() | own.isNull(), own).otherwise(inner))
    lifted = Lifted(node)
    low = tree.where(F.col("pages") >= LEAST_PAGES).select("host", "style", "tag").join(lifted.importance.where(F.col("importance") < LEAST_IMPORTANCE), ["host", "style"])
    return low.select("host", "style", "tag"), lifted


def cut_styles(tree: DataFrame, low: DataFrame, lifted: Lifted) -> DataFrame:
    """host, style, inside: nodes of texts under a branch of low importance, and whether that also holds inside an article, where
    headings, paragraphs, lists, tables and figures don't go by themselves."""
    taken = low.where(~F.col("tag").isin(*ARTICLE, "html", "body", "")).select("host", "style", (~F.col("tag").isin(*KEPT_INSIDE)).alias("inside"))
    return lifted.spread(taken, "inside").join(tree.where("content is not null").select("host", "style"), ["host", "style"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page row.

    White space inside a block becomes one space, blocks are joined by newlines. A null or empty html, or one without
    main text, gives the empty text. Pages whose url is null or has no host form a site of their own. Rows that
    repeat a page, its id or its url get a row each, pages of any length are parsed whole. Where all blocks of a page measure low,
    pages are copies and nothing tells template from text: all stay. Other columns are ignored; no rows give no rows.
    """
    parsed = parsed_pages(pages)
    tree = stored(style_tree(parsed), "style-tree")
    cut = cut_styles(tree, *low_branches(tree))
    # Only places of pages and hashes of styles move, until each page has the few of its styles that are cut.
    uses = parsed.select(ROW, "host", F.explode(F.array_distinct("blocks.style")).alias("style"))
    counted = stored(cut.join(uses.groupBy("host", "style").count(), ["host", "style"]), "style-cut")
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    found = join_about(uses, counted, ["host", "style"], "count", total).where("inside is not null")
    styles = [F.collect_list(F.when(F.col("inside"), F.col("style"))).alias("everywhere"), F.collect_list("style").alias("outside")]
    by_page = stored(found.groupBy(ROW).agg(*styles), "style-cut-pages")
    rows = SlotFilter(by_page, ROW).mark(parsed.select(ROW, "page_id", "url", "blocks"), "may_be_cut")
    none = F.lit(None).cast("array<long>")
    named = rows.where("may_be_cut").join(by_page, ROW, "left").unionByName(rows.where("not may_be_cut").withColumns({"everywhere": none, "outside": none}))  # others don't move
    kept = F.filter("blocks", lambda b: ~F.array_contains(F.when(b["inside"], F.col("everywhere")).otherwise(F.col("outside")), b["style"]))
    chosen = F.when(F.col("outside").isNull() | (F.size(kept) == 0), F.col("blocks")).otherwise(kept)
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return named.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
