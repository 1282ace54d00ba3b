"""Main text of web pages by removing what a site repeats.

Each page is read once into blocks of text. Every element subtree that can be template gets a hash of its tags and text, and
the blocks remember the hashes of the subtrees they lie in. Spark counts, per host, on how many different pages a
subtree occurs; those on many pages of the host are deleted with all their blocks. Then the marks that html itself
gives decide about what is left: only the article (or main part) counts if there is one, without menus, headers, footers,
sidebars, notices, adverts, forms, scripts and reader comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen
from tallyloom.llm.urltree import host_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td
textarea tfoot th thead title tr ul video""".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
ROOTS = frozenset("html body article main".split())
#: An opening tag that ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
ASIDE = frozenset("""head title script style noscript template nav header footer aside form button select textarea input iframe svg
menu dialog object canvas audio video option""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("""ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related
share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
COMMENTS = frozenset(("comment", "comments", "disqus"))


@dataclass(frozen=True)
class SiteLimits:
    """A subtree is template if it is on at least ``pages`` different pages and ``share`` of the host's different pages."""
    pages: int = 5
    share: float = 0.3


class _Node:
    __slots__ = ("tag", "off", "kept", "hash", "slot")

    def __init__(self, tag: str, off: bool, kept: bool, slot: int):
        self.tag, self.off, self.kept, self.slot = tag, off, kept, slot
        self.hash = xxhash.xxh64(tag)


class PageReader(HTMLParser):
    """Blocks of a page in order: [text, slots of the subtrees around it, off, inside article, inside main]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Node] = []
        self.hashes: list[int] = []
        self.blocks: list[tuple[str, list[int], bool, bool, bool]] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            if tag in ENDS:
                self._end_open(ENDS[tag])
            elif any(n.tag == "p" for n in self.stack):
                self._end_open({"p"})
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        off = bool(self.stack and self.stack[-1].off) or self._aside(tag, dict(attrs))
        inside = any(n.tag in ("article", "main") for n in self.stack)
        if tag in ROOTS or (inside and tag in PARAGRAPH) or tag not in BLOCK:
            slot = -1
        else:
            slot = len(self.hashes)
            self.hashes.append(0)
        self.stack.append(_Node(tag, off, inside, slot))

    def _aside(self, tag: str, attrs: dict[str, str | None]) -> bool:
        in_article = any(n.tag == "article" for n in self.stack)
        if tag in ASIDE:
            return not (tag == "header" and in_article)
        if tag not in BLOCK and tag not in ("span", "ins", "a", "b", "i", "small"):
            return False
        names = set(re.split("[^a-z0-9]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return bool(names & COMMENTS)
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
        return hidden or bool(names & NAMES) or (attrs.get("role") or "").lower() in ROLES

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            self._flush()
        if any(n.tag == tag for n in self.stack):
            while self._pop().tag != tag:
                pass

    def _end_open(self, tags: set[str]) -> None:
        """Close an open element of these kinds, unless a list, table or other container lies in between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._pop()
            elif self.stack[k].tag in BLOCK:
                return

    def _pop(self) -> _Node:
        node = self.stack.pop()
        digest = node.hash.intdigest()
        if node.slot >= 0:
            self.hashes[node.slot] = digest - (1 << 63)
        if self.stack:
            self.stack[-1].hash.update(digest.to_bytes(8, "little"))
        return node

    def handle_data(self, data: str) -> None:
        if not self.stack or self.stack[-1].tag not in ("script", "style"):
            self.parts.append(data)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if not text:
            return
        tags = [n.tag for n in self.stack]
        if self.stack:
            self.stack[-1].hash.update(text.encode("utf-8", "surrogatepass"))
        off = bool(self.stack and self.stack[-1].off)
        if "header" in tags and "article" in tags[:tags.index("header")]:
            off = off or not any(re.fullmatch("h[1-6]", t) for t in tags)
        self.blocks.append((text, [n.slot for n in self.stack if n.slot >= 0], off, "article" in tags, "main" in tags))

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.stack:
            self._pop()


def read_page(html: str | None) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """The blocks that the page's own marks leave, as (text, hashes of the subtrees around), and all subtree hashes."""
    if not html:
        return [], []
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match("<[a-zA-Z/!]", html[cut:]):
        html = html[:cut]  # a tag that the end of the page cut off
    reader = PageReader()
    reader.feed(html)
    reader.finish()
    blocks = [b for b in reader.blocks if not b[2]]
    if any(b[3] for b in blocks):
        blocks = [b for b in blocks if b[3]]
    elif any(b[4] for b in blocks):
        blocks = [b for b in blocks if b[4]]
    return [(text, [reader.hashes[s] for s in slots]) for text, slots, *_ in blocks], sorted(set(reader.hashes))


PAGE = "struct<blocks: array<struct<text: string, within: array<bigint>>>, seen: array<bigint>>"


def _read(html: Column) -> Column:
    @F.pandas_udf(PAGE)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            out = []
            for page in pages:
                blocks, seen = read_page(page)
                out.append(([{"text": t, "within": w} for t, w in blocks], seen))
            yield pd.DataFrame(out, columns=["blocks", "seen"])
    return of(html)


def template_subtrees(rows: DataFrame, limits: SiteLimits = SiteLimits()) -> DataFrame:
    """``host, template``: the hashes of the subtrees that recur on each host. ``rows`` has ``host``, ``page`` (a digest, so that
    copies of a page count once) and ``seen``. A page has few subtrees, so few can be on a large share of pages."""
    each = rows.select("host", "page", F.explode("seen").alias("hash")).distinct()
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= limits.pages)
    sizes = rows.select("host", "page").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"))
    often = counts.join(sizes, F.col("host") == F.col("h")).filter(F.col("n") >= F.lit(limits.share) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("hash").alias("template"))


def extract(pages: DataFrame, limits: SiteLimits = SiteLimits(), page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. Null and empty html, and pages of nothing but template, give an empty
    text. A url without a host puts its page on the host of all such pages. Repeated rows come back repeated."""
    rows = frozen(pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("page"), _read(F.col(html)).alias("p")).select(
        "page_id", "url", "host", "page", "p.*"), "pages")
    template = frozen(template_subtrees(rows, limits).withColumnRenamed("host", "of_host"), "site-templates")
    joined = rows.join(template, F.col("host") == F.col("of_host"), "left")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["within"], F.col("template")), F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
