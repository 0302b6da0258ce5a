"""Anchors of HTML pages with their nearest container, by a tokenizer of tags and a stack of open elements (SRC-5, STR-14, STR-15, FLT-7).

Tags, attributes (quoted or not), comments and entities are told apart by Python's ``html.parser``, page by page in Arrow
batches. The stack tells which container an anchor stands in: elements that are never closed end where the next of their
kind begins or their parent ends. Text is kept once, as a list of pieces, and an element is a range of it.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.functions.text import absolute_url, is_pdf

# Elements that hold one item of a page.
CONTAINERS = ("li", "p", "div", "tr", "article", "section")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(("script", "style", "template"))
#: An element of the key ends an open one of these kinds, unless one of the second list stands between.
ENDS = {"li": (("li",), ("ul", "ol")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "a": (("a",), ())}
ENDS |= {tag: (("p",), ("li", "td", "th", "div", "section", "article")) for tag in ("p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3")}


class Page(HTMLParser):
    """anchors: [href, first piece, last piece + 1, container's first, container's last + 1]; named: the same ranges of h1, page titles and titles."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces, self.open, self.anchors, self.named = [], [], [], {"h1": None, "page-title": None, "title": None}
        self.feed(html)
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        """Close all open elements from ``depth`` on."""
        while len(self.open) > depth:
            self.open.pop()[1][1] = len(self.pieces)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            kinds, walls = ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in walls:
                    break
                if self.open[i][0] in kinds:
                    self._end(i)
        span, own = [len(self.pieces), None], {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        for name, fits in (("h1", tag == "h1"), ("page-title", "page-title" in own.get("class", "").split()), ("title", tag == "title")):
            if fits and self.named[name] is None:
                self.named[name] = span
        if tag == "a" and "href" in own:
            near = next((s for t, s in reversed(self.open) if t in CONTAINERS), span)
            self.anchors.append((own["href"].strip(), span, near))
        if tag in VOID:
            span[1] = len(self.pieces)
        else:
            self.open.append((tag, span))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._end(i)
                return

    def handle_data(self, data):
        if (text := " ".join(data.split())) and not any(t in UNSEEN for t, _ in self.open[-1:]):
            self.pieces.append(text)

    def text(self, span) -> str:
        return " ".join(self.pieces[span[0] : span[1]]) if span else ""

    def name(self) -> str:
        """STR-14: the first that isn't empty of the first heading, page title and title."""
        return next((t for t in map(self.text, self.named.values()) if t), "")


def anchors(pages: DataFrame, html: str, key: str = "page_id", most: int = 200) -> DataFrame:
    """SRC-5, STR-14, STR-15: (key, pos, href, text, near, name) of every anchor with a href: its text, ``most`` characters of the text of its nearest container, and the page's name.

    Null and empty pages have none; references are unescaped and trimmed, empty ones stay out.
    """

    def run(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                page = Page(raw or "")
                found = [(pos, href, page.text(own), page.text(near)[:most]) for pos, (href, own, near) in enumerate(page.anchors) if href]
                if found:
                    pos, href, text, near = zip(*found, strict=True)
                    same = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(found))
                    cols = [same, pa.array(pos, pa.int32()), *(pa.array(c, pa.string()) for c in (href, text, near)), pa.array([page.name()] * len(found), pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "pos", "href", "text", "near", "name"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(html).cast("string")).mapInArrow(run, f"key {kind}, pos int, href string, text string, near string, name string")
    return out.withColumnRenamed("key", key)


def links(pages: DataFrame, base: str, html: str, keep=is_pdf, key: str = "page_id") -> DataFrame:
    """SRC-5, FLT-7: (key, pos, url, text) of anchors that ``keep`` takes, absolute, first of each url within a page."""
    page = F.struct(F.col(key).alias("k"), F.col(base).alias("base"))
    a = anchors(pages.select(page.alias("_page"), html), html, "_page").filter(keep(F.col("href")))
    a = a.select(F.col("_page.k").alias(key), "pos", absolute_url(F.col("_page.base"), F.col("href")).alias("url"), "text")
    return a.withColumn("rn", F.row_number().over(Window.partitionBy(key, "url").orderBy("pos"))).filter("rn = 1").drop("rn")
