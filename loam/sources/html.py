"""Web pages as rows of text and metadata: one pass over each page's tokens, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.simhash import fingerprint
from loam.functions.urls import host, normalize, resolve_one
from loam.runtime import text_batches
from loam.schemas import PAGE, PARSED

MAX_BYTES, MAX_LINKS = 10 << 20, 100
TYPES = ["text/html", "text/plain", "application/pdf"]
#: Text inside these is left out.
SKIPPED = frozenset("aside canvas embed footer form header iframe input label nav noscript option script select style svg".split())


class _Reader(HTMLParser):
    """Gathers a page's fields while tokens pass; the flags are switches, not depths."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "iframe", "noscript", "noembed", "noframes", "xmp")

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.title = self.og_title = self.description = self.canonical = self.favicon = ""
        self.parts: list[str] = []
        self.links: dict[str, None] = {}
        self.english, self.in_title, self.in_body, self.skipping = True, False, False, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        get = lambda name: next((v or "" for k, v in attrs if k == name), "")
        if tag in SKIPPED:
            self.skipping = True
        if tag == "html":
            self.english = get("lang").startswith("en")
        elif tag == "title":
            self.in_title = True
        elif tag == "body":
            self.in_body = True
        elif tag == "meta":
            content = get("content")
            if content and (get("name") == "description" or get("property") == "og:description"):
                self.description = content
            if content and get("property").lower() == "og:title":
                self.og_title = content
        elif tag == "link":
            if get("rel") == "canonical" and get("href"):
                self.canonical = get("href")
            if not self.favicon and "icon" in get("rel").lower().split():
                self.favicon = get("href")
        elif tag == "a" and len(self.links) < MAX_LINKS and get("href"):
            if link := resolve_one(self.base, get("href")):
                self.links.setdefault(link)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        was_title, was_body = self.in_title, self.in_body
        self.handle_starttag(tag, attrs)
        self.in_title, self.in_body = was_title, was_body

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = False
        if tag == "title":
            self.in_title = False
        elif tag == "body":
            self.in_body = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data + " "
        elif self.in_body and not self.skipping:
            if words := " ".join(data.replace("\t\n", "").split()):
                self.parts.append(words + " ")


def parse_page(html: str | None, url: str | None, status: int | None = 200) -> dict | None:
    """The fields of one page; null for a page that is too large.

    Pages without a 2xx status, or without html, are empty and not crawled; a page that ends inside its title
    keeps nothing but its links.
    """
    empty = {"title": "", "og_title": "", "favicon": "", "description": "", "text": "", "links": [], "found_canonical": "", "in_english": False, "has_been_crawled": False}
    if html is None or status is None or not 200 <= status <= 299:
        return empty
    if len(html.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return None
    r = _Reader(url)
    r.feed(html)
    r.close()
    links = list(r.links)
    if r.title and r.in_title:
        return empty | {"links": links, "in_english": True}
    favicon = (resolve_one(url, r.favicon) or "") if r.favicon else ""
    return {
        "title": r.title, "og_title": r.og_title, "favicon": favicon, "description": "" if r.description == r.title else r.description, "text": "".join(r.parts), "links": links,
        "found_canonical": r.canonical, "in_english": r.english, "has_been_crawled": True,
    }


def admitted_type(content_type):
    """Whether a Content-Type header, parameters aside, is one that is fetched."""
    return F.coalesce(F.trim(F.split_part(F.lower(content_type), F.lit(";"), F.lit(1))).isin(TYPES), F.lit(False))


def written_title(html: Column) -> Column:
    """The first title of one line as it is spelled, and a space: of character references only &amp; is decoded; without one, a space."""
    return F.concat(F.replace(F.regexp_extract(html, "(?d)<title>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&")), F.lit(" "))


def parse_pages(pages: DataFrame, int8_wrap: bool = False, prints: bool = True) -> DataFrame:
    """pages(page_id, url, html [, status_code, fetched_at]) as the PAGE table; oversized pages are left out. Without prints content_hash is null."""
    text_batches(pages.sparkSession)
    kind = pa.struct([(f.name, pa.list_(pa.string()) if f.name == "links" else pa.bool_() if f.dataType.simpleString() == "boolean" else pa.string()) for f in PARSED])

    def run(batches):
        # one opaque step: as an expression, filters on what it gives would have pages parsed again
        for b in batches:
            rows = [parse_page(*x) for x in zip(b["html"].to_pylist(), b["url"].to_pylist(), b["status_code"].to_pylist())]
            b = b.drop_columns("html").filter(pa.array([r is not None for r in rows], pa.bool_()))
            rows = [r for r in rows if r is not None]
            hashes = np.array([fingerprint(r["text"], int8_wrap) for r in rows], np.uint64).view(np.int64) if prints else pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, *pa.array(rows, kind).flatten(), hashes if isinstance(hashes, pa.Array) else pa.array(hashes)], [*b.schema.names, *[f.name for f in kind], "content_hash"])

    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp")
    p = pages.select("page_id", "url", "html", status.cast("int").alias("status_code"), at.alias("crawled_at"))
    p = p.mapInArrow(run, T.StructType([f for f in p.schema if f.name != "html"] + PARSED.fields + [T.StructField("content_hash", T.LongType())]))
    canonical = normalize(F.col("found_canonical"))
    values = {
        "request_url": F.col("url"), "final_url": F.col("url"), "host": host(F.col("url")),
        "found_canonical": F.when(canonical != "", canonical), "resolved_canonical": F.lit(False), "duplicate_of": F.lit(None).cast("long"),
    }
    for name in ("og_title", "favicon"):
        values[name] = F.when(F.col(name) != "", F.col(name))
    return p.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PAGE])
