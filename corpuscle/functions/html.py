"""Pages, feeds and indexes: links, titles, dates, main text.

Expressions are built-in regular-expression functions; only what depends on nesting needs a parser and is an Arrow
function.
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import first_known, path_day

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements that are no content, words of content classes, path segments and endings that are no posts.
CHROME = frozenset("nav header footer script style aside noscript iframe form".split())
CONTENT_CLASS = r"\b(post|entry|content|article|body|text)\b"
NO_POST = r"(?i)/(tag|category|author|feed|rss|page|wp-content|cdn|search|about|contact|signin|login|register|subscribe|privacy|terms|archive)(/|$)"
NO_PAGE = r"(?i)\.(atom|rss|xml|pdf|zip|png|jpg|jpeg|gif|css|js)$"


def title(html) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def absolute(href, base) -> Column:
    """Link without query, fragment and trailing slash, absolute and https."""
    bare = F.regexp_replace(F.regexp_replace(href, r"[?#].*$", ""), r"/+$", "")
    origin = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    full = F.when(bare.rlike("^https?://"), bare).when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).when(bare.startswith("/"), F.concat(origin, bare)).when(bare == "", None).otherwise(F.concat(F.regexp_replace(base, r"/[^/]*$", ""), F.lit("/"), bare))
    return F.regexp_replace(full, "^http://", "https://")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link) for each distinct link of each page."""
    hrefs = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    return hrefs.where(~F.col("href").rlike("(?i)^(mailto|javascript|tel):")).select("url", absolute(F.col("href"), F.col("url")).alias("link")).where("link is not null").distinct()


def host(url) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)), r"^www\.", "")


def blocked(url, hosts: list[str]) -> Column:
    """Host equals or lies under one of the blocked ones."""
    return F.exists(F.array(*[F.lit(h) for h in hosts]), lambda b: (host(url) == b) | F.endswith(host(url), F.concat(F.lit("."), b)))


def page_date(html, url=None, fallback=None) -> Column:
    """Fallback chain: unix attribute, time element, meta properties, JSON-LD, path of the address, given date."""
    get = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    unix = F.date_format(F.timestamp_seconds(F.try_to_number(get(r'data-timestamp="(\d{9,10})"'), F.lit("9999999999")).cast("bigint")), "yyyy-MM-dd")
    day = lambda p: F.substring(get(p), 1, 10)
    chain = [
        unix,
        day(r'(?i)<time[^>]*datetime="([^"]+)"'),
        *[day(rf'(?i)<meta[^>]*(?:property|name)="{m}"[^>]*content="([^"]+)"') for m in ("article:published_time", "date", "pubdate", "dc.date", "og:published_time")],
        *[day(rf'"{k}"\s*:\s*"([^"]+)"') for k in ("datePublished", "dateCreated", "dateModified")],
    ]
    if url is not None:
        chain.append(path_day(url))
    if fallback is not None:
        chain.append(fallback)
    return first_known(*chain)


def _has_class(pattern: str):
    return lambda tag, a: tag == "div" and bool(re.search(pattern, a.get("class") or "", re.I))


#: Tests of (tag, attributes) for the main element, best first; of each test the first element of the page counts.
MAIN = (lambda tag, a: tag == "article", lambda tag, a: a.get("role") == "main", lambda tag, a: tag == "main", _has_class(CONTENT_CLASS), lambda tag, a: tag == "body")
TRANSCRIPT = (lambda tag, a: a.get("data-purpose") == "transcript-body", _has_class("transcript"))


class _First(HTMLParser):
    """Text of the first element that passes the best of several tests, chrome left out."""

    def __init__(self, tests) -> None:
        super().__init__(convert_charrefs=True)
        self.tests, self.stack, self.skip = tests, [], 0
        self.found: dict[int, list[str]] = {}
        self.whole: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a, ranks = dict(attrs), []
        self.skip += tag in CHROME
        if not self.skip:
            ranks = [k for k, test in enumerate(self.tests) if k not in self.found and test(tag, a)]
            for k in ranks:
                self.found[k] = []
        self.stack.append((tag, ranks))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.skip -= sum(t in CHROME for t, _ in self.stack[i:])
                del self.stack[i:]
                break

    def handle_data(self, data):
        part = data.strip()
        if self.skip or not part:
            return
        self.whole.append(part)
        for _, ranks in self.stack:
            for k in ranks:
                self.found[k].append(part)

    def text(self) -> str:
        parts = next((self.found[k] for k in sorted(self.found)), self.whole)
        return re.sub(" {2,}", " ", " ".join(parts)).strip()


def extract(html: str | None, tests=MAIN) -> str | None:
    if html is None:
        return None
    p = _First(tests)
    p.feed(html)
    p.close()
    return p.text()


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    return html.map(extract)


@F.pandas_udf(T.StringType())
def transcript_text(html: pd.Series) -> pd.Series:
    """Text of the transcript container, all blanks collapsed; of the main element where there is none."""
    return html.map(lambda x: None if x is None else " ".join(extract(x, (*TRANSCRIPT, *MAIN)).split()))


class _Links(HTMLParser):
    """Links with the text of the element around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str], list[str]]] = []
        self.out: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        href = dict(attrs).get("href")
        if tag == "a" and href and self.stack:
            self.out.append((href, self.stack[-1][1]))
        self.stack.append((tag, [], []))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        for _, text, _ in self.stack:
            text.append(data.strip())


def _near(html: str | None) -> list[tuple[str, str]]:
    p = _Links()
    p.feed(html or "")
    p.close()
    return [(href, " ".join(" ".join(text).split())) for href, text in p.out]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("near", T.StringType())])))
def links_with_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: [{"href": h, "near": t} for h, t in _near(x)])


def is_post(link, base) -> Column:
    """Whether a link of the listing page ``base`` looks like a post of the same site."""
    domain = F.regexp_extract(base, r"^(?:https?://)?([^/]+)", 1)
    own = F.regexp_replace(F.regexp_replace(base, r"/+$", ""), "^http://", "https://")
    return F.contains(link, domain) & (link != own) & ~link.rlike(NO_POST) & ~link.rlike(NO_PAGE)


def snapshot_url(base: str, timestamp, original) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), timestamp, F.lit("/"), original)


def sitemap(xml, fragment: str) -> Column:
    """All <loc> values with ``fragment`` in them."""
    return F.filter(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), 1), lambda u: F.contains(u, F.lit(fragment)))


def paged_total(body) -> Column:
    """``total`` of a paged answer, an integer or an object with ``value``."""
    return F.coalesce(F.expr(f"try_cast(get_json_object({body}, '$.total') AS bigint)"), F.expr(f"try_cast(get_json_object({body}, '$.total.value') AS bigint)"))


def transcript(manual, generated) -> Column:
    """Joined chunks of the manual captions, else of the generated ones."""
    return F.array_join(F.transform(F.coalesce(manual, generated), lambda c: c["text"]), " ")


def preprint_id(url) -> Column:
    """Identifier address without its version suffix."""
    return F.regexp_replace(url, r"v\d+$", "")



def exhibit(html, kind: str = "EX-99.1") -> Column:
    """Link in the row of a filing index whose type cell is ``kind``."""
    row = F.regexp_extract(html, rf"(?is)(<tr>(?:(?!</tr>).)*<td[^>]*>\s*{kind.replace('.', '[.]')}\s*</td>(?:(?!</tr>).)*</tr>)", 1)
    return F.nullif(F.regexp_extract(row, r'href="([^"]+)"', 1), F.lit(""))
