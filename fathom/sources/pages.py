"""Articles and links out of raw HTML pages."""

from __future__ import annotations

import datetime as dt
import json
import re
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import any_term
from fathom.operators.series import keep_first
from fathom.sources.html import Element, tree
from fathom.sources.scratch import bounded_batches


#: Parts of addresses that no article has, and of paragraphs that are no text.
NO_ARTICLE = ["/search", "/goto/", "/feed/", "/newsfeeds/", "/auth/", "/account/"]
NO_TEXT = ["advertisement", "click here", "related:", "read more"]


def whole_address(href: Column, base: str) -> Column:
    """An address with scheme and host, relative ones below `base`."""
    site = base.rstrip("/")
    return F.when(href.rlike("^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(site.split("//")[0]), href)).when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(F.concat(F.lit(site + "/"), href))


def article_links(found: DataFrame, base: str) -> DataFrame:
    """links() that look like articles, with whole addresses, the first of each page and address."""
    rows = found.withColumn("url", whole_address(F.col("href"), base)).where(F.col("url").endswith(".html") & ~any_term(F.col("url"), NO_ARTICLE))
    return keep_first(rows, ["page_id", "url"], ["title"]).select("page_id", "url", "title")


def linked_date(html: Column) -> Column:
    """datePublished, or else dateCreated, of the first JSON-LD script that has one."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?s)<script[^>]*type=["']application/ld[+]json["'][^>]*>(.*?)</script>"""), F.lit(1))
    dates = F.transform(scripts, lambda s: F.coalesce(F.get_json_object(s, "$.datePublished"), F.get_json_object(s, "$.dateCreated")))
    return F.get(F.filter(dates, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def links(pages: DataFrame, least: int = 20) -> DataFrame:
    """(page_id, href, title): anchors whose text has `least` characters or more."""
    anchors = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<a [^>]*>.*?</a>"), F.lit(0))).alias("a"))
    title = F.trim(F.regexp_replace(F.regexp_replace("a", r"<[^>]*>", " "), r"\s+", " "))
    return anchors.select("page_id", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), title.alias("title")).where(F.length("title") >= least)


def headline(pages: DataFrame) -> DataFrame:
    """(page_id, title, n_paragraphs): the first h1, and the paragraphs."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", ""))
    return pages.select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>.*?</p>"), F.lit(0))).cast("long").alias("n_paragraphs"))


def _iso(value: str) -> str:
    """An ISO or RFC 2822 time as ISO text; other text as it is."""
    try:
        return dt.datetime.fromisoformat(value.replace("Z", "+00:00")).isoformat()
    except ValueError:
        pass
    try:
        return parsedate_to_datetime(value).isoformat()
    except ValueError:
        return value


def _linked(page: Element) -> str | None:
    """The date of the first JSON-LD script that has one."""
    for script in page.all(lambda e: e.tag == "script" and e.attrs.get("type") == "application/ld+json"):
        try:
            data = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        found = (data.get("datePublished") or data.get("dateCreated")) if isinstance(data, dict) else None
        if found:
            return _iso(str(found))
    return None


def _meta(page: Element, *wanted: tuple[str, str]) -> str | None:
    """The content of the first of the wanted meta tags that the page has; null if it is empty."""
    for key, value in wanted:
        tag = page.first(lambda e: e.tag == "meta" and e.attrs.get(key) == value)
        if tag is not None:
            return tag.attrs.get("content", "").strip() or None
    return None


#: Classes of a container, and a name before a date in the text that is shown.
CONTAINER = re.compile(r"(article|content|post|entry|story)", re.I)
BYLINE = re.compile(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\|\s*([A-Za-z]{3}\s+\d{1,2},\s+\d{4}.*)")


def _article(html: str | None, least: int) -> tuple[str | None, ...]:
    page = tree(html)
    head = page.first(lambda e: e.tag == "h1")
    author = _meta(page, ("name", "author"), ("property", "article:author"))
    published = _meta(page, ("property", "article:published_time"), ("name", "pubdate"), ("name", "date"))
    published = _iso(published) if published else _linked(page)
    trail = lambda e: e.tag == "nav" or bool({"breadcrumb", "breadcrumbs"} & set(e.classes))
    crumbs = [t for t in (a.text() for a in page.all(lambda e: e.tag == "a" and e.inside(trail))) if t]
    container = page.first(lambda e: e.tag == "article") or page.first(lambda e: e.tag == "div" and any(CONTAINER.search(c) for c in e.classes)) or page.first(lambda e: e.tag == "main") or page
    parts = [p.text() for p in container.all(lambda e: e.tag == "p")]
    body = "\n".join(p for p in parts if len(p) >= least and not any(x in p.lower() for x in NO_TEXT))
    if not author or not published:
        line = BYLINE.search(page.text("\n"))
        if line:
            author, published = author or line[1].strip(), published or line[2].strip()
    return head.text() if head is not None else None, author, published, " > ".join(crumbs[-3:]) or None, body


def articles(pages: DataFrame, least: int = 40) -> DataFrame:
    """(page_id, url, title, author, published_at, section, body) of each page: the first h1; author
    and time of meta tags, else the time of JSON-LD, else both from a shown line "Name | Mon 1, 2024";
    the last three breadcrumbs; the paragraphs of `least` characters or more, without what is no
    text, of the first article, else of the first div with a container's class, else of main, else of
    the page. A null page has nulls and an empty body."""

    bounded_batches(pages.sparkSession)

    @F.pandas_udf("title string, author string, published_at string, section string, body string")
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_article(text, least) for text in html], columns=["title", "author", "published_at", "section", "body"])

    return pages.select("page_id", "url", read("html").alias("r")).select("page_id", "url", "r.*")


def listing(pages: DataFrame, base: str, least: int = 20) -> DataFrame:
    """(page_id, url, title, excerpt): the article links of listing pages, anchors whose text has
    `least` characters or more and whose whole address looks like an article's, the first of each
    page and address. excerpt is the text of the element around the anchor where it says more."""

    bounded_batches(pages.sparkSession)

    @F.pandas_udf("array<struct<href:string,title:string,excerpt:string>>")
    def read(html: pd.Series) -> pd.Series:
        out = []
        for text in html:
            found = []
            for a in tree(text).all(lambda e: e.tag == "a" and "href" in e.attrs):
                title = a.text()
                if len(title) >= least:
                    around = a.parent.text()
                    found.append({"href": a.attrs["href"].strip(), "title": title, "excerpt": around if len(around) > len(title) else None})
            out.append(found)
        return pd.Series(out)

    rows = pages.select("page_id", F.posexplode(read("html")).alias("at", "a")).select("page_id", "at", "a.*").withColumn("url", whole_address(F.col("href"), base))
    rows = rows.where(F.col("url").startswith("http") & F.col("url").endswith(".html") & ~any_term(F.col("url"), NO_ARTICLE))
    return keep_first(rows, ["page_id", "url"], ["at"]).select("page_id", "url", "title", "excerpt")
