"""What a crawl of kept listing pages finds, and the relevant articles among it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions import words
from fathom.operators.series import keep_first
from fathom.sources.pages import articles
from fathom.sources.scratch import written


def discovered(cards: DataFrame, categories: list[str], most: int = 15) -> DataFrame:
    """Of cards (category, page, url, ...) those that a crawl meets first: categories in the
    given order, pages from 1 to `most`, and a category ends at its first page that has no address that
    is new to the crawl. Each address once, from where it was met; of equal ones on a page the
    first headline. A category is a step, as what it finds is not new to the next; all
    its pages are worked through at once."""
    kept = None
    for category in dict.fromkeys(categories):
        rows = cards.where((F.col("category") == category) & F.col("page").between(1, most))
        rows = rows if kept is None else rows.join(kept.select("url"), "url", "left_anti").select(cards.columns)
        first = keep_first(rows, ["url"], ["page", "headline"])
        fresh = first.agg(F.collect_set(F.col("page").cast("int")).alias("fresh"))  # `most` numbers at most
        stop = fresh.select(F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most + 1)), "fresh"))).scalar()
        found = written(first.where(F.col("page") < stop), "crawled")
        kept = found if kept is None else kept.union(found)
    return cards.limit(0) if kept is None else kept


def relevant_articles(cards: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    """Of discovered cards (url, headline, ...) those with a relevant headline, with its score, topics
    and terms, beside what is read from their pages (url, html), and topics and terms of headline and
    body together. A card without a page has nulls there."""
    rows = cards.where(T.relevant(F.col("headline"), least))
    terms = sorted({*words.SITE_TERMS, *words.DRIVER_TERMS})
    listed = lambda text: (F.array_join(T.topics(text, words.SITE_TOPICS), ","), F.array_join(T.matched(T.clean(text), terms), ","))
    topics, matches = listed(F.col("headline"))
    rows = rows.select("*", T.headline_score(F.col("headline")).alias("headline_score"), topics.alias("headline_topics"), matches.alias("headline_keyword_matches"))
    wanted = pages.join(rows.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("page_id"), "url", "html")
    read = articles(keep_first(wanted, ["url"], ["html"])).drop("page_id")
    whole = F.concat_ws("\n", "headline", F.coalesce("body", F.lit("")))
    topics, matches = (F.when(F.col("body").isNotNull(), c) for c in listed(whole))
    return rows.join(read, "url", "left").withColumns({"fulltext_topics": topics, "fulltext_keyword_matches": matches})
