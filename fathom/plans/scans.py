"""Queries of readers: files of the shapes that services give, made of the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fathom.operators import articles as A
from fathom.operators import matrix as M
from fathom.operators import sentiment as N
from fathom.operators import series as S
from fathom.plans import fixtures as X
from fathom.plans import queries as Q
from fathom.plans.fixtures import WEEK, with_tables
from fathom.plans.queries import query, r, rounded
from fathom.sources import files, pages, scan, tables
from fathom.sources.scratch import scratch, written
from fathom.streaming import ingest


def _dated(spark, d):
    """Articles of documents with an importance and a topic."""
    rows = X.articles(spark, d)
    level = F.element_at(F.array(*map(F.lit, scan.IMPORTANCE)), (F.col("id") % 3 + 1).cast("int"))
    return rows.select("id", F.col("date").alias("created"), F.col("headline").alias("title"), "body", F.coalesce("source", F.lit("none")).alias("topic"), level.alias("importance"))


@query("articles", "SELECT id, created, coalesce(title, '') AS title, length(body) AS n_chars, topic, importance FROM (SELECT id, date AS created, headline AS title, body, coalesce(source, 'none') AS topic, ['low', 'medium', 'high'][(id % 3 + 1)::INT] AS importance FROM articles) WHERE created BETWEEN DATE '2024-03-10' AND DATE '2024-08-20' AND importance IN ('medium', 'high')")
def S1_S3_scan_of_pages(spark, d):
    """Windows, importance and topics as pages of files; the filters open some of them only."""
    path = scratch(spark, "pages")
    scan.write_article_pages(_dated(spark, d), path, "2024-01-01")
    found = scan.scan(spark, scan.ArticlePages, path)
    found = found.where((F.col("created") >= dt.date(2024, 3, 10)) & (F.col("created") <= dt.date(2024, 8, 20)) & F.col("importance").isin("medium", "high"))
    return found.select("id", "created", F.coalesce("title", F.lit("")).alias("title"), F.length("body").cast("long").alias("n_chars"), "topic", "importance")


@query("price macro", "SELECT series, date, round(value, 6) AS value FROM (SELECT 'close' AS series, date, close AS value FROM price UNION ALL SELECT 'stocks', date, stocks FROM macro) WHERE value IS NOT NULL")
def S15_series_pages(spark, d):
    """Two weekly series as pages at offsets, read until their totals."""
    rows = X.price(spark, d).select(F.lit("close").alias("series"), "date", F.col("close").alias("value")).union(X.macro(spark, d).select(F.lit("stocks"), "date", "stocks"))
    path = scratch(spark, "series")
    scan.write_series_pages(rows, path, 100)
    return rounded(scan.scan(spark, scan.SeriesPages, path))


@query("price", "SELECT date, round(close, 6) AS close FROM price WHERE date >= DATE '1994-01-01'")
def S13_S14_price_files(spark, d):
    """Weekly prices written as CSV and read back from a date on."""
    path = scratch(spark, "prices")
    files.write_table(X.price(spark, d).select(F.col("date").cast("string").alias("date"), "close"), path, "csv")
    return rounded(tables.prices(spark, path, first="1994-01-01"))


_MONTHS = "m AS (SELECT url, page_id, CASE WHEN page_id % 7 <> 3 THEN DATE '2024-01-01' + (page_id % 364)::INT END AS lastmod, CASE WHEN page_id % 7 = 3 THEN (page_id % 12 + 1)::INT ELSE month(DATE '2024-01-01' + (page_id % 364)::INT) END AS month FROM pages)"


@query(sql=f"WITH {_MONTHS} SELECT DISTINCT 'https://site.com/' || CASE WHEN page_id % 3 = 0 THEN 'World/' ELSE 'Energy/' END || page_id || CASE WHEN page_id % 5 = 0 THEN '.htm' ELSE '.html' END AS url, lastmod FROM m WHERE month BETWEEN 3 AND 5 AND page_id % 5 <> 0 AND page_id % 3 <> 0 AND (lastmod IS NULL OR lastmod BETWEEN DATE '2024-03-05' AND DATE '2024-05-20')")
def S21_S22_sitemaps(spark, d):
    """Monthly sitemaps of the pages: those of months out of range aren't opened."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 364).cast("int"))
    rows = X.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 != 3, day).alias("day"))
    month = F.when(F.col("page_id") % 7 == 3, (F.col("page_id") % 12 + 1).cast("int")).otherwise(F.month("day"))
    part = F.concat(F.when(F.col("page_id") % 3 == 0, "/World/").otherwise("/Energy/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, ".htm").otherwise(".html"))
    path = scratch(spark, "sitemaps")
    files.write_sitemaps(rows.select(part.alias("loc"), F.col("day").cast("string").alias("lastmod"), F.lit(2024).alias("year"), month.alias("month")), path)
    return files.sitemap_urls(spark, path, "site.com", "2024-03-05", "2024-05-20", ["/Energy/"], ["/World/"])


@query("articles", "SELECT s.start, s.end_ AS \"end\", count(a.id) AS n FROM (SELECT start::DATE AS start, least(start::DATE + 30, b)::DATE AS end_ FROM (SELECT unnest(generate_series(a, b, INTERVAL 31 DAYS)) AS start, b FROM (SELECT min(date) AS a, max(date) AS b FROM articles))) s LEFT JOIN articles a ON a.date BETWEEN s.start AND s.end_ GROUP BY ALL")
def S4_windows_of_articles(spark, d):
    """Windows that cover the articles' days, with their numbers of articles."""
    return A.by_window(X.articles(spark, d).select("id", "date"))


@query()
def S17_listing(spark, d):
    return pages.listing(X.table(spark, d, "pages"), "https://site.com", 5)


_SCRAPED = """s AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id END AS title, 'H' || page_id AS headline, DATE '2024-01-01' + (page_id % 364)::INT AS day, page_id FROM pages)"""


@query(sql=f"WITH {_SCRAPED} SELECT ('0x' || substr(md5(url), 1, 15))::BIGINT AS id, coalesce(title, headline) AS title, headline AS teaser, url, day AS date FROM s WHERE page_id % 6 <> 5")
def K5_F14_scraped(spark, d):
    """Scraped pages whose dates come in five shapes, or in none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 364).cast("int"))
    shapes = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-dd'T'10:30:00'Z'"), F.date_format(day, "EEE, dd MMM yyyy '10:30:00 +0000'"), F.date_format(day, "MMM dd, yyyy"), F.date_format(day, "MMM d, yyyy', 5:30 PM CST'"), F.lit("soon")]
    shape = F.element_at(F.array(*shapes), (F.col("page_id") % 6 + 1).cast("int"))
    rows = X.table(spark, d, "pages").select("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string"))).alias("title"), F.concat(F.lit("H"), F.col("page_id").cast("string")).alias("headline"), F.lit("x").alias("author"), shape.alias("published_at"), F.lit("b").alias("body_text"))
    return A.from_scraped(rows).select("id", "title", "teaser", "url", "date")


@query(sql="SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'no page' END AS error FROM pages")
def K3_checkpointed_load(spark, d):
    """A stream of the pages, with what failed marked as done."""
    schema = X.table(spark, d, "pages").schema
    at = scratch(spark, "load")
    error = F.when(F.col("page_id") % 10 == 3, "no page")
    ingest.checkpointed(spark, f"{d}/pages.parquet*", schema, f"{at}/target", f"{at}/state", f"{at}/checkpoint", "page_id", error).awaitTermination()
    good = spark.read.parquet(f"{at}/target").select("page_id", F.lit(None).cast("string").alias("error"))
    return good.union(spark.read.parquet(f"{at}/state").where("error is not null").select("page_id", "error"))


UP, DOWN = ["que", "the", "tion"], ["and", "der", "die"]
X.SQL["shares"] = rf"""SELECT id, date, tier, title, (n_up / greatest(n, 1))::DOUBLE AS positive, (n_down / greatest(n, 1))::DOUBLE AS negative, n FROM (SELECT *, len(w) AS n, len(list_filter(w, lambda x: list_contains({UP}, x))) AS n_up, len(list_filter(w, lambda x: list_contains({DOWN}, x))) AS n_down
FROM (SELECT *, list_filter(regexp_split_to_array(lower(trim(coalesce(headline, '') || '. ' || coalesce(lang, '') || '. ' || substr(coalesce(body, ''), 1, 300))), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$')) AS w
FROM (SELECT *, DATE '1995-01-06' + (id % 2390)::INT AS day, CASE id % 4 WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' ELSE 'broad' END AS tier, CASE WHEN id % 3 = 0 THEN 'A Deal' ELSE headline END AS title FROM articles)))""".replace("SELECT id, date, tier", "SELECT id, day AS date, tier")
X.SQL["text_news"] = "SELECT id, date, tier, title, positive - negative AS sentiment, positive, negative, 1 - positive - negative AS neutral FROM shares"


def _text_news(spark, d):
    """Articles of documents over the years that the prices cover, scored by their texts."""
    tier = F.when(F.col("id") % 4 == 1, "purchase").when(F.col("id") % 4 == 2, "error").otherwise("broad")
    day = F.date_add(F.lit("1995-01-06").cast("date"), (F.col("id") % 2390).cast("int"))
    rows = X.articles(spark, d).select("id", day.alias("date"), tier.alias("tier"), F.col("headline").alias("title"), F.col("lang").alias("teaser"), "body")
    scored = N.score_sentiment(rows, N.shares(UP, DOWN, ()))
    return scored.select("id", "date", "tier", F.when(F.col("id") % 3 == 0, "A Deal").otherwise(F.col("title")).alias("title"), "sentiment", "positive", "negative", "neutral")


@query("articles shares text_news", f"SELECT id, {r('positive', 'negative', 'neutral', 'sentiment')} FROM text_news")
def M1_P2_text_sentiment(spark, d):
    return rounded(_text_news(spark, d).select("id", "positive", "negative", "neutral", "sentiment"))


@query("articles shares text_news", Q.ORACLES["A1_daily_sentiment"].partition(" SELECT ")[2].join(("SELECT ", "")).replace("FROM scored", "FROM text_news"))
def A1_text_sentiment(spark, d):
    """The daily roll-up of scores that come from the texts."""
    from fathom.operators import daily as D

    return rounded(D.daily_sentiment(_text_news(spark, d)))


@query(sql=Q.ORACLES["X1_feature_matrix"].replace(f"news AS ({X.SQL['news']})", with_tables("articles shares", "").strip().removeprefix("WITH ") + f", news AS ({X.SQL['text_news']})"))
def X1_text_matrix(spark, d):
    """The feature matrix with all three layers of news scored by their texts, once."""
    rows = written(_text_news(spark, d), "scored")
    tiers = [rows.where(c) for c in ("tier not in ('purchase', 'error')", "tier = 'purchase'", "tier = 'error'")]
    return rounded(M.news_matrix(written(X.price(spark, d), "price"), *tiers, Q._drivers(spark, d)))
