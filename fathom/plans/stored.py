"""Queries of tables and files that are written and read back, as a pipeline keeps them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import regimes as R
from fathom.plans import fixtures as X
from fathom.plans import queries as Q
from fathom.plans.queries import query, rounded
from fathom.sources import crawl, files, pages, tables
from fathom.sources.scratch import scratch

_TIERS = {"broad": "wide", "deep": "narrow"}


@query("articles", "SELECT id, source AS title, date, CASE WHEN id % 2 = 0 THEN 'broad' ELSE 'deep' END AS query_strategy, CASE WHEN id % 2 = 0 THEN 'wide' ELSE 'narrow' END AS query_tier, (CASE WHEN lang = 'en' THEN 2 ELSE 1 END)::INT AS n_channels FROM articles WHERE id % 2 = 0 OR id % 3 = 0")
def S5_S7_S8_K4_K6_strategies(spark, d):
    """Payloads of two strategies, and of one that was never fetched: nested names flattened,
    an article of both stays with the first."""
    rows, paths = X.articles(spark, d), {}
    name = lambda c: F.struct(c.alias("name"))
    channels = F.when(F.col("lang") == "en", F.array(name(F.col("source")), name(F.lit("x")))).otherwise(F.array(name(F.col("source"))))
    payload = rows.select("id", F.col("source").alias("title"), F.date_format("date", "yyyy-MM-dd'T'06:00:00'Z'").alias("created"), channels.alias("channels"))
    for strategy, condition in (("broad", "id % 2 = 0"), ("deep", "id % 3 = 0")):
        paths[strategy] = scratch(spark, strategy)
        files.write_table(payload.where(condition), paths[strategy], "json")
    found = files.strategies(spark, paths, _TIERS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    late = files.optional(spark, lambda: files.strategies(spark, {"late": scratch(spark, "late")}, {}), schema)
    return found.unionByName(late).select("id", "title", "date", "query_strategy", "query_tier", F.size("channels").alias("n_channels"))


@query("articles", "SELECT id, ['low', 'medium', 'high'][(id % 3 + 1)::INT] AS importance, true AS is_important FROM articles WHERE id % 3 > 0")
def S6_P5_important(spark, d):
    """Of two ratings of an article the higher one stays; low ones go."""
    level = lambda shift: F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), ((F.col("id") % 3 + shift) % 3 + 1).cast("int"))
    rows = X.articles(spark, d).select("id", level(0).alias("importance"))
    return files.important(rows.union(rows.where("importance = 'high'").select("id", F.lit("medium"))).union(rows.where("importance <> 'low'")))


@query("articles", "SELECT date, source AS headline, source || ' ' || lang AS text FROM articles WHERE id % 5 <> 4")
def S10_csv_articles(spark, d):
    """Articles as CSV with times of two kinds, or none."""
    shape = F.when(F.col("id") % 5 == 4, "never").when(F.col("id") % 2 == 0, F.date_format("date", "yyyy-MM-dd'T'10:00:00'Z'")).otherwise(F.date_format("date", "EEE, dd MMM yyyy '10:30:00 +0000'"))
    path = scratch(spark, "csv")
    files.write_table(X.articles(spark, d).select(F.col("source").alias("headline"), F.col("lang").alias("body_text"), shape.alias("published_at")), path, "csv")
    rows = files.csv_articles(spark, path)
    return rows.select(F.to_date("date").alias("date"), "headline", "text")


@query("articles", "SELECT id, date, CASE WHEN id % 2 = 0 THEN source ELSE 'new' END AS title, coalesce(lang, 'none') AS query_strategy, strftime(date, '%Y-%m') AS year_month FROM articles WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-07-31'")
def K1_K2_S7_P7_months(spark, d):
    """A folder for each strategy and month; new keys are added, old rows stay; a range of months is read."""
    rows = X.articles(spark, d).select("id", "date", F.col("source").alias("title"), F.coalesce("lang", F.lit("none")).alias("query_strategy"))
    path = scratch(spark, "months")
    tables.write_months(rows.where("id % 2 = 0"), path)
    tables.upsert_months(rows.withColumn("title", F.lit("new")), path, scratch(spark, "upsert"))
    return tables.read_months(spark, path, "2024-03", "2024-07").select("id", "date", "title", "query_strategy", "year_month")


@query("articles", "SELECT id, date, any_value(source) AS source FROM articles GROUP BY id, date")
def S7_K7_folder(spark, d):
    """All files below a folder, however deep, one row for each key."""
    rows, path = X.articles(spark, d).select("id", "date", "source"), scratch(spark, "folder")
    for name, condition in (("a", "id % 2 = 0"), ("b/c", "id % 2 <> 0"), ("b/d/e", "id % 3 = 0")):
        files.write_table(rows.where(condition), f"{path}/{name}")
    return files.folder(spark, path)


_SITE = "'https://site.com'"


@query(sql=f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_SITE} || '/a/' || page_id || '-b.html' WHEN page_id % 3 = 1 THEN url ELSE 'https://site.com/x' END AS whole,
CASE WHEN page_id % 4 <= 1 THEN 'https://s.com/c/' ELSE 'https://s.com/c/Page-' || (page_id % 4) || '.html' END AS page, page_id || ' b' AS words FROM pages""")
def F15_addresses(spark, d):
    """Addresses made whole, pages of a category, and the words of an address."""
    rows = X.table(spark, d, "pages")
    path = F.concat(F.lit("/a/"), F.col("page_id").cast("string"), F.lit("-b.html"))
    part = F.when(F.col("page_id") % 3 == 0, path).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.lit("site.com/x"))
    return rows.select("page_id", files.repaired(part, "site.com").alias("whole"), files.page_url(F.lit("https://s.com/c//"), F.col("page_id") % 4).alias("page"), files.slug_headline(path).alias("words"))


@query(sql="SELECT page_id, CASE WHEN page_id % 3 < 2 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS linked FROM pages")
def F23_linked_dates(spark, d):
    """Dates of JSON-LD scripts put ahead of each page: published, else created, else none."""
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    key = F.when(F.col("page_id") % 3 == 0, "datePublished").when(F.col("page_id") % 3 == 1, "dateCreated").otherwise("other")
    script = F.concat(F.lit('<script type="application/ld+json">{"x": 1}</script><script type="application/ld+json">{"'), key, F.lit('": "'), day, F.lit('"}</script>'))
    return X.table(spark, d, "pages").select("page_id", pages.linked_date(F.concat(script, F.col("html"))).alias("linked"))


@query("price ret vol z sc", "SELECT date, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'up' WHEN s2 >= s3 THEN 'calm' ELSE 'mixed' END AS regime FROM sc")
def R8_F18_regime_labels(spark, d):
    """The first of the most probable regimes."""
    return R.rule_scores(Q._vol(spark, d), {"up": {"ret": 0.4}, "calm": {"realized_vol": -1.0}}, "mixed").select("date", "regime")


@query("price macro", "SELECT date, round(close, 6) AS value, 'close' AS kind FROM price UNION ALL SELECT date, round(stocks, 6), 'stocks' FROM macro")
def U2_bag_union(spark, d):
    rows = X.price(spark, d).select("date", F.col("close").alias("value"), F.lit("close").alias("kind"))
    return rounded(rows.unionByName(X.macro(spark, d).select(F.lit("stocks").alias("kind"), "date", F.col("stocks").alias("value"))))


@query(sql="SELECT ('0x' || substr(md5(CASE WHEN page_id % 4 = 0 THEN '' ELSE url END), 1, 15))::BIGINT AS id, 'other::' || CASE WHEN page_id % 4 = 0 THEN 'row-' || row_number() OVER (PARTITION BY page_id % 4 = 0 ORDER BY page_id) ELSE url END AS key FROM pages")
def S11_synthetic_keys(spark, d):
    """Keys of articles from elsewhere: of the address, or of a number of its own where it is empty."""
    rows = X.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")).alias("url"))
    return files.with_keys(rows, "other", order="page_id").select(T.hashed_id(F.col("url")).alias("id"), "key")


def _cards(spark, d):
    """Cards of four categories on pages with gaps, some addresses on several."""
    rows = X.articles(spark, d)
    page = (F.floor(F.col("id") / 4) % 14 + F.when(F.col("id") % 14 > 8, 2).otherwise(1)).cast("int")
    url = F.concat(F.lit("u"), F.when(F.col("id") % 5 == 0, F.floor(F.col("id") / 10)).otherwise(F.col("id")).cast("string"))
    return rows.select(F.coalesce("lang", F.lit("none")).alias("category"), page.alias("page"), url.alias("url"), F.coalesce("source", F.lit("")).alias("headline"))


@query()
def S20_crawl(spark, d):
    """What a crawl of four categories meets, each up to its first page without anything new."""
    return crawl.discovered(_cards(spark, d), ["en", "de", "fr", "es"])
