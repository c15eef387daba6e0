"""Article tables: parsing, normalising, union, deduplication and scan windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import article_day, article_time, hashed_id, joined
from fathom.operators.series import keep_first

PAYLOAD = """id long, title string, teaser string, body string, author string, url string, created string, updated string,
channels array<struct<name:string>>, tags array<struct<name:string>>, stocks array<struct<name:string>>"""


def parsed(raw: DataFrame) -> DataFrame:
    """Rows of PAYLOAD as articles: names out of the nested lists, times, the day."""
    names = {to: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<name:string>>")), lambda x: x["name"]) for c, to in (("channels", "channels"), ("tags", "tags"), ("stocks", "tickers"))}
    rows = raw.select("id", "title", "teaser", "body", "author", "url", article_time(F.col("created")).alias("created"), article_time(F.col("updated")).alias("updated"), *(c.alias(k) for k, c in names.items()))
    return rows.withColumn("date", F.to_date("created"))


def scan_windows(spark: SparkSession, first: str, last: str, days: int = 30) -> DataFrame:
    """(start, end) of the windows that cover first to last, both included."""
    starts = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {days + 1} days"))).alias("start"))
    return starts.withColumn("end", F.least(F.date_add("start", days), F.lit(last).cast("date")))


def by_window(rows: DataFrame, days: int = 30, date: str = "date") -> DataFrame:
    """(start, end, n): the windows of scan_windows() that cover the dates of rows, and how
    many rows each has. A row's window follows from its date, so nothing is compared."""
    ends = rows.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    windows = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {days + 1} days"))).alias("start"), "b").select("start", F.least(F.date_add("start", days), F.col("b")).alias("end"))
    first = ends.select("a").scalar()
    at = F.floor(F.datediff(date, first) / (days + 1)) * (days + 1)
    counts = rows.where(F.col(date).isNotNull()).groupBy(F.date_add(first, at.cast("int")).alias("start")).agg(F.count("*").alias("n"))
    return windows.join(counts, "start", "left").select("start", "end", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tagged(rows: DataFrame, strategy: str, tier: str) -> DataFrame:
    return rows.withColumns({"query_strategy": F.lit(strategy), "query_tier": F.lit(tier)})


def normalised(rows: DataFrame, columns=("title", "teaser", "body")) -> DataFrame:
    """Trimmed texts; rows with any text, an id and a date."""
    rows = rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in columns})
    return rows.where(F.concat(*columns) != "").where("id is not null and date is not null")


def from_scraped(rows: DataFrame) -> DataFrame:
    """Scraped pages (url, title, headline, author, published_at, body_text) as articles: the id from
    the address, the headline for a missing title, only dated ones."""
    day = article_day(F.col("published_at"))
    return rows.select(
        hashed_id(F.col("url")).alias("id"), F.coalesce("title", "headline").alias("title"), F.col("headline").alias("teaser"), F.col("body_text").alias("body"),
        "author", "url", day.alias("date"),
    ).where("date is not null")


def corpus(rows: DataFrame, key: str = "id") -> DataFrame:
    """Articles (key, date, title, body) as (key, date, headline, text), one row for
    each key: the title, and title and body as one text."""
    whole = rows.select(key, "date", F.coalesce("title", F.lit("")).alias("headline"), joined(F.col("title"), F.col("body")).alias("text"))
    return keep_first(whole, [key], ["date", "headline", "text"])


def merged(first: DataFrame, *more: DataFrame, key: str = "id", order: str = "date") -> DataFrame:
    """Union by name, columns that are missing null; of one key the earliest table's row stays."""
    rows = first.withColumn("_t", F.lit(0))
    for k, table in enumerate(more, 1):
        rows = rows.unionByName(table.withColumn("_t", F.lit(k)), allowMissingColumns=True)
    return keep_first(rows, [key], ["_t", order]).drop("_t")


def upserted(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "date") -> DataFrame:
    """Existing rows, and new ones with keys of their own."""
    return existing.unionByName(keep_first(new, [key], [order]).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
