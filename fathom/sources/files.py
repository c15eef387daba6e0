"""Readers of files that were fetched before: articles, series and sitemaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.text import article_time, joined
from fathom.operators.articles import PAYLOAD, merged, parsed, tagged
from fathom.operators.series import keep_first
from fathom.sources.scratch import written


def optional(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What read() gives, or an empty table where there are no files."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def folder(spark: SparkSession, path: str, key: str = "id", order: str = "date") -> DataFrame:
    """All Parquet files under path, however deep, one row for each key."""
    return keep_first(spark.read.option("recursiveFileLookup", "true").parquet(path), [key], [order])


def with_keys(rows: DataFrame, prefix: str, url: str = "url", order: str = "url") -> DataFrame:
    """rows with `key`, the prefix before the address; rows without an address are numbered in a
    given order, so that they stay apart. Their numbers follow from the sizes of ranges of that order,
    each numbered in a task of its own."""
    spark = rows.sparkSession
    bare = F.coalesce(F.trim(url), F.lit("")) == ""
    own = rows.where(~bare).withColumn("key", F.concat(F.lit(f"{prefix}::"), F.col(url)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = written(rows.where(bare).repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "bare")
    sizes = rest.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    ahead = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = rest.join(F.broadcast(ahead), "_part").withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before"))
    return own.unionByName(numbered.withColumn("key", F.concat(F.lit(f"{prefix}::row-"), F.col("_k").cast("string"))).drop("_part", "_before", "_k"))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Articles out of JSON lines of operators.articles.PAYLOAD, in the order of creation."""
    return parsed(spark.read.schema(PAYLOAD).json(path)).orderBy("created", "id")


def strategies(spark: SparkSession, paths: dict[str, str], tiers: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """Articles of several strategies (name: path), or of those named in `only`, with
    their names and tiers; an article of two strategies stays with the first."""
    found = [tagged(payloads(spark, path), name, tiers.get(name, "")) for name, path in paths.items() if only is None or name in only]
    return merged(*found)


def important(rows: DataFrame, importance: str = "importance", key: str = "id") -> DataFrame:
    """Rows of high or medium importance, one for each key, with is_important."""
    kept = rows.where(F.col(importance).isin("high", "medium")).withColumn("_high", F.col(importance) != "high")
    return keep_first(kept, [key], ["_high"]).drop("_high").withColumn("is_important", F.lit(True))


def csv_articles(spark: SparkSession, path: str) -> DataFrame:
    """(date, headline, text) of a CSV with headline, body_text and published_at: times in
    UTC, rows without one left out."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    date = article_time(F.col("published_at")).alias("date")
    return rows.select(date, F.coalesce("headline", F.lit("")).alias("headline"), joined(F.col("headline"), F.col("body_text")).alias("text")).where("date is not null")


def paged_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(date, name) of the pages of a series, JSON files with response.data (period,
    value): numbers only, one for a period, in order."""
    rows = spark.read.schema("response struct<total:string,data:array<struct<period:string,value:string>>>").option("multiLine", "true").json(path)
    each = rows.select(F.explode("response.data").alias("d")).select(F.try_to_date("d.period").alias("date"), F.col("d.value").try_cast("double").alias(name)).dropna()
    return keep_first(each, ["date"], [name]).orderBy("date")


#: Of a monthly sitemap's name or folder: year and month.
MONTH = r"sitemap_articles[_=](\d{4})_(\d{1,2})"


def _month(name: Column) -> Column:
    return F.make_date(F.regexp_extract(name, MONTH, 1).try_cast("int"), F.regexp_extract(name, MONTH, 2).try_cast("int"), F.lit(1))


def sitemaps(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """(loc, month): the monthly article sitemaps of an index whose months lie in first..last, each once."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc"))
    rows = rows.where(F.col("loc").rlike(MONTH + "[.]xml")).select("loc", _month(F.col("loc")).alias("month"))
    return rows.where(_between(F.col("month"), first, last)).distinct()


def _between(month: Column, first: str, last: str) -> Column:
    return month.between(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"))


def repaired(url: Column, site: str) -> Column:
    """An address with scheme and host; null if it can't be told."""
    u = F.trim(url)
    return F.when(u.startswith("http"), u).when(u.startswith("/"), F.concat(F.lit(f"https://{site}"), u)).when(u.startswith(site), F.concat(F.lit("https://"), u))


def sitemap_urls(spark: SparkSession, path: str, site: str, first: str, last: str, wanted: list[str], unwanted: list[str]) -> DataFrame:
    """(url, lastmod) of leaf sitemaps: pages ending in .html under a wanted and no
    unwanted path, changed in first..last or with no date; each once. Below a folder, sitemaps named
    by months out of range aren't opened: the condition on their names is one on the scan."""
    rows = spark.read.format("xml").option("rowTag", "url").option("recursiveFileLookup", "true").schema("loc string, lastmod string").load(path)
    month = _month(F.col("_metadata.file_path"))
    rows = rows.where(month.isNull() | _between(month, first, last))
    rows = rows.select(repaired(F.col("loc"), site).alias("url"), F.try_to_date(F.substring(F.trim("lastmod"), 1, 10)).alias("lastmod"))
    part = F.regexp_replace("url", rf"^https?://{site.replace('.', '[.]')}", "")
    under = lambda paths: F.array_contains(F.transform(F.array(*map(F.lit, paths)), lambda p: part.startswith(p)), True) if paths else F.lit(False)
    kept = rows.where(F.col("url").endswith(".html") & under(wanted) & ~under(unwanted))
    kept = kept.where(F.col("lastmod").isNull() | F.col("lastmod").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return keep_first(kept, ["url"], [F.asc_nulls_last("lastmod")])


def write_sitemaps(rows: DataFrame, path: str) -> None:
    """rows (loc, lastmod, year, month) as leaf sitemaps, a folder for each month."""
    out = rows.withColumn("sitemap_articles", F.concat_ws("_", "year", "month")).drop("year", "month")
    out.repartition("sitemap_articles").write.mode("overwrite").partitionBy("sitemap_articles").format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def page_url(base: Column, page: Column) -> Column:
    """The address of a page of a category; the first one has no number."""
    bare = F.regexp_replace(base, "/+$", "")
    return F.when(page <= 1, F.concat(bare, F.lit("/"))).otherwise(F.concat(bare, F.lit("/Page-"), page.cast("string"), F.lit(".html")))


def slug_headline(url: Column) -> Column:
    """The last part of an address as words."""
    return F.replace(F.replace(F.substring_index(url, "/", -1), F.lit("-"), F.lit(" ")), F.lit(".html"), F.lit(""))


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrites path with rows as Parquet, CSV with a header, or JSON lines."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError("a table is written as parquet, csv or json")
    rows.write.mode("overwrite").option("header", "true").format(kind).save(path)
