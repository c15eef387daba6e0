"""How the tables of the queries are made of the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.series import friday


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 364).cast("int"))
    return rows.select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("headline"), F.col("text").alias("body"), "lang", "source", day.alias("date"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    s = F.col("value") / 250 - 1
    return rows.select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("event_type").alias("tier"), F.col("event_type").alias("title"), s.alias("sentiment"), F.greatest(s, F.lit(0.0)).alias("positive"), F.greatest(-s, F.lit(0.0)).alias("negative"), (1 - F.abs(s)).alias("neutral"))


def news(spark: SparkSession, d: str) -> DataFrame:
    """Scored articles over the years that the prices cover, some with decisive titles."""
    day = F.date_add(F.lit("1995-01-06").cast("date"), (F.col("id") % 2390).cast("int"))
    return scored(spark, d).withColumns({"date": day, "title": F.when(F.col("id") % 3 == 0, "A Deal").otherwise(F.col("title"))})


def price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(friday(F.to_date("o_orderdate")).alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


def segment_price(spark: SparkSession, d: str) -> DataFrame:
    """(series, date, close): weekly mean prices of each market segment."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("series"), friday(F.to_date("o_orderdate")).alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


def macro(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(friday(F.to_date("l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("stocks"), F.round(F.avg("l_discount"), 6).alias("rate"))


WEEK = "({0} + ((5 - dayofweek({0}) + 7) % 7)::INT)"
SQL = {
    "articles": "SELECT doc_id AS id, split_part(text, chr(10), 1) AS headline, text AS body, lang, source, (DATE '2024-01-01' + (doc_id % 364)::INT)::DATE AS date FROM documents",
    "scored": "SELECT event_id AS id, ts::DATE AS date, event_type AS tier, event_type AS title, value / 250 - 1 AS sentiment, greatest(value / 250 - 1, 0) AS positive, greatest(1 - value / 250, 0) AS negative, 1 - abs(value / 250 - 1) AS neutral FROM events",
    "news": "SELECT event_id AS id, DATE '1995-01-06' + (event_id % 2390)::INT AS date, event_type AS tier, CASE WHEN event_id % 3 = 0 THEN 'A Deal' ELSE event_type END AS title, value / 250 - 1 AS sentiment, greatest(value / 250 - 1, 0) AS positive, greatest(1 - value / 250, 0) AS negative, 1 - abs(value / 250 - 1) AS neutral FROM events",
    "price": f"SELECT {WEEK.format('o_orderdate::DATE')} AS date, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1",
    "macro": f"SELECT {WEEK.format('l_shipdate::DATE')} AS date, sum(l_quantity) AS stocks, round(avg(l_discount), 6) AS rate FROM lineitem GROUP BY 1",
    "ret": "SELECT date, close, (close / lag(close) OVER (ORDER BY date) - 1) * 100 AS ret FROM price",
    "vol": "SELECT *, CASE WHEN count(ret) OVER w >= 4 THEN stddev_samp(ret) OVER w END AS realized_vol FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)",
    "bt": "SELECT date, ret AS y_true, lag(ret) OVER (ORDER BY date) AS y_pred, CASE WHEN month(date) % 2 = 0 THEN 'macro' ELSE 'demand' END AS regime FROM ret",
    "bt2": "SELECT * FROM bt WHERE y_pred IS NOT NULL",
    "out": "SELECT *, (y_pred > 0)::INT AS pred_dir, (y_true > 0)::INT AS true_dir, sign(y_pred) * y_true AS strategy_ret, y_true AS bh_ret, ((y_pred > 0) = (y_true > 0))::INT AS hit FROM bt2",
    "cum": "SELECT *, product(1 + strategy_ret / 100) OVER w - 1 AS cum_strategy_ret, product(1 + bh_ret / 100) OVER w - 1 AS cum_bh_ret FROM out WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "tokens": r"SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-z]{3,}$'))) AS word FROM documents",
    "labelled": "SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'rise' WHEN doc_id % 3 = 1 THEN 'fall' END AS price_direction FROM documents",
    "counts": "SELECT word, count(*) FILTER (doc_id % 3 = 0) AS n_rise, count(*) FILTER (doc_id % 3 = 1) AS n_fall FROM tokens WHERE doc_id % 3 < 2 GROUP BY word",
}


def with_tables(names: str, query: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + " " + query
