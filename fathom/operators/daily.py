"""Daily roll-ups of scored articles and their event flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import any_term
from fathom.operators.series import near_events


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds; null counts as false."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """One row a day: counts, sentiment moments, mean probabilities and shares."""
    return scored.groupBy("date").agg(
        F.count("id").alias("headline_count"), F.avg("sentiment").alias("sentiment_mean"), F.stddev_samp("sentiment").alias("sentiment_std"),
        F.min("sentiment").alias("sentiment_min"), F.max("sentiment").alias("sentiment_max"),
        *(F.avg(c).alias(f"{c}_mean") for c in ("positive", "negative", "neutral")),
        share(F.col("negative") > 0.5).alias("negative_ratio"), share(F.col("positive") > 0.5).alias("positive_ratio"),
        F.log1p(F.count("id")).alias("log_headline_count"),
    )


def event_flags(scored: DataFrame, prefix: str, decisive=(), before: int = 2, after: int = 2, count: str = "article_count") -> DataFrame:
    """Daily roll-up of one tier: number (named by `count`), mean and deviation of
    sentiment (0 for one article), an event day, the window flag of the event days,
    and, if there are decisive terms, whether a title holds one."""
    decision = {f"{prefix}_decision_day": F.max(any_term(F.lower(F.coalesce(F.col("title"), F.lit(""))), decisive).cast("int"))} if decisive else {}
    columns = {f"{prefix}_{count}": F.count("id"), f"{prefix}_sentiment": F.avg("sentiment"), f"{prefix}_sentiment_std": F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0))}
    columns |= {f"{prefix}_event_day": F.lit(1), **decision}
    days = scored.groupBy("date").agg(*(c.alias(k) for k, c in columns.items()))
    near = near_events(days.select("date"), days.select("date"), before, after).withColumn(f"{prefix}_event_window", F.lit(1))
    return days.join(near, "date", "left").na.fill(0, [f"{prefix}_event_window"])


#: Columns with one of these in their names are 0 where there is no news.
ZERO = ("count", "flag", "day", "window", "intensity", "ratio", "cs_di", "csi_v", "sentiment", "positive_mean", "negative_mean", "neutral_mean")


def with_news(price: DataFrame, *news: DataFrame, zero: tuple[str, ...] = ZERO) -> DataFrame:
    """price beside each news table of one row a date; what holds one of `zero` in its
    name gets 0 where there is none."""
    for table in news:
        price = price.join(table, "date", "left")
    return price.na.fill(0, [c for c in price.columns if c != "date" and any(z in c for z in zero)])
