"""Weekly indicators of topic categories: intensity, sentiment, variance and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.series import decayed, friday


def weekly_indicators(articles: DataFrame, categories: list[str], horizon: int = 4) -> DataFrame:
    """(week, category, intensity, sentiment, variance, decay) from articles (date,
    sentiment, topics) for each observed week and category.

    intensity: sum of 1 / topics of an article over the week's articles, as a share of
    all of them; sentiment: mean; variance: intensity times the sample variance, 0 for
    one article; decay: sentiment of this and all earlier observed weeks, weighted by
    exp(-weeks / horizon). Six decimals; a category without scores has 0 in all but
    the intensity.
    """
    rows = articles.where("date is not null").withColumn("week", friday(F.to_date("date")))
    totals = rows.groupBy("week").agg(F.count("*").alias("total"))
    each = rows.select("week", "sentiment", F.size("topics").alias("k"), F.explode("topics").alias("category"))
    sums = each.groupBy("week", "category").agg(F.sum(1 / F.col("k")).alias("w"), F.count("*").alias("n"), F.avg("sentiment").alias("mean"), F.var_samp("sentiment").alias("var"))
    grid = totals.select("week", "total", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    full = grid.join(sums, ["week", "category"], "left").withColumns({"_intensity": F.coalesce(F.col("w") / F.col("total"), F.lit(0.0)), "mean": F.coalesce("mean", F.lit(0.0))})
    full = decayed(full, {"decay": "mean"}, "week", ("category",), horizon)
    variance = F.when((F.col("n") > 1) & F.col("mean").isNotNull(), F.col("_intensity") * F.col("var")).otherwise(0.0)
    return full.select("week", "category", *(F.round(c, 6).alias(k) for k, c in (("intensity", F.col("_intensity")), ("sentiment", F.col("mean")), ("variance", F.coalesce(variance, F.lit(0.0))), ("decay", F.col("decay")))))


def wide(indicators: DataFrame, categories: list[str]) -> DataFrame:
    """One row a week, columns {category}_{indicator}."""
    kinds = ("intensity", "sentiment", "variance", "decay")
    return indicators.groupBy("week").agg(*(F.max(F.when(F.col("category") == c, F.col(k))).alias(f"{c}_{k}") for c in categories for k in kinds))


def lag_join(price: DataFrame, weekly: DataFrame, days: int = 7) -> DataFrame:
    """price (date) beside the indicators of the week before; 0 where there are none."""
    names = [c for c in weekly.columns if c != "week"]
    shifted = weekly.select(F.date_add("week", days).alias("date"), *(F.col(c).alias(f"{c}_lag1") for c in names))
    return price.join(shifted, "date", "left").na.fill(0, [f"{c}_lag1" for c in names])
