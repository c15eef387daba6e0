"""Feature matrices: weekly news, regimes and macro series beside a price, a week late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import words
from fathom.functions.text import direction, topics
from fathom.operators import daily as D
from fathom.operators import indicators as I
from fathom.operators import lexicon as L
from fathom.operators import regimes as R
from fathom.operators import series as S
from fathom.sources.scratch import written

#: How the columns of each layer are rolled up by week.
BROAD = {
    "headline_count": "sum", "sentiment_mean": "avg", "sentiment_std": "avg", "sentiment_min": "min", "sentiment_max": "max", "negative_ratio": "avg",
    "positive_ratio": "avg", "log_headline_count": "sum", "positive_mean": "avg", "negative_mean": "avg", "neutral_mean": "avg",
}
DECISIVE = {"opec_article_count": "sum", "opec_sentiment": "avg", "opec_sentiment_std": "avg", "opec_event_day": "max", "opec_decision_day": "max", "opec_event_window": "max"}
DISRUPTIVE = {"disruption_intensity": "sum", "disruption_sentiment": "avg", "disruption_sentiment_std": "avg", "disruption_event_day": "max", "disruption_event_window": "max"}
#: Columns that the matrix leaves out, as others say the same.
REDUNDANT = ("opec_event_window_lag1", "disruption_event_window_lag1", "vol_regime_lag1", "hmm_regime_lag1")


def weekly_layer(days: DataFrame, how: dict[str, str], name: str, mean: str, std: str, n: float = 4) -> DataFrame:
    """The layer of each week to Friday with {name}_cs_di, the decayed mean, and
    {name}_csi_v, mean times deviation."""
    weeks = S.weekly(days, {c: getattr(F, f)(c) for c, f in how.items()}, tuple(c for c, f in how.items() if f == "sum"))
    return S.decayed(weeks, {f"{name}_cs_di": mean}, n=n).withColumn(f"{name}_csi_v", F.col(mean) * F.col(std))


def news_matrix(price: DataFrame, broad: DataFrame, decisive: DataFrame, disruptive: DataFrame, macro: DataFrame | None = None, states: int = 0) -> DataFrame:
    """price (date, close) on Fridays with its weekly return and, all from the week
    before: three layers of scored articles, volatility and its regime, macro columns
    (date, ...) and, if `states` is given, those of a hidden Markov model. Weeks in
    which a column is null are left out. The series is one instrument's history."""
    layers = (
        weekly_layer(D.daily_sentiment(broad), BROAD, "broad", "sentiment_mean", "sentiment_std"),
        weekly_layer(D.event_flags(decisive, "opec", words.DECISION_TERMS), DECISIVE, "opec", "opec_sentiment", "opec_sentiment_std"),
        weekly_layer(D.event_flags(disruptive, "disruption", before=1, after=3, count="intensity"), DISRUPTIVE, "disruption", "disruption_sentiment", "disruption_sentiment_std"),
    )
    rows = D.with_news(price, *layers).withColumn("close_pct_change", S.change(F.col("close"), S.over()))
    rows = written(rows, "weeks")  # the quantiles and the states read it too
    rows = R.volatility_regime(S.volatility(rows, "close_pct_change"))
    if states:
        hidden = R.markov_regime(rows.withColumn("_series", F.lit("all")), ["close_pct_change", "realized_vol"], states, key="_series").select("date", "hmm_regime")
        rows = rows.join(hidden, "date", "left").select("*", *(F.coalesce((F.col("hmm_regime") == k).cast("int"), F.lit(0)).alias(f"hmm_regime_{k}") for k in range(states)))
    if macro is not None:
        rows = rows.join(macro, "date", "left")
    late = S.lagged(rows, [c for c in rows.columns if c not in ("date", "close", "close_pct_change")])
    return late.drop(*REDUNDANT).dropna()


def labelled(articles: DataFrame, **lists) -> DataFrame:
    """articles (date, headline, text) with price_direction out of the headline; rows
    without a date or text are left out."""
    rows = articles.where("date is not null and text is not null").where(F.trim("text") != "")
    return rows.withColumn("price_direction", direction(F.col("headline"), **lists))


def lexicon_scores(articles: DataFrame, base: DataFrame | None = None, stop=words.STOP_WORDS, key: str = "id") -> DataFrame:
    """labelled() articles (key, text, price_direction) with lm_sentiment under the
    lexicon that the base grows to."""
    base = L.base_lexicon(articles.sparkSession) if base is None else base
    grown = written(L.expanded_lexicon(base, written(L.class_counts(articles, stop=stop), "counts")), "lexicon")
    return articles.join(L.scored(articles, grown, key, stop=stop), key)


def lexicon_matrix(price: DataFrame, articles: DataFrame, found_topics: DataFrame | None = None, keywords: dict[str, list[str]] | None = None, key: str = "id", **lists) -> DataFrame:
    """price (date, close) with its weekly return beside the indicators, a week late, of
    articles (key, date, headline, text): direction, grown lexicon, score, topics, four
    indicators a topic. Topics are those of found_topics (key, topics) or else of the
    keywords that the text holds."""
    keywords = words.TOPIC_KEYWORDS if keywords is None else keywords
    rows = labelled(articles, **lists)
    if found_topics is None:
        rows = rows.withColumn("topics", topics(F.col("text"), keywords))
    rows = lexicon_scores(written(rows, "articles"), key=key).drop("text", "headline")
    if found_topics is not None:
        rows = rows.join(found_topics.select(key, "topics"), key, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    weeks = I.wide(I.weekly_indicators(rows.select("date", F.col("lm_sentiment").alias("sentiment"), "topics"), list(keywords)), list(keywords))
    return I.lag_join(price, weeks).withColumn("close_pct_change", S.change(F.col("close"), S.over())).where("close_pct_change is not null")
