"""Class shares of article texts: positive, negative, neutral, and their difference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import words
from fathom.functions.text import scoring_text, tokens
from fathom.operators.lexicon import BASE

Scorer = Callable[[Column], Column]


def shares(positive: list[str], negative: list[str], stop=words.STOP_WORDS) -> Scorer:
    """A scorer: the shares of a text's tokens that are in either list and in none; a text
    without tokens is neutral. The lists are constants of the plan, so nothing is shuffled."""

    def score(text: Column) -> Column:
        found = tokens(text, stop)
        part = lambda side: F.when(F.size(found) > 0, F.size(F.filter(found, lambda w: w.isin(list(side)))) / F.size(found)).otherwise(0.0)
        up, down = part(positive), part(negative)
        return F.struct(up.alias("positive"), down.alias("negative"), (1 - up - down).alias("neutral"))

    return score


def default_scorer() -> Scorer:
    """By the base lexicon; of a word in several lists the last one counts."""
    held = {w: p for some, p in BASE for w in some}
    return shares(sorted(w for w, p in held.items() if p > 0), sorted(w for w, p in held.items() if p < 0))


def score_sentiment(rows: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Articles (title, teaser, body) with positive, negative, neutral and sentiment, positive less
    negative, of title, teaser and the start of the body. Articles that have them already stay
    as they are. Another scorer, such as a pandas UDF around a model, gives a struct likewise;
    its missing classes are 0."""
    if {"positive", "negative", "neutral", "sentiment"} <= set(rows.columns):
        return rows
    text = scoring_text(F.col("title"), F.col("teaser"), F.col("body"))
    rows = rows.withColumn("_shares", (default_scorer() if scorer is None else scorer)(text))
    each = {c: F.coalesce(F.col(f"_shares.{c}"), F.lit(0.0)) for c in ("positive", "negative", "neutral")}
    return rows.withColumns(each).withColumn("sentiment", F.col("positive") - F.col("negative")).drop("_shares")
