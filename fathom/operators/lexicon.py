"""A polarity lexicon that grows from a labelled corpus, and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import words
from fathom.functions.text import counted, lexicon_score, tokens
from fathom.sources.scratch import written

BASE = ((words.BASE_POSITIVE, 1.0), (words.BASE_NEGATIVE, -1.0), (words.MARKET_POSITIVE, 1.0), (words.MARKET_NEGATIVE, -1.0))


def base_lexicon(spark: SparkSession, lists=BASE) -> DataFrame:
    """(word, polarity); of a word in several lists the last one counts."""
    held = {w: p for some, p in lists for w in some}
    return spark.createDataFrame(sorted(held.items()), "word string, polarity double")


def class_counts(corpus: DataFrame, text: str = "text", label: str = "price_direction", stop=words.STOP_WORDS) -> DataFrame:
    """word, n_rise, n_fall over the labelled texts; repeats count."""
    found = corpus.where(F.col(label).isin("rise", "fall")).select(label, F.explode(tokens(F.col(text), stop)).alias("word"))
    return found.groupBy("word").agg(*(F.sum((F.col(label) == side).cast("long")).alias(f"n_{side}") for side in ("rise", "fall")))


def expanded_lexicon(base: DataFrame, counts: DataFrame, least: int = 3, ratio: float = 1.5, smoothing: float = 0.5) -> DataFrame:
    """base and the words of counts whose smoothed ratio of the classes reaches `ratio`,
    with (ratio - 1) / (ratio + 1) as polarity. Without words of both classes, base."""
    up, down = F.col("n_rise") + smoothing, F.col("n_fall") + smoothing
    r = F.greatest(up / down, down / up)
    score = F.round(F.signum(up - down) * (r - 1) / (r + 1), 4)
    both = counts.agg((F.coalesce(F.sum("n_rise"), F.lit(0)) * F.coalesce(F.sum("n_fall"), F.lit(0)) > 0).alias("ok")).scalar()
    new = counts.where((F.col("n_rise") + F.col("n_fall") >= least) & (r >= ratio)).where(both).join(base, "word", "left_anti")
    return base.unionByName(new.select("word", score.alias("polarity")))


def scored(corpus: DataFrame, lexicon: DataFrame, id: str, text: str = "text", stop=words.STOP_WORDS) -> DataFrame:
    """(id, lm_sentiment): sum of polarities over the number of tokens. The lexicon
    grows with the vocabulary, so words are joined to it: those of a document are counted
    in its row, so they are shuffled once, by word, and the sums that they come to once."""
    each = written(corpus.select(F.col(id), tokens(F.col(text), stop).alias("t")).select(id, F.size("t").cast("long").alias("n"), counted(F.col("t")).alias("c")), "words")
    sizes = each.select(id, "n", F.lit(None).cast("decimal(38,6)").alias("s"))
    hits = each.select(id, F.explode("c").alias("c")).select(id, "c.*").join(lexicon, "word").select(id, F.lit(0).cast("long").alias("n"), (F.col("polarity").cast("decimal(18,6)") * F.col("k")).cast("decimal(38,6)").alias("s"))
    total = sizes.union(hits).groupBy(id).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("s"), F.sum("n").alias("n"))
    return total.select(id, F.when(F.col("n") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / F.col("n")))).otherwise(0.0).alias("lm_sentiment"))


def scored_by_map(corpus: DataFrame, polarity: dict[str, float], text: str = "text", stop=words.STOP_WORDS) -> DataFrame:
    """corpus with lm_sentiment under a small lexicon, without a shuffle."""
    table = F.create_map(*(F.lit(x) for pair in polarity.items() for x in pair))
    return corpus.withColumn("lm_sentiment", lexicon_score(tokens(F.col(text), stop), table))
