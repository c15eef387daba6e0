"""Topics of paragraphs: weak labels by keywords, a classifier for each topic, and the
topics of articles as the union over their paragraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import words
from fathom.functions.text import once, paragraphs, topics
from fathom.sources.scratch import written

#: Weakly labelled paragraphs of a task that the classifiers learn in, once there are more than a core each.
PART = 50_000


def paragraph_frame(articles: DataFrame, key: str = "id", text: str = "text", keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, paragraph_idx, paragraph_text, weak_labels) of every paragraph; a text
    whose parts are all too short is one paragraph, a blank one has none."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    parts = once(paragraphs(F.col(text)), lambda p: F.when((F.size(p) == 0) & (whole != ""), F.array(whole)).otherwise(p))
    rows = articles.select(key, F.posexplode(parts).alias("paragraph_idx", "paragraph_text"))
    return rows.withColumn("weak_labels", topics(F.col("paragraph_text"), words.TOPIC_KEYWORDS if keywords is None else keywords))


@dataclass
class TopicModel:
    """Text features, and for each topic its classifier, or its share of the labelled
    paragraphs where too few or all of them have it."""

    features: PipelineModel
    topics: dict[str, LogisticRegressionModel | float]


def _features(least: int) -> Pipeline:
    """TF-IDF of words and pairs of words, without stop words, as unit vectors."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="paragraph_text", outputCol="_words", pattern=r"(?U)\w\w+", gaps=False), StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"), SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _grams FROM __THIS__"),
        CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=60_000, minDF=least, maxDF=0.95), IDF(inputCol="_counts", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features"),
    ])


def fit_topics(frame: DataFrame, names: list[str], least: int = 30) -> TopicModel | None:
    """Classifiers that learn from all weakly labelled paragraphs of a paragraph_frame().
    None without labels."""
    known = frame.where(F.size("weak_labels") > 0).select("paragraph_text", *(F.array_contains("weak_labels", k).cast("double").alias(f"_y_{i}") for i, k in enumerate(names)))
    known = written(known, "labelled")
    sums = known.agg(F.count("*").alias("n"), *(F.sum(f"_y_{i}").alias(f"y{i}") for i in range(len(names)))).first()
    n = sums["n"]
    if not n:
        return None
    known = known.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, -(-n // PART))).cache()
    features = _features(3 if n >= 200 else 2 if n >= 40 else 1).fit(known)
    ready, found = features.transform(known).cache(), {}
    for i, name in enumerate(names):
        some = sums[f"y{i}"]
        if some < least or some == n:
            found[name] = some / n
            continue
        weight = F.when(F.col(f"_y_{i}") == 1, n / (2 * some)).otherwise(n / (2 * (n - some)))
        model = LogisticRegression(labelCol=f"_y_{i}", weightCol="_w", maxIter=100, regParam=1 / n, standardization=False, probabilityCol=f"_p_{i}", rawPredictionCol=f"_r_{i}", predictionCol=f"_o_{i}")
        found[name] = model.fit(ready.withColumn("_w", weight))
    ready.unpersist()
    known.unpersist()
    return TopicModel(features, found)


def topic_probabilities(frame: DataFrame, model: TopicModel) -> DataFrame:
    """frame with probabilities, a map from topic to number."""
    rows, pairs = model.features.transform(frame), []
    for i, (name, one) in enumerate(model.topics.items()):
        if isinstance(one, float):
            p: Column = F.lit(one)
        else:
            rows = one.transform(rows)
            p = vector_to_array(f"_p_{i}")[1]
        pairs += [F.lit(name), p]
    return rows.select(*frame.columns, F.create_map(*pairs).alias("probabilities"))


def article_topics(articles: DataFrame, probabilities: DataFrame, key: str = "id", least: float = 0.4) -> DataFrame:
    """articles with topics: the sorted union of the labels that a paragraph of them has
    with a probability of `least` or more; empty without any."""
    names = F.explode(F.map_keys(F.map_filter("probabilities", lambda _, p: p >= least)))
    union = probabilities.select(key, names.alias("topic")).groupBy(key).agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return articles.join(union, key, "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def topics_by_model(articles: DataFrame, key: str = "id", text: str = "text", keywords: dict[str, list[str]] | None = None, least: float = 0.4) -> DataFrame:
    """articles with topics by classifiers that learn from the keywords' weak labels."""
    keywords = words.TOPIC_KEYWORDS if keywords is None else keywords
    frame = paragraph_frame(articles, key, text, keywords)
    model = fit_topics(frame, list(keywords))
    if model is None:
        return articles.withColumn("topics", F.array().cast("array<string>"))
    return article_topics(articles, topic_probabilities(frame, model), key, least)
