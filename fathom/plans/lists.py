"""Queries of the text functions with the word lists of functions.words."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions import words
from fathom.plans import fixtures as X
from fathom.plans.queries import _any_sql, query

#: The columns of text that the lists are looked for in: a headline with terms put into some.
_TERMS = ["oil and OPEC+ drilling", "solar tanker", "crude  shipping war", "a quiet day", "Brent inventories build", "hydroelectric"]
X.SQL["headed"] = "SELECT id, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS c, lower(t) AS low, t FROM (SELECT id, " + str(_TERMS) + "[(id % 6 + 1)::INT] || ' ' || coalesce(headline, '') AS t FROM articles)"
_CORE = ["oil", "crude", "petroleum", "oil and gas"]
_SCORE = f"(CASE WHEN {_any_sql('c', words.SITE_TERMS)} THEN 3 ELSE 0 END + " + " + ".join(f"contains(c, '{t}')::INT" for t in sorted(set(words.DRIVER_TERMS))) + f" - CASE WHEN {_any_sql('c', words.BLOCKED_TERMS)} AND NOT {_any_sql('c', _CORE)} THEN 2 ELSE 0 END)::BIGINT"


def _headed(spark, d):
    term = F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("id") % 6 + 1).cast("int"))
    return X.articles(spark, d).select("id", F.concat(term, F.lit(" "), F.coalesce("headline", F.lit(""))).alias("t"))


@query("articles headed", f"SELECT id, {_SCORE} AS score FROM headed")
def F2_F3_F6_site_score(spark, d):
    return _headed(spark, d).select("id", T.headline_score(F.col("t")).alias("score"))


@query("articles headed", f"SELECT id, {_any_sql('c', words.SITE_TERMS)} AND {_any_sql('c', words.DRIVER_TERMS)} AND {_SCORE} >= 4 AS relevant FROM headed")
def F4_site_relevant(spark, d):
    return _headed(spark, d).select("id", T.relevant(F.col("t")).alias("relevant"))


@query("articles headed", "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any_sql('low', terms)} THEN '{k}' END" for k, terms in words.SITE_TOPICS.items()) + "], lambda x: x IS NOT NULL), ',') AS topics FROM headed")
def F5_F8_site_topics(spark, d):
    return _headed(spark, d).select("id", F.array_join(T.topics(F.col("t"), words.SITE_TOPICS), ",").alias("topics"))


@query("articles headed", f"SELECT id, CASE WHEN o AND u AND NOT f THEN 'rise' WHEN o AND f AND NOT u THEN 'fall' END AS direction FROM (SELECT id, {_any_sql('low', words.CONTEXT_WORDS)} AS o, list_has_any(p, {words.RISE_WORDS}) AS u, list_has_any(p, {words.FALL_WORDS}) AS f FROM (SELECT *, regexp_split_to_array(low, '\\s+') AS p FROM (SELECT id, lower(t || ['', ' rises', ' falls', ' rises falls'][(id % 4 + 1)::INT]) AS low FROM headed)))")
def F9_market_direction(spark, d):
    more = F.element_at(F.array(*map(F.lit, ["", " rises", " falls", " rises falls"])), (F.col("id") % 4 + 1).cast("int"))
    return _headed(spark, d).select("id", T.direction(F.concat("t", more)).alias("direction"))
