"""Column functions on text: tokens, term predicates, topics, labels and scores."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions import words


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def once(value: Column, f) -> Column:
    """f(value), where f names the value often: as the variable of a lambda it is computed
    once a row, not once for each time that it is named."""
    return F.element_at(F.transform(F.array(value), f), 1)


def tokens(text: Column, stop=words.STOP_WORDS, least: int = 3) -> Column:
    """Words of `least` letters a-z or more that stand alone between other letters,
    digits and underscores, lower-cased, without stop words; repeats stay."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    kept = F.filter(parts, lambda w: w.rlike(f"^[a-z]{{{least},}}$"))
    return F.filter(kept, lambda w: ~w.isin(list(stop))) if stop else kept


def counted(words_: Column) -> Column:
    """(word, k): the distinct words of a row and how often each comes, out of the runs of
    the sorted words."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return once(ends, lambda e: F.transform(e, lambda i, at: F.struct(F.get(s, i - 1).alias("word"), (i - F.coalesce(F.get(e, at - 1), F.lit(0))).cast("long").alias("k"))))

    return once(F.array_sort(words_), runs)


def clean(text: Column) -> Column:
    """Lower-cased, with white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def joined(*parts: Column, sep: str = " ") -> Column:
    """Null-safe concatenation, trimmed."""
    return F.trim(reduce(lambda a, b: F.concat(a, F.lit(sep), b), [F.coalesce(p, F.lit("")) for p in parts]))


def scoring_text(title: Column, teaser: Column, body: Column, most: int = 300) -> Column:
    return joined(title, teaser, F.substring(F.coalesce(body, F.lit("")), 1, most), sep=". ")


def any_term(text: Column, terms) -> Column:
    """Whether any term is a substring."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))


def matched(text: Column, terms) -> Column:
    """The terms that are substrings, sorted and distinct."""
    return F.filter(_strings(sorted(set(terms))), lambda t: text.contains(t))


def headline_score(headline: Column, terms=words.SITE_TERMS, drivers=words.DRIVER_TERMS, blocked=words.BLOCKED_TERMS, core=("oil", "crude", "petroleum", "oil and gas")) -> Column:
    """3 for any term, 1 for each driver, less 2 for a blocked term without a core term."""
    text = clean(headline)
    off = any_term(text, blocked) & ~any_term(text, core)
    return (F.when(any_term(text, terms), 3).otherwise(0) + F.size(matched(text, drivers)) - F.when(off, 2).otherwise(0)).cast("long")


def relevant(headline: Column, least: int = 4, terms=words.SITE_TERMS, drivers=words.DRIVER_TERMS, **lists) -> Column:
    text = clean(headline)
    return any_term(text, terms) & any_term(text, drivers) & (headline_score(headline, terms, drivers, **lists) >= least)


def topics(text: Column, keywords=None) -> Column:
    """Names of the topics any of whose keywords is a substring of the lower-cased
    text, in the order of the mapping. Python finds a substring several times as fast as Spark's
    contains(), and the text is lower-cased once, not once for each keyword."""
    keywords = words.TOPIC_KEYWORDS if keywords is None else keywords
    low = F.lower(F.coalesce(text, F.lit("")))
    if not keywords:
        return F.array().cast("array<string>")

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[name for name, terms in keywords.items() if any(t in x for t in terms)] for x in texts], dtype=object)

    return found(low)


def direction(headline: Column, context=words.CONTEXT_WORDS, rise=words.RISE_WORDS, fall=words.FALL_WORDS) -> Column:
    """rise or fall if the text has a context substring and words of one side only; else null."""

    def side(low: Column) -> Column:
        parts = F.split(low, r"\s+")
        up, down = (F.arrays_overlap(parts, _strings(sorted(set(some)))) for some in (rise, fall))
        return F.when(any_term(low, context) & up & ~down, "rise").when(any_term(low, context) & down & ~up, "fall")

    return once(F.lower(F.coalesce(headline, F.lit(""))), side)


def lexicon_score(words_: Column, polarity: Column) -> Column:
    """Sum of the polarities of tokens over their number, in [-1, 1]; 0 without tokens.
    polarity: a map from word to number."""
    total = F.aggregate(words_, F.lit(0.0), lambda a, w: a + F.coalesce(polarity[w], F.lit(0.0)))
    return F.when(F.size(words_) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.size(words_)))).otherwise(0.0)


def paragraphs(text: Column, least: int = 60, group: int = 260) -> Column:
    """Blocks between blank lines; a text of one block falls into groups of sentences
    that close at `group` characters. Parts under `least` characters go."""
    return once(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), lambda whole: _parts(whole, least, group))


def _parts(whole: Column, least: int, group: int) -> Column:
    raw = F.filter(F.transform(F.split(whole, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    parts = F.filter(F.split(whole, r"(?<=[.!?])\s+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        grown = F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s))
        n = a["n"] + F.length(s) + 1
        full = n >= group
        return F.struct(F.when(full, F.concat(a["done"], F.array(grown))).otherwise(a["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("open"), F.when(full, 0).otherwise(n).alias("n"))

    groups = F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.filter(once(raw, lambda some: F.when(F.size(some) > 1, some).otherwise(groups)), lambda p: F.length(p) >= least)


def hashed_id(text: Column) -> Column:
    """A 60-bit id from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def article_time(value: Column) -> Column:
    """ISO or RFC 2822 text as a timestamp; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(F.substring(value, 6, 40), F.lit("dd MMM yyyy HH:mm:ss Z")))


def article_day(value: Column) -> Column:
    """The day of a text that is an ISO or RFC 2822 time, or starts with a date such as
    2024-01-05 or Jan 5, 2024; null if it does neither."""
    text = F.trim(value)
    named = F.regexp_extract(text, r"^([A-Za-z]{3})[a-z]*[.]?\s+(\d{1,2}),\s+(\d{4})", 0)
    short = F.regexp_replace(named, r"^([A-Za-z]{3})[a-z]*[.]?\s+", "$1 ")
    return F.coalesce(F.to_date(article_time(text)), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(short, "MMM d, yyyy"))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = F.greatest(reduce(lambda a, b: a + b, e), F.lit(1e-12))
    return [x / total for x in e]


def first_of_largest(names: list[str], scores: list[Column]) -> Column:
    """The name of the largest score, the first one on ties."""
    array = F.array(*scores)
    return F.element_at(_strings(names), F.array_position(array, F.array_max(array)).cast("int"))


def votes(score: Column, band: float) -> list[Column]:
    """(rise, neutral, fall) shares of a signed score with a neutral band."""
    rise, fall, neutral = F.greatest(score, F.lit(0.0)), F.greatest(-score, F.lit(0.0)), F.greatest(F.lit(0.0), F.lit(band) - F.abs(score))
    total = rise + fall + neutral
    return [F.when(total > 0, x / total).otherwise(0.0 if x is not neutral else 1.0) for x in (rise, neutral, fall)]
