"""Fill-in-middle examples, made with column functions only.

A text is cut into units, runs of ASCII letters or single other characters. A
delimiter is escaped in the text, then appended to every unit; its count is the
number of units, and substring_index takes the parts before, between and after
any two of them by rank. Unescaped, the parts are put together around markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The character put after each unit, and the one that escapes both: neither is likely in text.
MARK, ESCAPE = "\x01", "\x02"
_ESCAPED = {ESCAPE: ESCAPE + "0", MARK: ESCAPE + "1"}
#: An escaped character is one unit, as the character was.
UNITS = f"{ESCAPE}[01]|[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped(c: Column) -> Column:
    return _replaced(c, _ESCAPED.items())


def unescaped(c: Column) -> Column:
    """The text of a part: without marks, and as it was before it was escaped."""
    return _replaced(c, [(MARK, ""), *((b, a) for a, b in reversed(_ESCAPED.items()))])


def ranked(c: Column, mark: Column | str, count: Column) -> Column:
    return F.call_function("substring_index", c, F.lit(mark) if isinstance(mark, str) else mark, count.cast("int"))


def draws(doc_id: str) -> list[Column]:
    """Four unsigned integers of 32 bits from the id; a null id is as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plain: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output) of each row of docs, other
    columns left out whatever their names. n counts the units. form is `plain` where the
    text is empty or holds a marker, and for the share of ids from `plain` hundredths on;
    of the others `spm` hundredths are suffix-prefix-middle, the rest prefix-suffix-middle.
    Plain rows have no parts, and the text as output. A null text is an empty one. Rows
    with one id and one text have one result; each row is computed by itself, without
    a shuffle, in time that is linear in the text."""
    h = [f"_h{k}" for k in range(1, 5)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *(c.alias(n) for c, n in zip(draws("doc_id"), h, strict=True)))
    marked = F.regexp_replace(escaped(F.col("text")), UNITS, "$0" + MARK)
    rows = rows.withColumn("_marked", marked)
    rows = rows.withColumn("n", (F.length("_marked") - F.length(F.replace("_marked", F.lit(MARK), F.lit("")))).cast("long"))
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | holds | (F.col("_h3") % 100 >= plain), "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    cut = [F.col(c) % (F.col("n") + 1) for c in h[:2]]
    rows = rows.select("*", form.alias("form"), F.least(*cut).alias("_a"), F.greatest(*cut).alias("_b"))
    # ranks from the left leave off the mark at which they end; the last mark ends the text
    parts = {
        "prefix": ranked(F.col("_marked"), MARK, F.col("_a")),
        "middle": ranked(ranked(F.col("_marked"), MARK, F.col("_b")), MARK, F.col("_a") - F.col("_b")),
        "suffix": ranked(F.col("_marked"), MARK, F.col("_b") - F.col("n") - 1),
    }
    rows = rows.select("*", *(F.when(F.col("form") != "plain", unescaped(c)).alias(name) for name, c in parts.items()))
    p, s, m = (F.concat(F.lit(marker), F.col(part)) for marker, part in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form alone: no part holds a marker, and no end of
    a part with a marker makes another, since a marker has one `<`, its first character."""
    out, plain, spm = F.col(output), F.col(form) == "plain", F.col(form) == "spm"
    after = lambda marker: ranked(out, marker, F.lit(-1))
    prefix = ranked(after(PREFIX), F.when(spm, F.lit(MIDDLE)).otherwise(F.lit(SUFFIX)), F.lit(1))
    suffix = ranked(after(SUFFIX), F.when(spm, F.lit(PREFIX)).otherwise(F.lit(MIDDLE)), F.lit(1))
    return F.when(plain, out).otherwise(F.concat(prefix, after(MIDDLE), suffix))
