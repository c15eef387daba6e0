"""Secret scans: patterns, and two character Markov models compared by likelihood.

Patterns find assignments, access keys and long hexadecimal runs. Beside them,
every long token outside these spans is scored by two first-order Markov models
of characters, one of random strings and one of ordinary words; the sum of the
log-likelihood ratios of its transitions says which made it. Both are counted
from labelled samples. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which spans of one start are listed. The runs are as long as
#: they can be, so a run below the least length holds no match that counts.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ASSIGNED = 6
#: The least length of tokens that the models score, these, and words that stand for ordinary text.
SCORED = 16
TOKEN, WORD = rf"[A-Za-z0-9+/_=-]{{{SCORED},}}", r"[A-Za-z0-9+/_=-]{4,}"
#: Documents whose matches and words are the labelled samples.
SAMPLE = 4000
#: The least sum of log-likelihood ratios, and the least mean over a token's transitions.
SUM, MEAN = 12.0, 0.5
_BLOCK = 256
_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array of (kind, start, end, value) of the leftmost non-overlapping matches in
    code points. A match starts where the gaps and matches ahead of it end;
    these sums go by blocks, so that many matches in a text cost little more each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"), F.length(v).cast("long").alias("n")))
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x["gap"] + x["n"]))
    begin = F.aggregate(sums, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["n"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    spans = F.zip_with(blocks, begin, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda a: a["out"]))
    return F.when(F.size(found) > 0, F.flatten(spans)).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `text` as it is or empty, and a column of spans for each kind of PATTERNS."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumns({f"__scan_{kind}": matches(F.col("text"), pattern, kind) for kind, pattern in PATTERNS.items()})
    return docs.withColumn("__scan_assign", F.filter("__scan_assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGNED))


def samples(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(value, random): labelled strings from `most` documents, chosen by hash. What the
    patterns match is random, words elsewhere are not; tokens as long as those that are
    scored that mix letters and digits have no label."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)).alias("h"))
    # about twice as many rows as are asked for get past the filter, however many there are
    share = min(1.0, (2 * most + 1000) / max(1, rows.count()))
    few = rows.where(F.col("h") <= int(share * (1 << 62))).orderBy("h", "text").limit(most)
    few = base_spans(few)
    marked = few.select(F.explode(F.concat("__scan_assign", "__scan_access", "__scan_hex")).alias("s"))
    random = marked.select(F.when(F.col("s.kind") == "assign", F.regexp_extract("s.value", ASSIGN, 2)).otherwise(F.col("s.value")).alias("value"), F.lit(1).alias("random"))
    rest = F.col("text")
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = few.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("value"), F.lit(0).alias("random"))
    unlabelled = (F.length("value") >= SCORED) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return random.union(words.where(~unlabelled))


def weights(labelled: DataFrame) -> DataFrame:
    """One row: 16,384 log-likelihood ratios of transitions between ASCII characters,
    each count raised by a half. Without samples all are zero."""
    chars = labelled.select("random", F.split("value", "").alias("c")).where(F.size("c") > 1)
    pair = F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.ascii(a) * 128 + F.ascii(b)))
    counts = chars.select("random", pair.alias("pair")).where("pair < 16384 and pair % 128 > 0").groupBy("pair").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    grid = counts.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("pair")).join(F.broadcast(counts), "pair", "left")
    full = grid.select("pair", F.expr("pair div 128").alias("a"), *((F.coalesce(c, F.lit(0)) + 0.5).alias(c) for c in ("r", "o")))
    row = full.groupBy("a").agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    ratio = full.join(F.broadcast(row), "a").select("pair", F.log(F.col("r") / F.col("tr") / (F.col("o") / F.col("to"))).alias("w"))
    return ratio.agg(F.transform(F.sort_array(F.collect_list(F.struct("pair", "w"))), lambda x: x["w"]).alias("w"))


def likelihood(value: Column, table: Column) -> Column:
    """Sum of the log-likelihood ratios of the transitions in an ASCII string."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        gain = F.when((a["last"] > 0) & (code > 0), F.element_at(table, a["last"] * 128 + code + 1)).otherwise(0.0)
        return F.struct(code.alias("last"), (a["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(value, ""), start, step, lambda a: a["sum"])


def scan(docs: DataFrame, most: int = SAMPLE, least: float = SUM, mean: float = MEAN) -> DataFrame:
    """docs (doc_id, text and any other columns) with base and spans: arrays of
    (kind, start, end) in code points, by start and then in the order of kinds.

    base has what the patterns find, spans also the tokens ("random") that overlap
    none of these and whose likelihood ratio reaches `least` in sum and `mean` for a
    transition. A null text counts as empty and has none; it stays null. Rows that
    repeat are scanned alike. Columns named base and spans are replaced; names that
    begin with __scan_ are taken. The models come from `most` documents at most.
    """
    table = weights(samples(docs, most)).scalar()
    rows = base_spans(docs.withColumn("__scan_was", F.col("text")).drop("base", "spans"))
    rows = rows.withColumn("__scan_base", F.concat("__scan_assign", "__scan_access", "__scan_hex")).withColumn("__scan_token", matches(F.col("text"), TOKEN, "random"))
    apart = F.filter("__scan_token", lambda t: ~F.exists("__scan_base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    rows = rows.withColumn("__scan_apart", apart).withColumn("__scan_table", F.when(F.size("__scan_apart") > 0, table))
    scored = F.transform("__scan_apart", lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), likelihood(t["value"], F.col("__scan_table")).alias("ll")))
    chosen = F.filter(scored, lambda t: (t["ll"] >= least) & (t["ll"] >= mean * (t["end"] - t["start"] - 1)))
    order = F.create_map(*(x for i, kind in enumerate([*PATTERNS, "random"]) for x in (F.lit(kind), F.lit(i))))

    def listed(spans: Column) -> Column:
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    plain = F.transform(chosen, lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")))
    rows = rows.withColumn("spans", listed(F.concat(F.col("__scan_base"), plain))).withColumn("base", listed(F.col("__scan_base")))
    return rows.withColumn("text", F.col("__scan_was")).select(*(c for c in docs.columns if c not in ("base", "spans")), "base", "spans")


def as_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "<secret>") -> DataFrame:
    """Rows of scan() with every span in text replaced by `mark`, overlapping ones by
    one; base and spans are dropped. Rows without spans stay as they are."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"])
        return F.struct(piece.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    cut = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))).drop("base", "spans")
