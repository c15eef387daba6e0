"""Keyword mining: neighbours of word vectors, co-occurrence and polarity votes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokens, votes
from fathom.sources.scratch import scratch, written


def _nearest(top: int, least: float):
    """The `top` rows of a part of the vectors nearest to each seed of a block. Sums run
    in the order of the coordinates, so equal vectors have equal similarities."""

    def nearest(seeds: pa.Table, vectors: pa.Table) -> pa.Table:
        seed, word, similarity = [], [], []
        if seeds.num_rows and vectors.num_rows:
            names, words = np.array(seeds.column("seed").to_pylist()), np.array(vectors.column("word").to_pylist())
            a, b = (np.array(t.column("vector").to_pylist(), np.float64) for t in (seeds, vectors))
            dot = lambda x, y: sum(x[..., d] * y[..., d] for d in range(x.shape[-1]))
            aa, bb = dot(a, a), dot(b, b)
            for at in range(0, len(a), 32):
                with np.errstate(invalid="ignore", divide="ignore"):
                    found = dot(a[at : at + 32, None], b[None]) / np.sqrt(aa[at : at + 32, None] * bb[None])
                for name, row in zip(names[at : at + 32], found, strict=True):
                    open_ = np.flatnonzero((row >= least) & (words != name))
                    if len(open_) > top:
                        open_ = open_[row[open_] >= np.partition(row[open_], -top)[-top]]
                    best = open_[np.lexsort((words[open_], -row[open_]))[:top]]
                    seed += [name.item()] * len(best)
                    word += words[best].tolist()
                    similarity += row[best].tolist()
        kinds = seeds.schema.field("seed").type, vectors.schema.field("word").type, pa.float64()
        return pa.table([pa.array(c, k) for c, k in zip((seed, word, similarity), kinds, strict=True)], ["seed", "word", "similarity"])

    return nearest


def all_neighbours(vectors: DataFrame, seeds: DataFrame, top: int = 5, least: float = -1.0, block: int = 1000, part: int = 10_000) -> DataFrame:
    """The `top` vectors (word, vector) nearest to each of seeds (seed, vector) by cosine,
    ties by word: seed, word, similarity, rank. A seed isn't its own neighbour. The seeds
    may grow with the table: about `block` of them meet about
    `part` vectors in a task, and only the `top` of each part go on. Vectors are of one
    length; those that are null or hold a null have no similarity."""
    whole = lambda df: df.where("vector is not null and not exists(vector, x -> x is null)")
    n, m = math.ceil(seeds.count() / block) or 1, math.ceil(vectors.count() / part) or 1
    dealt = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = whole(seeds).select("seed", "vector", dealt("seed", n).alias("block"), each(m).alias("part"))
    right = whole(vectors).select("word", "vector", dealt("word", m).alias("part"), each(n).alias("block"))
    kinds = f"seed {seeds.schema['seed'].dataType.simpleString()}, word {vectors.schema['word'].dataType.simpleString()}, similarity double"
    scored = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_nearest(top, least), kinds)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("similarity"), "word")))
    return ranked.where(F.col("rank") <= top)


def best_seed(found: DataFrame) -> DataFrame:
    """For each word its most similar seed."""
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "seed"))
    return found.withColumn("_n", best).where("_n = 1").select("word", "similarity", F.col("seed").alias("similar_to"))


def token_index(docs: DataFrame, id: str = "doc_id", text: str = "text", stop=()) -> DataFrame:
    """Distinct (token, doc_id)."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text), stop))).alias("token"), F.col(id).alias("doc_id"))


def pair_pmi(index: DataFrame, candidates: list[str], seeds: list[str]) -> DataFrame:
    """log2 of p(ab) / p(a) p(b) for candidate and seed tokens that share a document.
    The index is restricted to these tokens before it meets itself."""
    total = index.agg(F.countDistinct("doc_id").alias("n")).scalar()
    some = index.where(F.col("token").isin(sorted({*candidates, *seeds})))
    df = some.groupBy("token").agg(F.count("*").alias("n"))
    a = some.where(F.col("token").isin(candidates)).select("doc_id", F.col("token").alias("word"))
    b = some.where(F.col("token").isin(seeds)).select("doc_id", F.col("token").alias("seed"))
    both = a.join(b, "doc_id").where("word <> seed").groupBy("word", "seed").agg(F.count("*").alias("n_ab"))
    both = both.join(F.broadcast(df.select(F.col("token").alias("word"), F.col("n").alias("n_a"))), "word").join(F.broadcast(df.select(F.col("token").alias("seed"), F.col("n").alias("n_b"))), "seed")
    return both.select("word", "seed", F.log2(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))).alias("pmi"))


def all_pmi(index: DataFrame, seeds: list[str], total: int | None = None) -> DataFrame:
    """pair_pmi() of every token of the index with the seeds; total: documents, where the
    index isn't of all of them."""
    total = index.agg(F.countDistinct("doc_id").alias("n")).scalar() if total is None else F.lit(total)
    df = index.groupBy("token").agg(F.count("*").alias("n"))
    b = index.where(F.col("token").isin(seeds)).select("doc_id", F.col("token").alias("seed"))
    both = index.withColumnRenamed("token", "word").join(b, "doc_id").where("word <> seed").groupBy("word", "seed").agg(F.count("*").alias("n_ab"))
    some = df.where(F.col("token").isin(seeds)).select(F.col("token").alias("seed"), F.col("n").alias("n_b"))
    both = both.join(df.select(F.col("token").alias("word"), F.col("n").alias("n_a")), "word").join(F.broadcast(some), "seed")
    return both.select("word", "seed", F.log2(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b"))).alias("pmi"))


def rate_gap(counts: DataFrame, gap: float = 1.2e-4, least: int = 3, most: int = 500, base: tuple[str, ...] = ()) -> DataFrame:
    """Words of counts (word, n_rise, n_fall) whose shares of the two classes differ by
    more than `gap`, the `most` widest of each side; words of `base`, seeds already,
    count in the totals only."""
    rise, fall = (F.lit(n or 0) for n in counts.agg(F.sum("n_rise"), F.sum("n_fall")).first())
    rates = counts.where(F.col("n_rise") + F.col("n_fall") >= least).where(~F.col("word").isin(list(base))).withColumn("gap", F.col("n_rise") / F.greatest(rise, F.lit(1)) - F.col("n_fall") / F.greatest(fall, F.lit(1)))
    wide_ = rates.where(F.abs("gap") > gap).withColumn("side", F.when(F.col("gap") > 0, "rise").otherwise("fall"))
    top = lambda side: wide_.where(F.col("side") == side).orderBy(F.desc(F.abs("gap")), "word").limit(most)
    return top("rise").unionByName(top("fall")).select("word", "side", "gap")


def mean_pmi(index: DataFrame, seeds: list[str], total: int | None = None) -> DataFrame:
    """(word, mean_pmi) over the seeds that share a document with the word."""
    return all_pmi(index, seeds, total).groupBy("word").agg(F.avg("pmi").alias("mean_pmi"))


def mean_cosine(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """(word, mean_cosine) of vectors (word, vector) to all of seeds (vector): the product
    with the mean of their unit vectors, so that no pair is formed. Null for a vector
    that is null or 0."""
    whole = lambda df: df.where("vector is not null and not exists(vector, x -> x is null) and exists(vector, x -> x <> 0)")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: x.cast("double") / norm)
    each = whole(seeds).select(F.posexplode(unit).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x"))
    centre = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("c")).scalar()
    dot = F.aggregate(F.zip_with(unit, "_c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return whole(vectors).withColumn("_c", centre).select("word", F.when(F.size("_c") > 0, dot).alias("mean_cosine"))


def relevant(suggestions: DataFrame, cosines: DataFrame, pmis: DataFrame, groups: list[str] | None = None, cosine_least: float = 0.5, pmi_least: float = 0.02) -> DataFrame:
    """Suggestions (group, word, ...) of the mapped `groups` (null: all) whose mean cosine and
    mean PMI with the group's seeds (group, word, ...) pass both gates, with both rounded
    to four places; those of other groups pass as they are, with nulls."""
    rows = suggestions.join(cosines.select("group", "word", "mean_cosine"), ["group", "word"], "left").join(pmis.select("group", "word", "mean_pmi"), ["group", "word"], "left")
    gated = F.lit(True) if groups is None else F.col("group").isin(groups)
    rows = rows.where(~gated | ((F.col("mean_cosine") >= cosine_least) & (F.col("mean_pmi") >= pmi_least)))
    return rows.withColumns({f"mean_{k}": F.when(gated, F.round(f"mean_{k}", 4)) for k in ("cosine", "pmi")})


#: Parts of the documents, or of the pairs of tokens, of which one at a time lies in shuffle files.
PARTS = 4


def phrases(docs: DataFrame, tokens: str = "tokens", least: int = 5, threshold: float = 10.0) -> DataFrame:
    """(a, b, n_ab, score): pairs of neighbouring tokens that come together more often than
    by chance, (n_ab - least) * V / (n_a * n_b) above `threshold`. V counts the
    distinct tokens and the distinct pairs, which are counted a part of their hashes after the other."""
    t, n = F.col(tokens), F.greatest(F.size(tokens) - 1, F.lit(0))
    each = F.explode(F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    every = docs.where(F.size(tokens) > 1).select(each.alias("p")).select("p.a", "p.b")
    single = written(docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "single", tidy=True)
    known, found = single.count(), []
    for k in range(PARTS):
        distinct = Observation()
        pairs = every.where(F.pmod(F.xxhash64("a", "b"), F.lit(PARTS)) == k).groupBy("a", "b").agg(F.count("*").alias("n_ab"))
        found.append(written(pairs.observe(distinct, F.count(F.lit(1)).alias("n")).where(F.col("n_ab") >= least), "pairs_of_tokens", tidy=True))
        known += distinct.get["n"]
    some = reduce(DataFrame.unionAll, found).join(single.select(F.col("token").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("token").alias("b"), F.col("n").alias("n_b")), "b")
    some = some.withColumn("score", (F.col("n_ab") - least) * known / (F.col("n_a") * F.col("n_b")))
    return some.where(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def phrased(docs: DataFrame, found: DataFrame, id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(id, pos, token) with the phrases (a, b) joined by _, from left to right: of a run
    of overlapping ones every other is taken. The phrases grow with the vocabulary,
    so a document's pairs are joined to them; id tells documents apart. Only where the phrases
    begin comes back to a document, as one row."""
    t = F.col(tokens)
    each = F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.get(t, i + 1).alias("b")))
    hits = docs.select(id, F.explode(each).alias("t")).select(id, "t.*").join(found.select("a", "b"), ["a", "b"], "left_semi").select(id, "pos")
    runs = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(id).orderBy("pos")))
    taken = runs.withColumn("k", F.row_number().over(Window.partitionBy(id, "run").orderBy("pos"))).where("k % 2 = 1")
    begins = taken.groupBy(id).agg(F.collect_list("pos").alias("_at"))
    rows = docs.select(id, t.alias("_t")).join(begins, id, "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    rows = rows.select(id, "_t", "_at", F.posexplode("_t").alias("pos", "token")).where("not array_contains(_at, pos - 1)")
    return rows.select(id, "pos", F.when(F.expr("array_contains(_at, pos)"), F.concat_ws("_", "token", F.get("_t", F.col("pos") + 1))).otherwise(F.col("token")).alias("token"))


def _by_parts(rows: DataFrame, make: Callable[[DataFrame], DataFrame], tag: str, id: str = "doc_id") -> DataFrame:
    """make(rows) of all rows, a part of the ids after the other, each written before the next."""
    part = F.pmod(F.xxhash64(id), F.lit(PARTS))
    return reduce(DataFrame.unionAll, [written(make(rows.where(part == k)), tag, tidy=True, compression="zstd") for k in range(PARTS)])


def seed_tokens(seeds: DataFrame, found: DataFrame, stop=()) -> DataFrame:
    """(seed, token): each phrase of seeds (seed) as tokens and phrases of them, joined by _."""
    rows = seeds.select("seed", tokens(F.col("seed"), stop).alias("tokens"))
    parts = phrased(rows, found, "seed").groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("p"))
    return parts.select("seed", F.array_join(F.transform("p", lambda x: x["token"]), "_").alias("token"))


#: Tokens for each bucket of words up to LEAST_BUCKETS of them, and words of a bucket, about; tokens for
#: each block of two buckets.
PART_TOKENS, LEAST_BUCKETS, BUCKET, BLOCK_TOKENS = 400_000, 12, 250_000, 1_000_000
#: Unlikely contexts for each likely one, those drawn for a batch of pairs, and the step of the learner.
NEGATIVE, DRAWN, RATE = 5, 64, 0.2


def _windows(buckets: int, window: int, shift: int):
    """Rows (tokens), arrays of bucket << 24 | place, as rows (bucket, pairs, times): the distinct
    pairs of a token and one near it whose bucket is `shift` further, bucket by bucket. How far a
    token sees, up to `window`, follows from a hash of it and of its place in the text."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            code, length = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.diff(lists.offsets.to_numpy())
            text = np.repeat(np.arange(len(length), dtype=np.int32), length)
            at = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
            bucket, place = code >> np.uint32(24), (code & np.uint32(0xFFFFFF)).astype(np.uint64)
            mixed = (bucket.astype(np.uint64) << np.uint64(32) | place) ^ (at.astype(np.uint64) << np.uint64(40))
            sees = 1 + (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(window)
            sees, side = sees.astype(np.int16), bucket.astype(np.int16)
            # bucket of the word, its place, that of its context: 8, 24 and 24 bits
            word = bucket.astype(np.uint64) << np.uint64(48) | place << np.uint64(24)
            found = []
            for d in range(1, window + 1):
                same, gap = text[:-d] == text[d:], side[d:] - side[:-d]
                left = np.flatnonzero(same & ((gap == shift) | (gap == shift - buckets)) & (sees[:-d] >= d))
                right = np.flatnonzero(same & ((gap == -shift) | (gap == buckets - shift)) & (sees[d:] >= d))
                found += [word[left] | place[left + d], word[right + d] | place[right]]
            pairs, times = np.unique(np.concatenate(found), return_counts=True)
            if not len(pairs):
                continue
            cut = np.flatnonzero(np.diff(pairs >> np.uint64(48), prepend=np.uint64(1 << 20)))
            offsets = pa.array(np.append(cut, len(pairs)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((pairs & np.uint64((1 << 48) - 1)).view(np.int64), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array((pairs[cut] >> np.uint64(48)).astype(np.int32)), *arrays], ["bucket", "pairs", "times"])

    return windows


def _added(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """Add changes to rows of the table, each over the root of the squares that its row has seen."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    change, rows = np.add.reduceat(change[order], first), rows[order][first]
    seen[rows] += (change * change).mean(axis=1)
    table[rows] += RATE * change / np.sqrt(seen[rows] + 1e-8)[:, None]


def _learned(pairs: np.ndarray, times: np.ndarray, word: np.ndarray, word_seen: np.ndarray, near: np.ndarray, near_seen: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> None:
    """Skip-grams with negative sampling over the pairs of two buckets, whose tables change."""
    pairs, back = np.unique(pairs, return_inverse=True)
    order = rng.permutation(len(pairs))
    a, b, w = (pairs >> 24)[order], (pairs & 0xFFFFFF)[order], np.bincount(back, times).astype(np.float32)[order]
    share = np.cumsum(n.astype(float) ** 0.75)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    some = min(8192, max(16, len(a) // 64))
    for at in range(0, len(a), some):
        i, j, k = a[at : at + some], b[at : at + some], w[at : at + some, None]
        drawn = np.minimum(np.searchsorted(share, rng.random(DRAWN) * share[-1]), len(n) - 1)
        u, v, z = word[i], near[j], near[drawn]
        hit = k * (1 - logistic((u * v).sum(axis=1, keepdims=True)))
        miss = k * np.float32(NEGATIVE / DRAWN) * logistic(u @ z.T)
        _added(near, near_seen, np.concatenate([j, drawn]), np.concatenate([hit * u, -miss.T @ u]))
        _added(word, word_seen, i, hit * v - miss @ z)


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, np.float32).tobytes()], pa.binary())


def _table(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(column[0].as_py(), np.float32).reshape(-1, width).copy()


def _step(size: int, seed: int, turn: int, shift: int):
    """The parameters of a bucket of words and one of contexts after their pairs."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        word, near = (_table(left.column(c), size) for c in ("word", "near"))
        word_seen, near_seen, n = (_table(left.column(c), 1)[:, 0] for c in ("word_seen", "near_seen", "n"))
        flat = [right.column(c).combine_chunks().flatten().to_numpy() for c in ("pairs", "times")]
        _learned(*flat, word, word_seen, near, near_seen, n, np.random.default_rng([seed, turn, shift, left.column("bucket")[0].as_py()]))
        changed = {"word": word, "word_seen": word_seen, "near": near, "near_seen": near_seen}
        return pa.table([_numbers(changed[c]) if c in changed else left.column(c) for c in left.column_names], left.column_names)

    return step


def word_vectors(rows: DataFrame, id: str = "doc_id", size: int = 150, window: int = 6, least: int = 3, rounds: int = 15, parts: int | None = None, seed: int = 42) -> DataFrame:
    """(word, vector) by skip-grams with negative sampling from all rows (id, pos, token) of
    phrased(), for every token that comes `least` times: no cap on words or documents.

    Words are dealt into buckets. The pairs of a word of one bucket and a context of another are
    one block; in each step of a round every bucket of words meets another bucket of contexts, so
    that the blocks of a step learn side by side, and after as many steps as there are buckets all
    have. A task holds the parameters of two buckets, and no task, nor the driver, the whole table.
    The pairs, many times the text, are never stored: each step makes its own from the coded texts.
    A step's parameters replace those of the step before the last."""
    spark = rows.sparkSession
    vocabulary = written(rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least), "vocabulary", tidy=True)
    held = vocabulary.agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).first()
    if not held["words"]:
        return spark.createDataFrame([], "word string, vector array<double>")
    buckets = min(255, parts or max(-(-held["words"] // BUCKET), min(LEAST_BUCKETS, -(-held["tokens"] // PART_TOKENS)), math.isqrt(held["tokens"] // BLOCK_TOKENS)))
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("token")) - 1
    index = written(vocabulary.withColumn("bucket", bucket).withColumn("place", place), "places", tidy=True)
    codes = index.select("token", F.shiftleft("bucket", 24).bitwiseOR(F.col("place")).alias("code"))
    texts = _by_parts(rows, lambda some: some.join(codes, "token").groupBy(id).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("p")).select(F.transform("p", lambda x: x["code"]).alias("tokens")), "texts", id)

    def started(every: pa.Table, words: pa.Table) -> pa.Table:
        i, n = every.column("bucket")[0].as_py(), words.sort_by("place").column("n").to_numpy()
        first = (np.random.default_rng([seed, i]).random((len(n), size)) - 0.5) / size
        return pa.table({"bucket": pa.array([i], pa.int32()), "word": _numbers(first), "word_seen": _numbers(np.zeros(len(n))), "other": pa.array([i], pa.int32()), "near": _numbers(np.zeros((len(n), size))), "near_seen": _numbers(np.zeros(len(n))), "n": _numbers(n)})

    shape = "bucket int, word binary, word_seen binary, other int, near binary, near_seen binary, n binary"
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    model = written(every.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(started, shape), "model", tidy=True)
    places = [scratch(spark, "model") for _ in range(2)]
    for turn in range(rounds):
        for shift in range(buckets):
            near = model.select(F.pmod(F.col("other") - shift, F.lit(buckets)).cast("int").alias("bucket"), "other", "near", "near_seen", "n")
            both = model.select("bucket", "word", "word_seen").join(near, "bucket").select(*(c.split()[0] for c in shape.split(", ")))
            pairs = texts.mapInArrow(_windows(buckets, window, shift), "bucket int, pairs array<long>, times array<int>")
            places.reverse()
            model = written(both.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(_step(size, seed, turn, shift), shape), "model", tidy=True, over=places[0])

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        words = left.sort_by("place").column("token")
        vectors = _table(right.column("word"), size).astype(np.float64)
        return pa.table({"word": words, "vector": pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * size), pa.array(vectors.ravel()))})

    return index.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(spread, "word string, vector array<double>")


def expanded_groups(docs: DataFrame, groups: DataFrame, top: int = 10, least: float = 0.6, letters: int = 4, cosine_least: float = 0.5, pmi_least: float = 0.02, gated: list[str] | None = None, phrase_least: int = 5, threshold: float = 10.0, **learner) -> DataFrame:
    """From a corpus (doc_id, tokens) and groups (group, seed) of known keywords to new ones: (group,
    word, display, similarity, similar_to, mean_cosine, mean_pmi).

    Phrases are found and joined, word vectors learned, each seed taken as its token (phrases too),
    and the `top` neighbours of a seed's vector kept from a similarity of `least` on, with `letters`
    letters, if they are no group's seed; a word stays with its best seed in a group. Words of the
    `gated` groups (null: all) also pass both gates: their mean cosine with the group's seeds, and their mean
    PMI with those in documents. Seeds without a vector suggest nothing. Each step's table is
    written once; the groups are a short list, worked through one by one at the gates."""
    found = written(phrases(docs, least=phrase_least, threshold=threshold), "phrases", tidy=True)
    text = _by_parts(docs, lambda some: phrased(some, found), "phrased")
    vectors = written(word_vectors(text, **learner), "vectors", tidy=True)
    seeds = written(groups.join(seed_tokens(groups.select("seed").distinct(), found), "seed").select("group", "seed", "token").distinct(), "seeds")
    held = written(vectors.join(seeds.withColumnRenamed("token", "word"), "word").select("group", "seed", "word", "vector"), "held")
    near = all_neighbours(vectors, held.select(F.col("word").alias("seed"), "vector").distinct(), top, least).withColumnRenamed("seed", "token")
    near = near.join(seeds.select(F.col("token").alias("word")).distinct(), "word", "left_anti").where(F.length(F.replace("word", F.lit("_"), F.lit(""))) >= letters)
    best = F.row_number().over(Window.partitionBy("group", "word").orderBy(F.desc("similarity"), "seed"))
    new = near.join(seeds, "token").withColumn("_n", best).where("_n = 1").select("group", "word", F.replace("word", F.lit("_"), F.lit(" ")).alias("display"), F.round("similarity", 4).alias("similarity"), F.col("seed").alias("similar_to"))
    new = written(new, "suggestions", tidy=True)
    names = [r["group"] for r in groups.select("group").distinct().orderBy("group").collect()]  # a short list
    tokens_of = {g: [r["token"] for r in seeds.where(F.col("group") == g).select("token").collect()] for g in names}
    needed = new.select(F.col("word").alias("token")).union(seeds.select("token")).distinct()
    some = written(text.join(needed, "token", "left_semi").select("token", "doc_id").distinct(), "index", tidy=True)
    total = text.agg(F.countDistinct("doc_id").alias("n")).first()["n"]
    cosines = reduce(DataFrame.unionAll, [mean_cosine(vectors, held.where(F.col("group") == g).select("vector")).withColumn("group", F.lit(g)) for g in names])
    pmis = reduce(DataFrame.unionAll, [mean_pmi(some, tokens_of[g], total).withColumn("group", F.lit(g)) for g in names])
    return relevant(new, cosines, pmis, gated, cosine_least, pmi_least)


def expanded(vectors: DataFrame, seeds: DataFrame, existing: DataFrame, top: int = 10, least: float = 0.6, letters: int = 4) -> DataFrame:
    """(word, display, similarity, similar_to): of the `top` vectors (word, vector) nearest
    to each of seeds (seed, vector) those of a similarity of `least`, not in
    existing (term) and of `letters` characters or more, each with its best seed."""
    near = all_neighbours(vectors, seeds, top).where(F.col("similarity") >= least)
    near = near.where(F.length(F.regexp_replace("word", "_", "")) >= letters).join(existing.select(F.col("term").alias("word")).distinct(), "word", "left_anti")
    return best_seed(near).select("word", F.regexp_replace("word", "_", " ").alias("display"), F.round("similarity", 4).alias("similarity"), "similar_to")


def appended(catalogue: DataFrame, suggestions: DataFrame, groups: DataFrame) -> DataFrame:
    """catalogue (strategy, term) and the suggestions (group, word) that it doesn't have,
    whatever the case, under the strategies that groups (group, strategy) map theirs to."""
    new = suggestions.join(groups, "group").select("strategy", F.col("word").alias("term"))
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy("strategy", F.lower("term")).orderBy("term"))).where("_n = 1")
    there = catalogue.select(F.col("strategy").alias("_s"), F.lower("term").alias("_t"))
    return catalogue.unionByName(new.join(there, (F.col("strategy") == F.col("_s")) & (F.lower("term") == F.col("_t")), "left_anti").select("strategy", "term"))


def fused(candidates: DataFrame, pmi_least: float, cosine_least: float, band: float, confidence: float) -> DataFrame:
    """Labels of candidates (word, pmi_polarity, w2v_polarity) by the summed votes of
    both: ties go to rise, then fall; weak, neutral and unsure words are left out."""
    rows = candidates.where((F.abs("pmi_polarity") >= pmi_least) | (F.abs("w2v_polarity") >= cosine_least))
    pairs = zip(votes(F.col("pmi_polarity"), band), votes(F.col("w2v_polarity"), band), strict=True)
    rise, neutral, fall = ((a + b) / 2 for a, b in pairs)
    rows = rows.select("*", rise.alias("vote_rise"), neutral.alias("vote_neutral"), fall.alias("vote_fall"))
    label = F.when((F.col("vote_rise") >= F.col("vote_fall")) & (F.col("vote_rise") >= F.col("vote_neutral")), "rise").when(F.col("vote_fall") >= F.col("vote_neutral"), "fall").otherwise("neutral")
    rows = rows.withColumn("label", label).withColumn("agreement_score", F.greatest("vote_rise", "vote_fall", "vote_neutral"))
    return rows.where((F.col("label") != "neutral") & (F.col("agreement_score") >= confidence))


def novel(suggestions: DataFrame, existing: DataFrame) -> DataFrame:
    """Suggestions (word) that are not in existing (term), whatever the case."""
    return suggestions.join(existing.select(F.lower("term").alias("_t")).distinct(), F.lower("word") == F.col("_t"), "left_anti")


def report(suggestions: DataFrame, top: int = 10) -> DataFrame:
    """The `top` suggestions (group, word, similarity) of each group, with their ranks."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("similarity"), "word"))
    return suggestions.withColumn("rank", rank).where(F.col("rank") <= top)
