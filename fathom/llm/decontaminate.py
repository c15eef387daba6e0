"""Benchmark decontamination by winnowing.

Of the hashes of all k-word grams, the smallest in each window of w consecutive
grams is kept as a fingerprint. Two texts that share k + w - 1 words share a
fingerprint in them, so joining fingerprints and extending each match word by
word finds every shared run of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import blocks
from fathom.llm.base import bounded_batches, written

#: Words of a shared run, and of a fingerprinted gram.
RUN, GRAM = 10, 5
#: Bits of the constant-size filter that document fingerprints pass before the join.
FILTER_BITS = 1 << 24

_PRINT = T.ArrayType(T.StructType([
    T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()),
    T.StructField("gram", T.StringType()), T.StructField("left", T.ArrayType(T.StringType())), T.StructField("right", T.ArrayType(T.StringType())),
]))
_ARROW = pa.list_(pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("gram", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def winnow(grams: np.ndarray, valid: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest gram (the last on ties) of every window in one text."""
    size = len(grams) - window + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:size].copy(), np.arange(size)
    for k in range(1, window):
        less = grams[k : k + size] <= best
        best = np.where(less, grams[k : k + size], best)
        at = np.where(less, np.arange(k, k + size), at)
    whole = valid[:size] & valid[window - 1 :] & (text[:size] == text[window - 1 : window - 1 + size])
    return np.unique(at[whole])


def _fingerprints(batches: Iterator[pa.RecordBatch], run: int, gram: int, lengths: list[int] | None, keep: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Adds n_words and prints to the rows. lengths: of short items, of which all
    grams are taken; None: the text is an item, short if it has under `run` words."""
    for batch in batches:
        counts, prints = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
        for row, _, data, offsets in blocks.text_slices(batch.column("text")):
            data = blocks.LOWER[data]
            start, end, text = blocks.words(data, offsets, blocks.ALNUM)
            per = np.bincount(text, minlength=len(offsets) - 1)
            counts[row : row + len(per)] = per
            base = np.cumsum(per) - per
            hashes = blocks.span_hashes(data, start, end)
            raw = data.tobytes()
            word = lambda i: raw[start[i] : end[i]].decode("utf-8", "replace")  # noqa: E731, B023
            found = []
            g, valid = blocks.runs(hashes, text, gram)
            found.append((gram, winnow(g, valid, text[: len(g)], run - gram + 1), g))
            for n in range(1, run) if lengths is None else lengths:
                g, valid = blocks.runs(hashes, text, n)
                if lengths is None:
                    valid = valid & (per[text[: len(g)]] == n)
                found.append((-n, np.flatnonzero(valid), g))
            for n, at, g in found:
                if keep is not None:
                    at = at[_passes(keep, g[at], n)]
                for i, fp in zip(at.tolist(), g[at].view(np.int64).tolist(), strict=True):
                    d = int(text[i])
                    low, high, m = int(base[d]), int(base[d] + per[d]), abs(n)
                    room = run - m if n > 0 else 0
                    prints[row + d].append({
                        "fp": fp, "n": n, "pos": i - low, "gram": " ".join(map(word, range(i, i + m))),
                        "left": [word(j) for j in range(i - 1, max(low, i - room) - 1, -1)], "right": [word(j) for j in range(i + m, min(high, i + m + room))],
                    })
        columns = [batch.column(name) for name in batch.schema.names if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(prints, _ARROW)], [*names, "n_words", "prints"])


def _spots(fp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = blocks.mix(fp ^ np.uint64((n & 0xFF) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return x % np.uint64(FILTER_BITS), (x >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _passes(keep: np.ndarray, fp: np.ndarray, n: int) -> np.ndarray:
    a, b = _spots(fp, n)
    return ((keep[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (keep[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _filter_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's bytes that the rows' fingerprints set: (byte, bits)."""
    for batch in batches:
        bits: dict[int, int] = {}
        fp, n = np.array(batch.column("fp")).view(np.uint64), np.array(batch.column("n"))
        for m in np.unique(n):
            for spot in _spots(fp[n == m], int(m)):
                for s in spot.tolist():
                    bits[s >> 3] = bits.get(s >> 3, 0) | 1 << (s & 7)
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array(list(bits.values()), pa.int32())], ["byte", "bits"])


def _equal_run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def shared_runs(docs: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, runs) for docs (doc_id, text) and items (item_id, text).

    documents: doc_id, row_key, n_words, one row for each row of docs. runs: row_key,
    doc_id, item_id, start, end in words: a stretch in which every window of `run`
    words is in the item. An item of fewer words, but not none, is one window.
    Null and empty texts have no words; rows that repeat get equal row_keys and
    the runs once. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    item_rows = items.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([T.StructField("item_id", item_rows.schema["item_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("prints", _PRINT)])
    tests = written(item_rows.mapInArrow(lambda it: _fingerprints(it, run, gram, None, None), kind).select("item_id", F.explode("prints").alias("p")).select("item_id", "p.*"), "prints")
    lengths = sorted(-r["n"] for r in tests.where("n < 0").select("n").distinct().collect())  # under `run` rows
    keep = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in tests.select("fp", "n").distinct().mapInArrow(_filter_spots, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        keep[r["byte"]] = r["bits"]  # FILTER_BITS / 8 rows at most, whatever the items
    shared = spark.sparkContext.broadcast(keep)
    doc_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("prints", _PRINT)])
    marked = written(doc_rows.select("doc_id", "row_key", "text").mapInArrow(lambda it: _fingerprints(it, run, gram, lengths, shared.value), kind), "marked")
    hits = marked.select("doc_id", "row_key", F.explode("prints").alias("p")).select("doc_id", "row_key", *(F.col(f"p.{c}").alias(c) for c in ("fp", "n", "pos", "gram", "left", "right"))).distinct()
    both = hits.alias("h").join(tests.alias("t"), ["fp", "n", "gram"])
    grown = both.select("row_key", "doc_id", "item_id", "n", F.col("h.pos").alias("pos"), F.abs("n").alias("m"), _equal_run(F.col("h.left"), F.col("t.left")).alias("l"), _equal_run(F.col("h.right"), F.col("t.right")).alias("r"))
    runs = grown.where(F.expr(f"n < 0 or l + m + r >= {run}")).select("row_key", "doc_id", "item_id", F.expr("pos - l").alias("start"), F.expr("pos + m + r").alias("end")).distinct()
    return marked.drop("prints"), runs


def decontaminate(docs: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """What benchmark items have left in each document.

    Returns doc_id, n_words, n_hit (words inside a shared window), item_ids
    (sorted as strings), n_items, contaminated; a row for each row of docs, also
    for null ids. Items without an id mark words, but are not among item_ids. See
    shared_runs for nulls, short texts and repeats.
    """
    marked, runs = shared_runs(docs, items, run, gram)
    by_doc = runs.groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    zero = F.lit(0).cast("long")
    met = F.aggregate(
        "spans", F.struct(zero.alias("upto"), zero.alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"].cast("long")).alias("upto"), (a["n"] + F.greatest(zero, s["end"] - F.greatest(a["upto"], s["start"].cast("long")))).alias("n")), lambda a: a["n"],
    )
    by_doc = by_doc.select(F.col("row_key").alias("k"), F.col("doc_id").alias("d"), "item_ids", met.alias("n_hit"))
    joined = marked.join(by_doc, (marked["row_key"] == by_doc["k"]) & marked["doc_id"].eqNullSafe(by_doc["d"]), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    ).select("*", F.size("item_ids").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))
