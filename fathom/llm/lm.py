"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Documents are dealt into blocks. Each block explodes into rows (gram, block, place,
own): the hash of each of its distinct n-grams of every order, the n-gram's place
among them, and how often the block has it. Rows are partitioned by the gram, where
a sum over all blocks is count table and join at once; n-grams that no other block
has end there. Each block gets the counts of its other n-grams back, and scores are
summed for each document.

N-grams that most blocks have are told by a few blocks, SAMPLED of them, and don't
become rows of the blocks at all: each task sums them over its blocks first, so that
a frequent word has one row a task, and their counts, FREQUENT an order at most, go
to the blocks as a whole. Which n-grams these are changes the work, not the result.
The orders are worked through one after the other, and the hashes of each in SPLITS
parts, so that only that share of the rows lies in shuffle files at once; a step's
files go when it is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import blocks
from fathom.llm.base import ARROW_BYTES, bounded_batches, written

ORDER, BACKOFF = 3, 0.4
#: Parts of an order's range of hashes, a power of two; rows of a partition of one of them;
#: parts in which the blocks are scored.
SPLITS, PART_ROWS, SIDES = 2, 1_500_000, 4
#: Blocks that tell frequent n-grams, those that half of them have, and how many an order has at most.
SAMPLED, FREQUENT = 5, 1 << 15
#: Blocks of a file: some MB each, so that a task's memory doesn't follow its share of the input.
FILE_BLOCKS = 4
#: Rows of an Arrow batch.
_SOME = 1 << 16


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch: its documents, their numbers of words, the hashes of its
    distinct words, frequent ones first, and each word's place in these."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, hashes = [], []
        for _, _, data, offsets in blocks.text_slices(batch.column("text")):
            data = blocks.LOWER[data]
            start, end, text = blocks.words(data, offsets, blocks.SOLID)
            hashes.append(blocks.span_hashes(data, start, end))
            sizes.append(np.bincount(text, minlength=len(offsets) - 1))
        known, place, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        size = np.concatenate(sizes).astype(np.int32)
        columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (size, known[order].view(np.int64), rank[place])]
        yield pa.RecordBatch.from_arrays(columns, ["block", "words", "doc_ids", "sizes", "known", "places"])


_BLOCK = "block long, words long, doc_ids array<long>, sizes array<int>, known array<long>, places array<int>"


def _held(table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words of a block's documents, the document of each word, its hash)."""
    sizes, known, places = (np.asarray(table.column(c)[k].values) for c in ("sizes", "known", "places"))
    return sizes, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), known.view(np.uint64)[places]


def _ngrams(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram that lies in one document, the word at which it begins)."""
    grams, whole = blocks.runs(hashes, text, n)
    return grams[whole], np.flatnonzero(whole).astype(np.int32)


def _steps(order: int, splits: int) -> list[list[tuple[int, int | None]]]:
    """What each step counts: orders and parts of their hashes. The first step, which has
    the most rows, is of single words, whole, and the first pairs; the last ones, beside
    the counts of all others, are of the other pairs, which are the fewest."""
    if order == 1:
        return [[(1, None)]]
    return [[(2, 0), (1, None)], *([(n, p)] for n in range(order, 1, -1) for p in range(splits) if (n, p) != (2, 0))]


def _frequent(order: int):
    """(n, gram): the n-grams of each order that half of the blocks have, two at least."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_held(batch, k)[1:] for batch in batches for k in range(batch.num_rows)]
        for n in range(1, order + 1):
            some = np.concatenate([np.unique(_ngrams(text, hashes, n)[0]) for text, hashes in held] or [np.zeros(0, np.uint64)])
            some.sort()
            first = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(some) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(some)))
            at = np.flatnonzero(2 * count >= max(4, len(held)))
            at = at[np.argsort(-count[at], kind="stable")[:FREQUENT]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(some[first[at]].view(np.int64))], ["n", "gram"])

    return frequent


def _within(grams: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of grams are in some, their places there); some is sorted."""
    if not len(some):
        return np.zeros(len(grams), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(some, grams), len(some) - 1)
    found = some[at] == grams
    return found, at[found]


def _exploded(order: int, shift: int, step: list[tuple[int, int | None]], frequent: list[np.ndarray]):
    """The rows of each block's distinct n-grams of a step; places of one order leave the
    same remainder when divided by `order`. What varies least comes first in a row, so
    that rows compress well. Frequent n-grams have one row each at the end of a task,
    of block -1, with their sum and their place among the frequent ones."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(len(frequent[n - 1]), np.int64) for n, _ in step}
        for batch in batches:
            for k in range(batch.num_rows):
                _, text, hashes = _held(batch, k)
                for n, part in step:
                    found, _ = _ngrams(text, hashes, n)
                    grams, own = np.unique(found if part is None else found[found >> np.uint64(shift) == part], return_counts=True)
                    places = np.arange(len(grams), dtype=np.int32) * np.int32(order) + np.int32(n - 1)
                    known, at = _within(grams, frequent[n - 1])
                    sums[n][at] += own[known]
                    yield from _rows(batch.column("block")[k].as_py(), own[~known], grams[~known], places[~known])
        for n, total in sums.items():
            at = np.flatnonzero(total)
            yield from _rows(-1, total[at], frequent[n - 1][at], (at * order + n - 1).astype(np.int32))

    return explode


def _rows(block: int, own: np.ndarray, grams: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(x) for x in (np.full(len(grams), block), own.astype(np.int32), grams.view(np.int64), places)]
    rows = pa.RecordBatch.from_arrays(columns, ["block", "own", "gram", "place"])
    for at in range(0, len(grams), _SOME):
        yield rows.slice(at, _SOME)


def _sorted(grams: np.ndarray) -> np.ndarray:
    """np.argsort(grams, kind="stable"): hashes without their last bits, and places in
    those, sort much faster as numbers; where that leaves two apart, the slow way."""
    bits = np.uint64(len(grams).bit_length())
    packed = np.sort((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64))
    sort = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    mixed = (packed[1:] >> bits == packed[:-1] >> bits) & (grams[sort[1:]] != grams[sort[:-1]])
    return np.argsort(grams, kind="stable") if mixed.any() else sort


def _others(grams: np.ndarray, of: np.ndarray, counts: list[tuple[int, np.ndarray, np.ndarray]], frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often other documents than its own (`of`) have each n-gram. counts: for each
    part of the hashes where it begins, and places and counts of the n-grams that other
    blocks have too; frequent: the frequent n-grams and their counts. N-grams of one
    document follow each other, so a stable sort keeps equal ones together."""
    sort = _sorted(grams)
    grams, of = grams[sort], of[sort]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    first = np.flatnonzero(new)
    keys, often = grams[first], np.diff(np.append(first, len(grams)))
    known = often.copy()
    for begin, place, n in counts:
        known[np.searchsorted(keys, np.uint64(begin)) + place] = n
    inside, at = _within(keys, frequent[0])
    known[inside] = frequent[1][at]
    rest = np.repeat(known, often)
    new[1:] |= of[1:] != of[:-1]
    run = np.diff(np.append(np.flatnonzero(new), len(grams)))
    rest -= np.repeat(run, run)
    out = np.empty(len(grams))
    out[sort] = rest
    return out


def _scores(sizes: np.ndarray, text: np.ndarray, hashes: np.ndarray, counts: list[list[tuple[int, np.ndarray, np.ndarray]]], frequent: list[tuple[np.ndarray, np.ndarray]], backoff: float, total: int) -> np.ndarray:
    """The sum of the log scores of each document's words, from the counts of each order."""
    most = np.minimum(np.arange(len(text), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes), len(counts) - 1)
    score, last = np.zeros(0), np.zeros(0)
    for n, some in enumerate(counts, 1):
        grams, begin = _ngrams(text, hashes, n)
        found = np.zeros(len(text))
        found[begin + n - 1] = _others(grams, text[begin], some, frequent[n - 1])
        del grams, begin
        if n == 1:
            score = np.log(np.maximum(found, 0.5) / np.maximum(total - sizes[text], 1)) + np.log(backoff) * most
        else:
            seen = np.flatnonzero(found > 0)
            score[seen] = np.log(found[seen] / last[seen - 1]) + np.log(backoff) * (most[seen] - (n - 1))
        last = found
    return np.bincount(text, score, len(sizes)) if len(text) else np.zeros(len(sizes))


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, splits: int = SPLITS) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs over the words) and score, its
    mean, for each row of docs (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased. A word's score
    is the share of its longest n-gram, up to `order`, that other documents have,
    times `backoff` for each word that the n-gram falls short; a word that no other
    document has counts half an occurrence among all their words. Texts without words,
    null or empty, have a sum of 0 and no mean. Rows that repeat are documents of
    their own, so copies make each other likely; ids may be null.
    """
    spark = docs.sparkSession
    if splits < 2 or splits & (splits - 1):
        raise ValueError("splits must be a power of two")
    bounded_batches(spark, 1900, ARROW_BYTES * 3 // 4)
    shift, steps = 64 - (splits.bit_length() - 1), _steps(order, splits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = written(rows.mapInArrow(_blocks, _BLOCK), "blocks", compression="zstd", rows=FILE_BLOCKS)
    total = cut.agg(F.sum("words")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * order // (len(steps) * PART_ROWS)))
    few = [r["block"] for r in cut.select("block").orderBy("block").limit(SAMPLED).collect()]
    found = cut.where(F.col("block").isin(few)).coalesce(1).mapInArrow(_frequent(order), "n int, gram long").collect()  # FREQUENT an order at most
    frequent = [np.sort(np.array([r["gram"] for r in found if r["n"] == n], np.int64).view(np.uint64)) for n in range(1, order + 1)]
    bounded_batches(spark, _SOME)
    counted = []
    for at, step in enumerate(steps):
        each = cut.mapInArrow(_exploded(order, shift, step, frequent), "block long, own int, gram long, place int").repartition(parts, "gram")
        each = each.withColumn("n", F.sum("own").over(Window.partitionBy("gram"))).where("n > own or block < 0").select("block", "place", "n")
        counted.append(written(each, "counts").withColumn("step", F.lit(at)))
    counts = reduce(DataFrame.unionAll, counted)
    sums = [np.zeros(len(grams), np.int64) for grams in frequent]
    for r in counts.where("block < 0").select("place", "n").distinct().collect():  # as many as there are frequent n-grams
        sums[r["place"] % order][r["place"] // order] = r["n"]
    counts, known = counts.where("block >= 0"), list(zip(frequent, sums, strict=True))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        at, place, n = (np.asarray(right.column(c)) for c in ("step", "place", "n"))
        each: list[list] = [[] for _ in range(order)]
        for k, step in enumerate(steps):
            for m, part in step:
                own = np.flatnonzero((at == k) & (place % order == m - 1))
                each[m - 1].append(((part or 0) << shift, place[own] // order, n[own]))
        del at, place, n
        held = _held(left, 0)
        found = _scores(*held, each, known, backoff, total)
        size = held[0].astype(np.int64)
        mean = np.divide(found, size, out=np.zeros(len(size)), where=size > 0)
        return pa.table({"doc_id": left.column("doc_ids")[0].values.cast(pa.int64()), "n_words": size, "log_score": found, "score": pa.array(mean, mask=size == 0)})

    done = []
    for k in range(SIDES):
        some = [x.where(F.pmod("block", F.lit(SIDES)) == k).groupBy("block") for x in (cut, counts)]
        done.append(written(some[0].cogroup(some[1]).applyInArrow(scored, "doc_id long, n_words long, log_score double, score double"), "scores"))
    return reduce(DataFrame.unionAll, done)
