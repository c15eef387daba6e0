"""Packing of documents into fixed-length sequences by cutting-stock column generation.

Documents longer than a sequence fill whole ones; what is left of each is shorter
than a sequence, and cut at half a sequence if it is longer than that, because
larger pieces leave gaps that no pattern fills. The histogram of pieces is a
cutting-stock instance: a linear program over patterns (how many pieces of each
size a sequence takes) whose columns an unbounded-knapsack dynamic program prices.
Its solution is rounded down, and patterns of what that leaves are priced by size.
Patterns are handed out to the pieces by their rank in their size class; the last
residue is laid end to end and cut at the ends of sequences.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.base import bounded_batches, written
from fathom.llm.tokens import encoder

#: Tokens of a sequence; the step of the size classes that patterns are made of.
CAPACITY, GRAIN = 1024, 2
#: Parts in which the pieces of one class are ranked, at most, and pieces of one of them.
MOST_SALTS, RANKED = 4096, 2000
#: Share of a sequence that a pattern fills at least.
FILL = 0.99


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits: unbounded knapsack over the capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(s, c, "right"))
        best[c] = best[c - 1]
        if k:
            gain = v[:k] + best[c - s[:k]]
            j = int(np.argmax(gain))
            if gain[j] > best[c] + 1e-12:
                best[c], take[c] = gain[j], j
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[order[take[c]]] += 1
            c -= int(s[take[c]])
    return float(best[capacity]), pattern


def fullest_pattern(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest pattern of the pieces that are left: bounded knapsack, sizes as prices."""
    last, used = [0] + [-1] * capacity, [0] * (capacity + 1)
    for s in sorted((s for s, n in left.items() if n), reverse=True):
        for c in range(s, capacity + 1):
            if last[c] < 0 <= last[c - s]:
                n = used[c - s] + 1 if last[c - s] == s else 1
                if n <= left[s]:
                    last[c], used[c] = s, n
        if last[capacity] >= 0:
            break
    c = max(k for k in range(capacity + 1) if last[k] >= 0)
    found: Counter = Counter()
    while c:
        found[last[c]] += 1
        c -= last[c]
    return dict(found)


def cut_patterns(demand: dict[int, int], capacity: int, fill: float = FILL, gap: float = 5e-3, rounds: int = 800) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: pieces} with how often each is used; together they hold at most
    the demand {size: pieces}. Column generation stops where the bound
    sequences / best price is within `gap` of the solution, or after `rounds`
    columns; every basis on the way is a feasible packing. Fractions are rounded
    down, and what is left gets patterns of its own, the fullest first. Only patterns
    filled to the share `fill` are kept: the pieces of the others are cut to measure
    by pack()."""
    sizes = np.array(sorted(s for s, d in demand.items() if d), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes.tolist()], float)
    basis = np.diag((capacity // sizes).astype(float))  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    amount = np.diag(inverse) * need
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # duals of one sequence each
        value, pattern = best_pattern(sizes, price, capacity)
        total = float(amount.sum())
        if value <= 1 + 1e-9 or total - total / value <= gap * total:
            break
        used = np.flatnonzero(pattern)
        step = (inverse[:, used] * pattern[used]).sum(axis=1)
        up = step > 1e-9
        ratio = np.where(up, amount / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        amount -= theta * step
        amount[out] = theta
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    tight = (sizes[:, None] * basis).sum(axis=0) >= fill * capacity
    left, found = need.astype(np.int64), []
    for j in np.flatnonzero(tight & (amount >= 1)).tolist():
        pattern = basis[:, j].astype(np.int64)
        held = pattern > 0
        times = min(int(amount[j] + 1e-7), int((left[held] // pattern[held]).min()))
        if times:
            left -= times * pattern
            found.append((dict(zip(sizes[held].tolist(), pattern[held].tolist(), strict=True)), times))
    rest = dict(zip(sizes.tolist(), left.tolist(), strict=True))
    while sum(s * n for s, n in rest.items()) >= fill * capacity:
        pattern = fullest_pattern(rest, capacity)
        if sum(s * n for s, n in pattern.items()) < fill * capacity:
            break
        times = min(rest[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            rest[s] -= n * times
        found.append((pattern, times))
    return found


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document's ids, as narrow as the vocabulary allows: whole
    sequences, then the rest, of which half a sequence is a piece of its own if it is
    longer. piece is a key of its own for each, so that documents that repeat stay
    apart."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.texts(batch.column("text"), end_id), strict=True):
                cuts = [*range(0, len(ids), capacity), len(ids)]
                if cuts[-1] - cuts[-2] < capacity and cuts[-1] - cuts[-2] > capacity // 2:
                    cuts.insert(-1, cuts[-2] + capacity // 2)
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                    part = ids[at:end].astype("<u4")
                    for to, x in zip(rows, (doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(enc.dtype).tobytes()), strict=True):
                        to.append(x)
            first = uuid.uuid4().int & (1 << 62) - 1
            columns = [pa.array(x, pa.int64()) for x in rows[:5]] + [pa.array(rows[5], pa.binary()), pa.array(range(first, first + len(rows[0])), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "piece"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, piece long")


def _cut_ids(tokenizer: str):
    """The `length` ids of a piece from its place `from` on, with their checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).dtype
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("ids", "from", "length")), strict=True)
            part = [np.frombuffer(ids, kind)[a : a + n].astype("<u4").tobytes() for ids, a, n in rows]
            crc = pa.array([zlib.crc32(x) for x in part], pa.int64())
            names = [n for n in batch.schema.names if n not in ("ids", "from", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), crc, pa.array(part, pa.binary())], [*names, "ids_crc32", "ids"])

    return cut


def _before(table: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """table with `before`, the sum of value in the rows ahead of each (a bounded table)."""
    row = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("before", F.coalesce(F.sum(value).over(row), F.lit(0).cast("long")))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, grain: int = GRAIN, salts: int | None = None) -> DataFrame:
    """Packs docs (doc_id, text; null text: empty) into sequences of `capacity` tokens.

    Returns for each piece doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (little-endian unsigned 32-bit integers). Every
    id of every document lies in one piece; offsets in a sequence have no gaps.
    Pieces that no tight pattern takes are laid end to end and cut at every
    `capacity` tokens, so that they are cut once in a sequence at most and only
    the last one is not full. Documents that repeat, with equal or null ids too,
    are packed as often as they come. The pieces of each of the capacity / grain classes
    are ranked in parts of about RANKED, MOST_SALTS at most, so that a class that very many
    pieces share, as empty texts do, is many tasks; `salts` sets one number for all.
    """
    spark = docs.sparkSession
    whole = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece"]
    none = F.lit(0).cast("long")
    # whole sequences are numbered by their place in a task's rows and the rows of the tasks before
    full = written(whole.drop("ids").where(F.col("length") == capacity).withColumn("row", F.monotonically_increasing_id()), "full")
    tasks = full.groupBy(F.shiftright("row", 33).alias("task")).agg(F.count("*").alias("n"))
    tasks = written(_before(tasks, "n", ["task"], []), "tasks")  # a row for each task
    first = tasks.agg(F.sum("n")).first()[0] or 0
    full = full.withColumn("task", F.shiftright("row", 33)).join(F.broadcast(tasks.drop("n")), "task")
    full = full.withColumns({"sequence_id": F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)), "offset": none, "from": none}).select(*columns, "from")

    cut = whole.drop("ids").where(F.col("length") < capacity).withColumn("size", (F.ceil(F.col("length") / grain) * grain).cast("int"))
    demand = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity / grain rows at most
    parts = spark.createDataFrame([(s, salts or min(MOST_SALTS, math.ceil(n / RANKED))) for s, n in demand.items()], "size int, salts int")
    cut = cut.join(F.broadcast(parts), "size").withColumn("salt", F.pmod(F.xxhash64("piece"), F.col("salts")).cast("int")).drop("salts")
    counts = written(cut.groupBy("size", "salt").agg(F.count("*").alias("n")), "histogram")
    patterns = [({k * grain: n for k, n in p.items()}, times) for p, times in cut_patterns({s // grain: n for s, n in demand.items()}, capacity // grain)]
    plan, given = [], Counter()
    for pattern, times in patterns:
        for s, n in sorted(pattern.items(), reverse=True):
            plan.append((s, given[s], given[s] + n * times, n, first))
            given[s] += n * times
        first += times
    # the ranks of a class are cut into as many equal ranges as it has slots, so that a piece meets the few slots of its range
    often = Counter(s for s, *_ in plan)
    width = {s: -(-given[s] // often[s]) for s in often}
    plan = [(*slot, k) for slot in plan for k in range(slot[1] // width[slot[0]], (slot[2] - 1) // width[slot[0]] + 1)]
    slots = spark.createDataFrame(plan, "size int, low long, high long, each long, sequence long, range long")  # twice the classes squared at most
    widths = spark.createDataFrame(list(width.items()), "size int, width long")
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1)
    before = _before(counts, "n", ["salt"], ["size"]).join(F.broadcast(widths), "size", "left").select("size", "salt", "before", "width")
    ranked = ranked.join(F.broadcast(before), ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).withColumn("_range", F.expr("rank div width"))
    fits = (ranked["size"] == slots["size"]) & (F.col("_range") == F.col("range")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ranked = written(ranked.join(F.broadcast(slots), fits, "left").drop(slots["size"]).drop("before", "width", "_range", "range"), "ranked")
    put = ranked.where("sequence is not null").withColumn("sequence_id", F.expr("sequence + (rank - low) div each"))
    row = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    put = put.withColumn("offset", F.coalesce(F.sum("length").over(row), none)).select(*columns, none.alias("from"))

    rest = ranked.where("sequence is null")
    laid = _before(rest.groupBy("size", "salt").agg(F.sum("length").alias("n")), "n", ["size", "salt"], [])  # classes * salts rows at most
    own = Window.partitionBy("size", "salt").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    at = rest.withColumn("at", F.coalesce(F.sum("length").over(own), none)).join(F.broadcast(laid.drop("n")), ["size", "salt"])
    at = at.withColumn("at", F.col("at") + F.col("before")).withColumn("into", F.expr(f"{capacity} - at % {capacity}"))
    two = F.expr("""explode(if(into < length, array(struct(0L as a, into as n), struct(into as a, length - into as n)), array(struct(0L as a, length as n))))""")
    at = at.withColumn("part", two)
    at = at.select(
        "doc_id", (F.col("start") + F.col("part.a")).alias("start"), F.col("part.n").alias("length"), "ids_crc32", "doc_tokens",
        F.expr(f"{first}L + (at + part.a) div {capacity}").alias("sequence_id"), F.expr(f"(at + part.a) % {capacity}").alias("offset"), "piece", F.col("part.a").alias("from"),
    )
    kind = ", ".join(f"{c} long" for c in columns if c not in ("ids_crc32", "piece"))
    full_ids = full.unionByName(put).unionByName(at).join(whole.select("piece", "ids"), "piece").drop("piece")
    return full_ids.mapInArrow(_cut_ids(tokenizer), f"{kind}, ids_crc32 long, ids binary").select(*columns[:-1], "ids")
