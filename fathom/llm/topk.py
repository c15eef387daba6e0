"""Exact top-k neighbours of binary codes by incremental multi-index hashing.

A code is cut into m segments, and an index maps (segment, value) to codes. A
query probes values within a radius of its own in every segment; the radius
grows by one each round. After radius r every code at a distance of up to
m * (r + 1) - 1 has been met, because one that is farther than r in every
segment differs in m * (r + 1) bits. A query is settled once the distance of its
k-th verified neighbour is covered in this sense, and only the others go on. Codes
farther than the k-th of a few from its own buckets never leave the join, and a
bucket of very many codes is dealt out over salts.

Probes are many times what Spark estimates from the rows that they are exploded
from, so joins of what grows with the table say how both sides are shuffled: else
the driver would collect and broadcast one. Probes aren't sorted: the index, a part
of it at a time, is hashed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.base import written

K, EVERY = 10, 50
#: Codes of a bucket for each of the salts that it is dealt out over.
SALTED = 20_000


def sign_code(vector: str) -> Column:
    """64 bits: bit i is set where element i of the vector is positive."""
    none = F.lit(0).cast("long")
    bits = F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(none))
    return F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))


def widths(n: int, bits: int) -> list[int]:
    """Segment widths: values hold about four of n codes, and no segment has over 20 bits."""
    each = min(20, max(8, int(math.log2(max(n, 2))) - 2))
    m = math.ceil(bits / each)
    return [bits // m + (j < bits % m) for j in range(m)]


def masks(width: int, ones: int) -> list[int]:
    """All numbers of `width` bits of which `ones` are set."""
    if not ones:
        return [0]
    found, x = [], (1 << ones) - 1
    while x < 1 << width:
        found.append(x)
        low = x & -x
        carry = x + low
        x = carry | ((x ^ carry) >> 2) // low
    return found


def _segments(code: str, of: list[int]) -> Column:
    """array of (segment, value)."""
    parts, at = [], 0
    for j, w in enumerate(of):
        value = F.shiftrightunsigned(F.col(code), at).bitwiseAND(F.lit((1 << w) - 1).cast("long")).cast("int")
        parts.append(F.struct(F.lit(j).alias("segment"), value.alias("value")))
        at += w
    return F.array(*parts)


def _probes(of: list[int], ones: int) -> Column:
    """For a row of (segment, value), all values that differ in `ones` bits."""
    choice = None
    for w in sorted(set(of)):
        flips = masks(w, ones) if ones <= w else []
        column = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>") if flips else F.array().cast("array<int>")
        here = F.col("segment").isin([j for j, x in enumerate(of) if x == w])
        choice = F.when(here, column) if choice is None else choice.when(here, column)
    return F.transform(choice, lambda flip: F.col("value").bitwiseXOR(flip))


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(query, kth) of found (query, code, members, distance): the distance within which
    more than k rows lie; no row for a query with fewer."""
    run = Window.partitionBy("query").orderBy("distance")
    sums = found.groupBy("query", "distance").agg(F.sum("members").alias("n")).withColumn("n", F.sum("n").over(run))
    return sums.where(F.col("n") > k).groupBy("query").agg(F.min("distance").alias("kth"))


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", way: str = "merge") -> DataFrame:
    """A join that never sends a side through the driver."""
    return left.join(right.hint(way), on, how)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = 64, salted: int = SALTED) -> DataFrame:
    """The k rows (id, code) nearest to each of queries (id, code) by Hamming
    distance, ties by id, without the row of the query's own id.

    Returns id, rank from 1, neighbor_id, distance. Null ids and codes are left out
    on both sides; fewer rows than k give fewer neighbours. Rows with one code are
    one entry of the index that keeps its k + 1 smallest ids, all that a query can
    return, so a code that very many rows share costs as much as any other.
    """
    rows = rows.where("id is not null and code is not null").select("id", "code").distinct()
    # the smallest k + 1 ids of a code in two steps: a code that a third of the rows has doesn't meet in one task
    part = Window.partitionBy("code", "salt").orderBy("id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1024))).withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    first = some.groupBy("code", "salt").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = first.groupBy("code").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    codes = written(codes.withColumn("members", F.size("ids")), "codes")
    asked = queries.where("id is not null and code is not null").select("id", "code").distinct()
    of = widths(codes.count(), bits)
    index = codes.select("code", "members", F.explode(_segments("code", of)).alias("s")).select("s.segment", "s.value", "code", "members")
    hot = written(index.groupBy("segment", "value").agg(F.ceil(F.count("*") / salted).alias("salts")).where("salts > 1"), "hot")  # codes * segments / `salted` rows at most
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    index = written(index.join(hot, ["segment", "value"], "left").withColumn("salt", F.pmod(F.xxhash64("code"), salts)).drop("salts"), "index")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
    asked_codes = asked.select(F.col("code").alias("query")).distinct()
    own = asked_codes.select("query", F.explode(_segments("query", of)).alias("s")).select("query", "s.segment", "s.value")
    few = index.where("salt = 0").withColumn("n", F.row_number().over(Window.partitionBy("segment", "value").orderBy("code"))).where(F.col("n") <= k + 1)
    near = _merged(own, few, ["segment", "value"]).select("query", "code", "members", distance.alias("distance")).distinct()
    open_ = written(_merged(asked_codes, _kth(near, k), "query", "left").select("query", F.coalesce("kth", F.lit(bits)).alias("bound")), "open")
    found = settled = None
    for ones in range(max(of) + 1):
        probes = open_.select("query", "bound", F.explode(_segments("query", of)).alias("s")).select("query", "bound", "s.segment", "s.value")
        probes = probes.select("query", "bound", "segment", F.explode(_probes(of, ones)).alias("value"))
        probes = probes.join(hot, ["segment", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        met = _merged(probes, index, ["segment", "value", "salt"], way="shuffle_hash").where(distance <= F.col("bound")).select("query", "code", "members", distance.alias("distance"))
        found = written((met if found is None else met.union(found)).distinct(), "found")
        kth = _kth(found, k)
        covered = len(of) * (ones + 1) - 1
        state = written(_merged(open_.select("query"), kth, "query", "left").select("query", F.coalesce("kth", F.lit(bits)).alias("bound")), "state")
        found = _merged(found, state, "query").where("distance <= bound").select("query", "code", "members", "distance")
        done = state.where((F.col("bound") <= covered) | F.lit(covered >= bits or ones == max(of))).select("query")
        ready = written(_merged(found, done, "query", "left_semi"), "settled")
        settled = ready if settled is None else settled.union(ready)
        open_ = written(_merged(state, done, "query", "left_anti"), "open")
        if open_.isEmpty():
            break
        found = written(_merged(found, open_, "query", "left_semi").select("query", "code", "members", "distance"), "found")
    listed = _merged(settled, codes.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    best = listed.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))).where(F.col("n") <= k + 1)
    pairs = _merged(asked, best.withColumnRenamed("query", "code"), "code").where("id <> neighbor_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k).select("id", "rank", "neighbor_id", "distance")
