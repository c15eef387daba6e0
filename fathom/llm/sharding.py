"""Sharding through a permutation-filled lookup table.

Every shard has a permutation of the slots of a table whose size is prime: it
starts at an offset and goes on by a step, both hashes of its name. The shards
take turns to claim the next free slot of their permutation until the table is
full, so that shares differ by one slot at most and a change of the shards moves
few slots. A row goes to the shard of the slot that its key hashes to, which is
one look-up in a broadcast table of fixed size. Rows are placed by DataFrame
functions only; the table is a setting, made before any data is read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 256, 65537


def number(text: str) -> int:
    """The first 60 bits of the MD5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def number_of(column: Column) -> Column:
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("long")


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in names) of each slot."""
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, 3 at least")
    if not names or len(set(names)) < len(names) or len(names) > slots:
        raise ValueError("shards need distinct names, one at least and no more than slots")
    at = [number(f"offset {name}") % slots for name in names]
    step = [number(f"step {name}") % (slots - 1) + 1 for name in names]
    table, free = [-1] * slots, slots
    while True:
        for shard in range(len(names)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            table[at[shard]] = shard
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): as many rows as slots."""
    return spark.createDataFrame(list(enumerate(fill(names, slots))), "slot int, shard int")


def place(rows: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """rows with `slot` and `shard` by their key; columns of these names are replaced.

    Equal keys go to one shard, whatever else the rows hold; a null key counts as
    the text "null", and repeated rows are placed as often as they come. No row
    moves: the table is broadcast.
    """
    names = names or [f"shard-{k:05d}" for k in range(SHARDS)]
    table = lookup(rows.sparkSession, names, slots)
    slot = (number_of(F.coalesce(F.col(key).cast("string"), F.lit("null"))) % slots).cast("int")
    return rows.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot")
