"""What the operators of this subpackage share: inputs, scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handed to a Python worker at once.
ARROW_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = ARROW_BYTES) -> None:
    """Limit Arrow batches by bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of, F.lit(-1)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy", rows: int = 0) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost
    executor costs no recomputation, and it is computed once however often read.
    The shuffle files that went into it are removed once it is there. rows: of a file
    at most, where they are large: a task holds all rows of a file that it writes or
    reads, up to some thousand."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).option("maxRecordsPerFile", rows).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node that the undirected
    edges reach. Alternates large-star and small-star steps until no edge
    changes; every step is two shuffles of the edges that remain, and each
    round is written to the shared folder. Nulls and loops are dropped."""
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(now, "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        wide = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: smaller neighbours, and the node itself, go to the smallest one
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        now = written(near, "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.sum(F.xxhash64("u", "v") % 1000003).alias("x")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
