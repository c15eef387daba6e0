"""Tables in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Shuffle files go when the table that they were made for is there.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, tidy: bool = False, over: str | None = None, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is read, and
    not again when an executor is lost. tidy: the shuffle files that went into it are removed
    once it is there. over: the folder of a table that it replaces, which df must not read."""
    spark, path = df.sparkSession, over or scratch(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite" if over else "error").option("compression", compression).parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before or "false")
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Limit the batches that Python workers get by rows and bytes, so that a worker's memory
    doesn't follow the lengths of pages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
