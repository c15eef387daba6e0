"""Incremental loads and weekly aggregates as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.series import keep_first


def incremental(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Appends rows with new keys from files that weren't read yet; the checkpoint
    remembers files, the target remembers keys. Ends when all files are read."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(batch.sparkSession.read.parquet(target).select(key), key, "left_anti")
        except AnalysisException as e:  # the first batch has no target yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        rows.write.mode("append").parquet(target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpointed(
    spark: SparkSession, source: str, schema, target: str, state: str, checkpoint: str, key: str = "url", error: Column | None = None, files: int = 50, again: bool = False,
) -> StreamingQuery:
    """Appends rows with new keys to target, `files` files at a time, and all keys to state (key,
    error): rows for which `error` is not null are marked as done and not appended. Keys that
    state has are skipped; with `again` those that failed are tried once more.

    A batch writes folders of its own, whole, target before state. One that broke off and runs again
    overwrites what it wrote and doesn't count it as done, so nothing is lost or there twice."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("error", F.lit(None).cast("string") if error is None else error.cast("string"))
        rows = keep_first(rows.where(F.col(key).isNotNull()), [key], ["error"])
        try:
            done = batch.sparkSession.read.parquet(state).where(F.col("batch") != number)
            rows = rows.join((done.where("error is null") if again else done).select(key), key, "left_anti")
        except AnalysisException as e:  # the first batch has no state yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        rows = rows.persist()  # read for the target and for the state
        try:
            rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{target}/batch={number}")
            rows.select(key, "error").write.mode("overwrite").parquet(f"{state}/batch={number}")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events and mean value of each week to Friday from a stream of (ts, value)."""
    week = F.window("ts", "7 days", "7 days", "2 days")  # weeks begin on Saturdays
    return events.withWatermark("ts", late).groupBy(week.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.to_date(F.date_sub(F.col("w.end"), 1)).alias("week"), "n", "mean")
