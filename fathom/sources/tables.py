"""Reading and writing article tables by strategy and month."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.articles import month, upserted
from fathom.operators.series import keep_first

BY = ("query_strategy", "year_month")


def write_months(rows: DataFrame, path: str, date: str = "date") -> None:
    """Overwrites the months that rows hold, a folder for each strategy and month."""
    out = rows.withColumn("year_month", month(F.col(date)))
    out.repartition(*BY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY).parquet(path)


def read_months(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """All strategies; months outside first..last are not opened."""
    rows = spark.read.parquet(path).withColumn("year_month", F.col("year_month").cast("string"))
    rows = rows.where(F.col("year_month") >= first) if first else rows
    return rows.where(F.col("year_month") <= last) if last else rows


def upsert_months(new: DataFrame, path: str, scratch: str, key: str = "id", date: str = "date") -> None:
    """Adds rows with new keys to the months they belong to; rows that are there stay."""
    spark = new.sparkSession
    new = new.withColumn("year_month", month(F.col(date)))
    try:
        old = read_months(spark, path)
    except AnalysisException as e:  # the first rows
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return write_months(keep_first(new, [key], [date]), path, date)
    there = old.join(F.broadcast(new.select("year_month").distinct()), "year_month", "left_semi")
    upserted(there, new, key, date).write.mode("overwrite").parquet(scratch)  # not read and overwritten at once
    write_months(spark.read.parquet(scratch), path, date)


def prices(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(date, close) of a CSV, numbers only, in order, within first..last where given."""
    rows = spark.read.schema("date string, close string").option("header", True).csv(path)
    rows = rows.select(F.try_to_date("date").alias("date"), F.col("close").try_cast("double").alias("close")).dropna()
    rows = rows.where(F.col("date") >= F.lit(first).cast("date")) if first else rows
    return (rows.where(F.col("date") <= F.lit(last).cast("date")) if last else rows).orderBy("date")
