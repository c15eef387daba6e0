"""A corpus pipeline: each stage reads what the one before it kept.

Documents of low quality go, one document of each group of near duplicates stays,
documents that hold benchmark passages go, secrets are masked, and what is left is
packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import queries
from fathom.llm.base import scratch, table
from fathom.llm.decontaminate import decontaminate
from fathom.llm.neardup import near_duplicates
from fathom.llm.packing import pack
from fathom.llm.quality import score
from fathom.llm.secrets import redact, scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. The model learns from the table
    of documents, whatever docs holds."""
    model = queries.quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    return score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a 64-bit hash of each row, nulls told apart: what decisions are
    made by, since ids may be null or shared. Exact repeats of a row have one `_row`."""
    return docs.select(*COLUMNS, F.xxhash64(*(F.col(c).isNull() for c in COLUMNS), *COLUMNS).alias("_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, one without
    an id if none has one. Rows that share an id are documents of their own; of exact
    repeats of a row one stays. Texts without words are like no others."""
    rows = _rows(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    kept = found.join(rows.select("doc_id", "_row").distinct(), "_row").groupBy("component_id").agg(first.alias("_row"))
    return rows.dropDuplicates(["_row"]).join(kept, "_row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window of words with a benchmark item, whatever their ids."""
    rows = _rows(docs)
    found = decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars as it is then."""
    clean = redact(scan(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, queries.vocabulary(), end_id=0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the classifier, the Markov models and the patterns of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
