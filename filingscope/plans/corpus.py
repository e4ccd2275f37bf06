"""The driver's tables as a corpus of filings, questions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.shared import spread

#: The day that recency is measured at: no operator reads the clock.
AS_OF = "2026-01-01"
#: Tables whose rows cost more to work on than to move.
TEXTS = ("documents", "pages")
URL = "https://records.example.org/filing/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, case_number, title, received_date, url and text; a third of the filings are one case's.

    An order is known by its key; grouped by it, so that Spark leaves the join out, and texts stay where they are read, when nobody asks for dates.
    """
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("filing_id")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("received_date"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing_id"), F.when(F.col("doc_id") % 3 == 0, "FC1000").otherwise(F.concat(F.lit("FC"), (1001 + F.col("doc_id") % 96).cast("string"))).alias("case_number"), F.substring("text", 1, 80).alias("title"), "text")
    return docs.join(orders, "filing_id", "left").withColumn("url", F.concat(F.lit(URL), F.col("filing_id").cast("string")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, message, terms and years."""
    bench = table(spark, sf_dir, "benchmark")
    return bench.select(F.col("item_id").alias("question_id"), F.col("text").alias("message"), text.query_terms(F.col("text")).alias("terms"), text.query_years(F.col("text"), AS_OF).alias("years"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role (user or model) and content."""
    talk = table(spark, sf_dir, "conversations").where("role != 'system'")
    return talk.select("conv_id", "turn", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
