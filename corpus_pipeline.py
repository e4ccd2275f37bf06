"""A training corpus from ``documents``: five stages, each an operator of the llm subpackage.

All stages take an empty table and give an empty one, read whole texts of any length, keep
columns that they don't know, and give the same rows when they run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm.exact_dedup import kept_documents, text_digest
from filingscope.llm.langid import fit, predict
from filingscope.llm.mixing import Mix
from filingscope.llm.near_dedup import near_duplicates
from filingscope.llm.packing import pack_documents
from filingscope.llm.queries import _tokenizer
from filingscope.llm.workspace import Workspace, spread, whole_row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no text or no letters); the others' lang is the predicted one, und if no document has a lang to learn from.

    Ids may be null; repeated rows are each kept or dropped. Of languages with equally
    many letters the first by code point is taken.
    """
    own = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    found = predict(docs, fit(docs), "text", *(F.col(c).alias(n) for c, n in own.items())).where("score > 0")
    return found.select(*(F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in own.items()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the largest doc_id.

    A null text equals the empty one, and a null id is smaller than any other. Of rows
    equal in id and text one stays; rows that share an id alone are told apart by text.
    """
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8), keep the document with the smallest doc_id; one without an id only if none has one.

    Rows are matched by id and text. Texts without a word are in no group and stay.
    """
    ws = Workspace(spark, "near-stage")
    row = F.xxhash64("doc_id", F.col("doc_id").isNull(), text_digest("text"))
    # The user's columns travel as one, so no name of theirs meets one of ours.
    keyed = docs.select(row.alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("words"), whole_row(docs))
    groups = near_duplicates(keyed, "key", "words").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("n"))
    ids = keyed.select("key", F.lit(None).cast("long").alias("group"), "id", F.lit(1).alias("n"))
    rows = ws.put(groups.unionByName(ids).groupBy("key").agg(F.max("group").alias("group"), F.max("id").alias("id"), F.sum("n").alias("n")), "rows")
    stay = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("key"))
    out = keyed.join(stay.select("key"), "key", "left_semi")
    if not rows.where("n > 1").isEmpty():
        # Of rows equal in id and text one stays, but for those without a word.
        out = out.withColumn("wordless", F.when(~F.coalesce("words", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.monotonically_increasing_id())).dropDuplicates(["key", "wordless"])
    return out.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the default weights: the taken runs of each document, as often as they are taken.

    A null source is a source of its own, null and wordless texts have nothing to take,
    and rows equal in id, source and text pool what is taken of them.
    """
    return Mix(docs).fragments(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens. Ids may be null or repeat: each row is packed; a null text is its closing id alone."""
    return pack_documents(docs, _tokenizer())


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]
#: The stages use trained models and hashes that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written and read again for the next; then what it was made from is deleted."""
    ws = Workspace(spark, "pipeline")
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        docs = ws.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            ws.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
