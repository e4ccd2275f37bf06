"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest: one row per distinct text, with the
id that stays and the batch that brought it. A batch of new documents is reduced to one
row per digest before anything is shuffled for the join; a sort-merge anti-join finds the
digests that the index lacks, and those are appended under the batch's name. What a batch
has appended itself is left out when it is decided, so a batch that is ingested again,
after a failure at any point, is decided as before and changes nothing.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import join_hot
from .workspace import Workspace, delete, shared_root, whole_row

#: Distinct texts that a bucket of a new index is meant for, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: str):
    """SHA-256 of the UTF-8 text after lower-casing A-Z only; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256))


class DigestIndex:
    """A saved table (digest, keep_id, batch), bucketed and sorted by digest.

    ``buckets`` is fixed when the table is made; by default its first batch's size and
    ``growth``, the number of such batches that it is meant for, tell how many.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int | None = None, growth: int = 1):
        self.spark, self.buckets, self.growth = spark, buckets, growth
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_root(spark)}/{self.table}"

    def read(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def create(self, rows: int) -> None:
        """An empty table, sized for a first batch of ``rows`` documents, unless there is one."""
        if self.read() is None:
            self.buckets = self.buckets or max(LEAST_BUCKETS, math.ceil(self.growth * rows / BUCKET_ROWS))
            self._write(self.spark.createDataFrame([], "digest binary, keep_id bigint, batch string"))

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add (digest, keep_id) under the batch's name, but for those that it has added before."""
        added = self.read().where(F.col("batch") == batch).select("digest")
        self._write(rows.hint("merge").join(added, "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch")))

    def drop(self) -> None:
        """Take the table and its files away; what ``ingest`` has returned doesn't need them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)

    def _write(self, rows: DataFrame) -> None:
        if self.buckets is None:
            spec = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(spec["data_type"])
        out = rows.repartition(self.buckets, "digest")
        out.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Decide each row of a batch and append the batch's new digests.

        One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal
        texts in the batch the row with the largest id stays, unless an earlier batch
        holds the text: then that batch's id is keep_id and none of these rows stays.
        Of rows equal in id too, one stays. A null text equals the empty one; a null
        id is smaller than any other. group_size counts the batch's rows. Extra
        columns are ignored; an empty batch changes nothing. ``batch`` names the batch, by
        default after its ids and texts in any order; a batch that was ingested before is
        given the same rows again.
        """
        ws = Workspace(self.spark, "exact")
        rows = ws.put(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
        classes = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
        n, mark = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)"))).first()
        batch = batch or f"{n}-{mark or 0}"
        self.create(n)
        known = ws.put(classes.select("digest", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row")), "classes")
        index = self.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"))
        fresh = ws.put(known.hint("merge").join(index, "digest", "left_anti"), "fresh")
        stale = known.hint("merge").join(index, "digest").select("digest", "group_size", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"))
        known = ws.put(fresh.unionByName(stale), "decided")
        self.append(fresh, batch)
        out = join_hot(rows, known, "digest", n)
        return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, after ingesting them into a new index.

    Rows are matched by id and digest, so a large group's texts spread over all tasks.
    Rows equal in both are reduced to one, by a step that only runs if there are any. A null
    text equals the empty one and a null id is smaller than any other; other columns may
    have any name and hold anything; an empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "kept")
    index = DigestIndex(docs.sparkSession)
    decided = ws.put(index.ingest(docs, id_col, text_col), "decided")
    index.drop()
    repeated = not decided.where("NOT kept AND doc_id <=> keep_id").isEmpty()
    pair = lambda x: F.xxhash64(F.coalesce(F.col(x).cast("long"), F.lit(-1)), "digest").alias("pair")
    stay = decided.where("kept").select(F.unhex("text_sha256").alias("digest"), "doc_id").select(pair("doc_id"), "digest")
    # The user's columns travel as one, so no name of theirs meets one of ours.
    keyed = docs.select(text_digest(text_col).alias("digest"), F.col(id_col).alias("id"), whole_row(docs)).select(pair("id"), "digest", "row")
    out = keyed.join(stay, ["pair", "digest"], "left_semi")
    return (out.dropDuplicates(["pair", "digest"]) if repeated else out).select("row.*")
