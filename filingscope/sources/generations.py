"""Published index generations, and the pointer that readers find them by.

A generation is a folder that nothing changes once it is written. Pointers are numbered files,
each put in place by one rename after its generation is whole; the newest is
the one that counts. So a reader finds an index at every moment, and a publisher that
dies leaves the previous pointer, which the next one's shrink guard is held against. The
two newest generations and those that a reader holds stay; older ones are taken away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import term_shard
from ..operators.ingest import shrink_guard

POINTERS, HOLDS = "pointers", "holds"
#: Newest generations that stay.
KEPT = 2


class Folder:
    """A folder of small files, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._fs = path, spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
        self.fs = self._fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())  # noqa: SLF001

    def at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a whole file in one step; False if the name is taken."""
        staged = self.at(f"_staged/{uuid.uuid4().hex}")
        stream = self.fs.create(staged)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        if self.fs.exists(self.at(name)) or not self.fs.rename(staged, self.at(name)):
            self.fs.delete(staged, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _pointers(folder: Folder) -> list[str]:
    """Names of whole pointers, oldest first."""
    return [n for n in folder.names(POINTERS) if n.endswith(".json")]


def current_generation(spark: SparkSession, path: str) -> dict | None:
    """The published generation's record; None before the first one."""
    folder = Folder(spark, path)
    names = _pointers(folder)
    return json.loads(folder.read(f"{POINTERS}/{names[-1]}")) if names else None


def publish_index(postings: DataFrame, path: str, buckets: int = 64, allow_shrink: bool = False) -> dict:
    """Write a generation of postings, partitioned by bucket, and then the pointer to it; its record.

    Raises ValueError, and leaves what is published as it is, if the index shrinks to under half of its cases.
    """
    spark = postings.sparkSession
    folder, previous = Folder(spark, path), current_generation(spark, path)
    generation = uuid.uuid4().hex
    out = f"{path}/generations/{generation}"
    rows = postings.withColumn("shard", term_shard(F.col("stem"))).withColumn("bucket", F.col("shard") % buckets)
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(out)
    totals = spark.read.parquet(out).agg(F.count_distinct("case_number"), F.count_distinct("stem"), F.count("case_number")).first()
    try:
        shrink_guard(totals[0], previous and previous["cases"], allow_shrink)
    except ValueError:
        folder.delete(f"generations/{generation}")
        raise
    while True:
        number = previous["number"] + 1 if previous else 1
        meta = {"number": number, "generation": generation, "slot": "ab"[1 - number % 2], "path": out, "buckets": buckets, "cases": totals[0], "terms": totals[1], "postings": totals[2]}
        if folder.create(f"{POINTERS}/{number:012d}.json", json.dumps(meta)):
            break
        previous = current_generation(spark, path)  # another publisher was faster
        shrink_guard(totals[0], previous and previous["cases"], allow_shrink)
    retire(spark, path)
    return meta


def retire(spark: SparkSession, path: str, kept: int = KEPT) -> list[str]:
    """Delete pointers but the newest ``kept``, and their generations unless a reader holds them; the generations that went.

    Folders without a pointer are left alone: a publisher may be writing them.
    """
    folder, gone = Folder(spark, path), []
    for name in _pointers(folder)[:-kept]:
        generation = json.loads(folder.read(f"{POINTERS}/{name}"))["generation"]
        if not folder.names(f"{HOLDS}/{generation}"):
            folder.delete(f"generations/{generation}")
            folder.delete(f"{HOLDS}/{generation}")
            folder.delete(f"{POINTERS}/{name}")  # last, so a deletion that is cut short is taken up again
            gone.append(generation)
    return gone


@contextmanager
def held_generation(spark: SparkSession, path: str) -> Iterator[dict]:
    """The current generation's record, whose files stay while the block runs."""
    folder, reader = Folder(spark, path), uuid.uuid4().hex
    while True:
        meta = current_generation(spark, path)
        if meta is None:
            raise FileNotFoundError(f"no index is published at {path}")
        hold = f"{HOLDS}/{meta['generation']}/{reader}"
        folder.create(hold, "")
        newest = [json.loads(folder.read(f"{POINTERS}/{n}"))["generation"] for n in _pointers(folder)[-KEPT:]]
        if meta["generation"] in newest:
            break
        folder.delete(hold)  # it may have gone before the hold was there
    try:
        yield meta
    finally:
        folder.delete(hold)


def read_postings(spark: SparkSession, path: str, stems: list[str] | None = None, generation: dict | None = None) -> DataFrame:
    """Postings of the current generation, or of one that is held; with ``stems``, only their buckets are read."""
    meta = generation or current_generation(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no index is published at {path}")
    rows = spark.read.parquet(meta["path"])
    if stems is None:
        return rows
    shards = spark.createDataFrame([(s,) for s in stems], "stem string").select((term_shard(F.col("stem")) % meta["buckets"]).alias("b")).distinct()
    return rows.where(F.col("bucket").isin([r[0] for r in shards.collect()]) & F.col("stem").isin(stems))
