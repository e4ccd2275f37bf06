"""Scan of all records into manifests, by shards that each go on from their cursor.

A step reads the next records of every shard in one job, merges them into the manifests of
the cases that they name, and only then moves the cursors. So a scan that stops
anywhere, by its time budget, by a page that can't be had or by dying, repeats at most the
step that it was in, and repeating one changes nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import lenient_number, shard_bounds
from ..operators.ingest import is_public_pdf, merge_manifests, metadata_rows
from ..operators.shared import once
from ..sources import manifests, paged
from ..sources.store import Store

# The version of a shard's state, shards, and records of a step.
VERSION, SHARDS, STEP_RECORDS = 3, 4, 5000
STATE = "version int, shardIndex int, shardCount int, officialRecords string, officialRecordsScanned string, publicPdfRecords string, nextOffset long, fullScanComplete boolean, updatedAt string"


class MetadataScan:
    """Records of ``pages`` into manifests and states below ``target``.

    ``options`` are the page source's. ``now`` is the time that is noted in the states.
    """

    def __init__(self, spark: SparkSession, pages: str, target: str, shards: int = SHARDS, records: int = STEP_RECORDS, now: str = "1970-01-01T00:00:00Z", **options: str):
        self.spark, self.pages, self.target, self.shards, self.records, self.now, self.options = spark, pages, target, shards, records, now, options
        self.store, self.manifests = Store(target), f"{target}/manifests"
        paged.register(spark)

    def _name(self, shard: int) -> str:
        return f"state-v{VERSION}-{shard}-of-{self.shards}.json"

    def state(self, shard: int) -> dict:
        name = self._name(shard)
        state = self.store.read_json(name) if self.store.exists(name) else {}
        if state is None:
            raise OSError(f"the state {name} can't be read")  # to begin again would be worse
        return state

    def _read(self, **window: str) -> DataFrame:
        return self.spark.read.format("paged_records").options(**self.options, partial="true", **window).load(self.pages)

    def _merge(self, records: DataFrame) -> None:
        """The public records among ``records`` into the manifests of their cases; others aren't touched."""
        public = is_public_pdf(F.col("isConfidential"), F.col("isArchived"), F.col("attachmentId"), F.col("attachment"))
        fresh = once(metadata_rows(records.where(public)), "fresh")
        dirty = {r[0] for r in fresh.select("case_number").distinct().collect()}  # no more than a step's records name
        there = [f"{self.manifests}/{c}" for c in Store(self.manifests).folders() if c in dirty]
        rows = fresh.withColumn("part", F.lit("0"))
        if there:
            stored = manifests.read_manifests(self.spark, there).withColumn("part", F.concat(F.lit("1"), F.col("part")))
            rows = rows.unionByName(stored, allowMissingColumns=True)  # what is new comes first, but for a stored row with content
        else:
            rows = rows.withColumn("r2_key", F.lit(None).cast("string"))
        manifests.write_manifests(once(merge_manifests(rows), "merged").drop("part"), self.manifests)

    def step(self) -> bool:
        """The next records of each shard; whether any shard has more. Raises PageUnavailable, after saving what it has, if a page holds a shard."""
        total = paged.Pages({"path": self.pages, **{k.lower(): v for k, v in self.options.items()}}).total()
        states = [self.state(i) for i in range(self.shards)]
        windows = []
        for i, state in enumerate(states):
            first, end = shard_bounds(total, i, self.shards, max(250_000, total))
            at = min(max(state.get("nextOffset") or first, first), end)
            windows.append((i, first, at, min(end, at + self.records), end))
        open_ = [w for w in windows if w[2] < w[3]]
        reads = [self._read(skip=str(at), take=str(to - at)).withColumn("shard", F.lit(i)).withColumn("first", F.lit(at)) for i, _, at, to, _ in open_]
        got: dict[int, tuple[int, int]] = {}
        if reads:
            both = reads[0]
            for more in reads[1:]:
                both = both.unionByName(more)
            rows = once(both, "records")
            order = Window.partitionBy("shard").orderBy("position")  # a step's records of a shard
            whole = rows.withColumn("n", F.row_number().over(order)).where("position - first = n - 1")
            self._merge(rows)
            public = is_public_pdf(F.col("isConfidential"), F.col("isArchived"), F.col("attachmentId"), F.col("attachment"))
            got = {r["shard"]: (r["n"], r["public"]) for r in whole.groupBy("shard").agg(F.max("n").alias("n"), F.count_if(public).alias("public")).collect()}
        for i, first, at, _, end in windows:
            n, public = got.get(i, (0, 0))
            known = states[i].get("publicPdfRecords") or 0
            self.store.write(self._name(i), json.dumps({"version": VERSION, "shardIndex": i, "shardCount": self.shards, "officialRecords": total, "officialRecordsScanned": at + n - first, "publicPdfRecords": known + public, "nextOffset": at + n, "fullScanComplete": at + n >= end, "updatedAt": self.now}).encode())
        for i, _, at, to, _ in open_:
            if got.get(i, (0, 0))[0] < to - at:
                raise paged.PageUnavailable((at + got.get(i, (0, 0))[0]) // paged.PAGE_SIZE, 503)
        return any(at + got.get(i, (0, 0))[0] < end for i, _, at, _, end in windows)

    def run(self, most_seconds: float = float("inf"), clock: Callable[[], float] = time.monotonic) -> bool:
        """Steps until all shards are done (True) or the time is used up (False)."""
        began = clock()
        while self.step():
            if clock() - began >= most_seconds:
                return False
        return True

    def recent(self, since: str) -> None:
        """Take records from a date on again, whatever the cursors are."""
        self._merge(once(self._read(since=since).where(F.col("receivedDate") >= since), "recent"))

    def states(self) -> DataFrame:
        """One row a shard: (shard, state); state null where there is none."""
        rows = [(i, (self.store.read(self._name(i)) or b"").decode() or None) for i in range(self.shards)]
        return self.spark.createDataFrame(rows, "shard int, payload string").select("shard", F.from_json("payload", STATE).alias("state"))


def metadata_coverage(states: DataFrame) -> DataFrame:
    """One row from the shards' states (shard, state): the most official records that any knows, sums of what was scanned and found, whether all are done, the latest update; no row without any state."""
    n = lambda c: lenient_number(F.col(f"state.{c}"))
    out = states.agg(F.count("state").alias("known"), F.greatest(F.lit(0), F.max(n("officialRecords"))).cast("long").alias("official_records"), F.sum(n("officialRecordsScanned")).cast("long").alias("scanned"), F.sum(n("publicPdfRecords")).cast("long").alias("public_pdfs"), F.every(F.coalesce("state.fullScanComplete", F.lit(False))).alias("complete"), F.max(F.nullif("state.updatedAt", F.lit(""))).alias("updated_at"))
    return out.where("known > 0").drop("known")


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) of what lies below a path, and its sum as the row of a null folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.element_at(F.split("path", "/"), -2)
    return files.rollup(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
