"""Paged records as a Spark data source, in batches and as a stream.

A page has up to ``page_size`` records in ascending order of receipt, and the number of all
records. Pages come from a service (``http…``) or from a folder of landed pages; either way
a page is one request with its own retries. A batch read asks for the total once, cuts
the pages that can matter into ranges, and reads each range in a task. Records before a
cutoff date are on leading pages, found by binary search. A stream's offset is the number
of records taken: a page that can't be had holds it in place, whatever lies behind it, and
a last page that isn't full is taken as far as it goes.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.scoring import retry_delay
from ..operators.shared import once
from .store import Store

# Records of a page, tries of a request, statuses that are worth another try.
PAGE_SIZE, TRIES = 100, 6
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)
#: Pages that a task reads.
PAGES_A_TASK = 32
FIELDS = pa.schema([("filingId", pa.int64()), ("docketNumber", pa.string()), ("attachment", pa.string()), ("attachmentFileName", pa.string()), ("attachmentId", pa.int64()), ("description", pa.string()), ("receivedDate", pa.string()), ("isConfidential", pa.bool_()), ("isArchived", pa.bool_())])
SCHEMA = "filingId bigint, docketNumber string, attachment string, attachmentFileName string, attachmentId bigint, description string, receivedDate string, isConfidential boolean, isArchived boolean, position bigint"


class PageUnavailable(Exception):
    """A page that all tries failed to get. ``permanent``: another try can't help."""

    def __init__(self, page: int, status: int, permanent: bool = False):
        super().__init__(f"page {page}: status {status}")
        self.permanent = permanent


class Pages:
    """Pages by number, each with its tries."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.size = options["path"], int(options.get("pagesize", PAGE_SIZE))
        self.tries, self.pace = int(options.get("tries", TRIES)), float(options.get("pace", 1.0))
        self.partial = options.get("partial", "false") == "true"
        self.store = None if self.uri.startswith("http") else Store(self.uri)

    def request(self, page: int) -> tuple[int, dict, str | None]:
        """Status, body, and the wait that is asked for."""
        if self.store:
            raw = self.store.read(page_name(page))
            body = json.loads(raw) if raw is not None else {"status": 404}
            return int(body.get("status", 200)), body, body.get("retryAfter")
        try:
            with urllib.request.urlopen(f"{self.uri}?sort=receivedDate&skip={page * self.size}&take={self.size}", timeout=60) as answer:
                return answer.status, json.load(answer), None
        except urllib.error.HTTPError as e:
            return e.code, {}, e.headers.get("Retry-After")
        except (OSError, ValueError):
            return 503, {}, None

    def get(self, page: int) -> dict:
        """The page's body, or PageUnavailable after the last try. A page that has not landed is worth no other try."""
        for attempt in range(self.tries):
            status, body, asked = self.request(page)
            if status == 200 and isinstance(body.get("resultsSet"), list):
                return body
            if status not in (*TRANSIENT, 200):
                raise PageUnavailable(page, status, permanent=True)
            if attempt + 1 < self.tries:
                time.sleep(self.pace * retry_delay(attempt, asked, random.random()))
        raise PageUnavailable(page, status)

    def total(self) -> int:
        return int(self.get(0)["total"])

    def first_since(self, date: str, pages: int) -> int:
        """The first page whose last record is not before the date."""
        low, high = 0, pages
        while low < high:
            mid = (low + high) // 2
            rows = self.get(mid)["resultsSet"]
            if rows and (rows[-1].get("receivedDate") or "") < date:
                low = mid + 1
            else:
                high = mid
        return low


def page_name(page: int) -> str:
    return f"page-{page:09d}.json"


class Range(InputPartition):
    """Records from ``start`` to before ``end``, by position."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def ranges(start: int, end: int, size: int) -> list[Range]:
    """Cuts of [start, end) at borders of pages."""
    step = PAGES_A_TASK * size
    cuts = [start, *range((start // step + 1) * step, end, step), end]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _records(pages: Pages, part: Range | None) -> Iterator[pa.RecordBatch]:
    """The records of a range; Spark asks for None where there is no range."""
    for page in range(part.start // pages.size, (part.end - 1) // pages.size + 1) if part else ():
        try:
            rows = pages.get(page)["resultsSet"]
        except PageUnavailable:
            if not pages.partial:
                raise
            return
        first = page * pages.size
        low, high = max(0, part.start - first), min(len(rows), part.end - first)
        if high < min(pages.size, part.end - first):
            if pages.partial:
                return
            raise PageUnavailable(page, 206)  # shorter than the total promised
        named = [{k: r.get(k) for k in FIELDS.names} for r in rows[low:high]]
        yield pa.RecordBatch.from_pylist(named, schema=FIELDS).append_column("position", pa.array(range(first + low, first + high), pa.int64()))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.since = options, options.get("since", "")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A lower bound of receivedDate skips pages; Spark still compares each record."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("receivedDate",):
                self.since = max(self.since, f.value)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        pages = Pages(self.options)
        total = pages.total()
        skip, take = int(self.options.get("skip", 0)), int(self.options.get("take", total))
        low, high = min(total, skip), min(total, skip + take)
        if self.options.get("order", "asc") == "desc":  # positions stay those of the ascending order
            low, high = total - high, total - low
        if self.since:
            low = max(low, pages.size * pages.first_since(self.since, -(-total // pages.size)))
        return ranges(low, high, pages.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _records(Pages(self.options), partition)


class PagedStream(DataSourceStreamReader):
    """Offsets are {"records": n}. What a batch takes is fixed by its offsets, so a batch that runs again gives the same records."""

    def __init__(self, options: dict[str, str]):
        self.options, self.reached = options, 0

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        """As far as pages follow each other without a gap, looking from where this reader came to."""
        pages = Pages(self.options)
        try:
            while True:
                rows = pages.get(self.reached // pages.size)["resultsSet"]
                end = self.reached // pages.size * pages.size + len(rows)
                done = end <= self.reached or len(rows) < pages.size
                self.reached = max(self.reached, end)
                if done:
                    break
        except PageUnavailable:
            pass  # the page holds the cursor
        return {"records": self.reached}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.reached = max(self.reached, end["records"])
        return ranges(start["records"], end["records"], Pages(self.options).size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _records(Pages(self.options), partition)


class Landed(WriterCommitMessage):
    def __init__(self, staged: list[tuple[str, str]]):
        self.staged = staged


class PageWriter(DataSourceWriter):
    """Rows (page, payload) to a file each; they get their names when all tasks are done."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]

    def write(self, iterator: Iterator) -> Landed:
        store = Store(self.uri)
        return Landed([(store.stage(row.payload.encode()), page_name(row.page)) for row in iterator])

    def commit(self, messages: list[Landed | None]) -> None:
        store = Store(self.uri)
        for m in messages:
            for staged, name in m.staged if m else ():
                store.publish(staged, name)

    def abort(self, messages: list[Landed | None]) -> None:
        store = Store(self.uri)
        for m in messages:
            for staged, _ in m.staged if m else ():
                store.delete(staged)


class PagedRecords(DataSource):
    """``spark.read.format("paged_records").load(path)``, and ``readStream`` alike.

    ``register`` makes it known. Options: pageSize; order (asc or desc), skip and take, which count records from that
    end; since, a cutoff date; tries, and pace, which scales the waits between them; partial (true) ends a
    task's range at a page that can't be had, where a batch read fails otherwise.
    Column ``position`` is a record's number in ascending order. ``write`` takes rows
    (page, payload).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.dataSource.register(PagedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def numbered(rows: DataFrame, *order: str, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``position`` from 0 in a total order: ranges are numbered by themselves, each from its first number."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = once(rows.repartitionByRange(tasks, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("range").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row a range
    within = Window.partitionBy("range").orderBy(*order)
    return cut.join(F.broadcast(base), "range").withColumn("position", F.col("base") + F.row_number().over(within) - 1).drop("range", "base")


def land(records: DataFrame, path: str, page_size: int = PAGE_SIZE) -> None:
    """Write ``records`` (the source's columns but position) as landed pages, by receivedDate and filingId."""
    register(records.sparkSession)
    fields = [c for c in FIELDS.names if c in records.columns]
    rows = numbered(records.select(*fields), "receivedDate", "filingId").withColumn("page", F.floor(F.col("position") / page_size).cast("int"))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    whole = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("position", *fields))).alias("resultsSet")).crossJoin(total)  # page_size rows
    out = whole.select("page", F.to_json(F.struct("resultsSet", "total")).alias("payload"))
    out.write.format("paged_records").option("path", path).mode("append").save()
