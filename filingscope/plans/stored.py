"""Queries of what is landed, written and published: paged records, manifests and index generations."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from ..operators import index, operations
from ..operators.shared import new_folder, once
from ..sources import generations, manifests, paged
from ..streaming import scan
from .corpus import filings, table
from .queries import INDEX
from .registry import query

# Records of the landed pages, as SQL expressions of both engines.
RECORDS = ("doc_id AS filingId", "'FC' || CAST(1000 + doc_id % 97 AS STRING) || ' - ' || lang AS docketNumber", "source || CASE WHEN doc_id % 5 = 0 THEN '.doc' ELSE '.pdf' END AS attachment", "n_chars AS attachmentId", "coalesce(CAST(CAST(o_orderdate AS DATE) AS STRING), '1990-01-01') AS receivedDate", "doc_id % 7 = 0 AS isConfidential")
LANDED = f"landed AS (SELECT {', '.join(RECORDS)} FROM documents LEFT JOIN orders ON o_orderkey = doc_id), placed AS (SELECT *, row_number() OVER (ORDER BY receivedDate, filingId) - 1 AS position FROM landed)"


def _landed(spark: SparkSession, sf_dir: str, page_size: int = paged.PAGE_SIZE) -> str:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("doc_id"), "left")
    path = new_folder(spark, "pages")
    paged.land(docs.selectExpr(*RECORDS), path, page_size)
    return path


@query(f"WITH {LANDED} SELECT position, filingId AS filing_id, docketNumber AS docket, attachment, attachmentId AS attachment_id, receivedDate AS received_date, isConfidential AS confidential FROM placed WHERE receivedDate >= '1994-06-01'")
def paged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records from a date on, by page ranges; pages before the date are skipped."""
    path = _landed(spark, sf_dir)
    rows = spark.read.format("paged_records").load(path).where("receivedDate >= '1994-06-01'")
    return rows.select("position", F.col("filingId").alias("filing_id"), F.col("docketNumber").alias("docket"), "attachment", F.col("attachmentId").alias("attachment_id"), F.col("receivedDate").alias("received_date"), F.col("isConfidential").alias("confidential"))


@query(f"WITH {LANDED} SELECT filingId AS filing_id, receivedDate AS received_date, position FROM placed ORDER BY position DESC LIMIT 250 OFFSET 30")
def newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the newest records: only its pages are read."""
    rows = spark.read.format("paged_records").options(order="desc", skip=30, take=250).load(_landed(spark, sf_dir))
    return rows.select(F.col("filingId").alias("filing_id"), F.col("receivedDate").alias("received_date"), "position")


@query(f"WITH {LANDED} SELECT position, filingId AS filing_id, receivedDate AS received_date FROM placed")
def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records by a stream that is held by a page that can't be had, stops, and goes on from its offset once the page is there."""
    path, target, checkpoint = _landed(spark, sf_dir), new_folder(spark, "records"), new_folder(spark, "offsets")
    store = paged.Store(path)
    gap = paged.page_name(2)
    held = store.read(gap)
    if held:
        store.write(gap, b'{"status": 503}')
    for _ in range(2):
        rows = spark.readStream.format("paged_records").options(tries=2, pace=0).load(path)
        running = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).start(target)
        running.processAllAvailable()
        running.stop()
        if held:
            store.write(gap, held)
    return spark.read.schema(paged.SCHEMA).parquet(target).select("position", F.col("filingId").alias("filing_id"), F.col("receivedDate").alias("received_date"))


# What a request's tries wait, and the records of a shard: by the numbers of documents.
WAITS = ("doc_id", "doc_id % 8 AS attempt", "CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN lang END AS asked", "(n_chars % 100) / 100.0 AS jitter")


@query(f"SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 AND asked IS NOT NULL THEN least(60.0, CAST(asked AS DOUBLE)) ELSE least(30.0, pow(2.0, attempt)) + jitter END, 6) AS delay FROM (SELECT {', '.join(WAITS[:2])}, CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS STRING) END AS asked, {WAITS[3]} FROM documents)")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(*WAITS)
    return rows.select("doc_id", F.round(scoring.retry_wait(F.col("attempt"), F.col("asked"), F.col("jitter").cast("double")), 6).alias("delay"))


@query("SELECT lang, source, total, least(w * k, total) AS first_record, CASE WHEN k = n - 1 THEN total ELSE least(w * (k + 1), total) END AS end_record FROM (SELECT lang, source, CAST(floor(1000 / count(*) OVER l) AS BIGINT) AS w, row_number() OVER (PARTITION BY lang ORDER BY source NULLS LAST) - 1 AS k, count(*) OVER l AS n, CAST(sum(c) OVER l AS BIGINT) AS total FROM (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL) WINDOW l AS (PARTITION BY lang))")
def shard_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ranges of each language's shards, one a source; a language is a set of 1,000 records at first."""
    own = Window.partitionBy("lang")
    rows = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("c"))
    rows = rows.select("lang", "source", F.sum("c").over(own).alias("total"), F.count("*").over(own).alias("n"), (F.row_number().over(own.orderBy(F.col("source").asc_nulls_last())) - 1).alias("k"))
    first, end = scoring.shard_range(F.col("total"), F.col("k"), F.col("n"), 1000)
    return rows.select("lang", "source", "total", first.alias("first_record"), end.alias("end_record"))


@query("""WITH p AS (SELECT ['index', 'router', 'term-index'][1 + event_id % 3] AS part, strftime(max(ts) FILTER (event_id % 3 <> 1 OR event_type = 'click'), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events WHERE ts < '2024-01-25' OR event_id % 3 = 0 GROUP BY 1),
i AS (SELECT part || '-stale' AS issue FROM p WHERE epoch('2024-02-01'::TIMESTAMP) - epoch(updated_at::TIMESTAMP) > CASE part WHEN 'term-index' THEN 240 ELSE 36 END * 3600)
SELECT CASE WHEN count(*) > 0 THEN 'degraded' ELSE 'ok' END AS status, coalesce(string_agg(issue, ', ' ORDER BY issue), '') AS issues FROM i""")
def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of three parts that were last updated by three kinds of events."""
    kind = F.col("event_id") % 3
    events = table(spark, sf_dir, "events").where("ts < '2024-01-25' OR event_id % 3 = 0").withColumn("part", F.when(kind == 0, "index").when(kind == 1, "router").otherwise("term-index"))
    parts = events.groupBy("part").agg(F.date_format(F.max(F.when((kind != 1) | (F.col("event_type") == "click"), F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    return operations.health(parts, "2024-02-01 00:00:00")


# Manifests: a third of the filings are one case's, which gets several parts.
CASES = ("doc_id AS filing_id", "CASE WHEN doc_id % 3 = 0 THEN 'FC100' ELSE 'FC' || CAST(101 + doc_id % 40 AS STRING) END AS case_number", "source AS title", "'k' || CAST(doc_id AS STRING) AS r2_key", "doc_id % 5 = 0 AS metadata_only")


@query(f"SELECT {', '.join(CASES)} FROM documents")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of manifests that tasks wrote, as they are read again; a file in another case's folder doesn't count."""
    path, rows = new_folder(spark, "manifests"), table(spark, sf_dir, "documents").selectExpr(*CASES)
    manifests.write_manifests(rows.where("filing_id % 2 = 0"), path, 1 << 20)
    manifests.write_manifests(rows, path, 16 << 10)  # the cases again, in more parts
    store = paged.Store(path)
    for name in store.names("FC100")[:1]:
        store.write("FC999/part-0-of-1.json.gz", store.read(f"FC100/{name}"))
    return manifests.read_manifests(spark, path).select("filing_id", "case_number", "title", "r2_key", "metadata_only")


@query(f"WITH {INDEX} SELECT stem, case_number, df, weight FROM postings")
def generation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings as a reader finds them that held a generation while two more were published."""
    postings, path = once(index.postings(filings(spark, sf_dir)), "postings"), new_folder(spark, "index")
    generations.publish_index(postings, path, buckets=4)
    with generations.held_generation(spark, path) as meta:
        generations.publish_index(postings, path, buckets=8)
        generations.publish_index(postings, path, buckets=8)
        return once(generations.read_postings(spark, path, generation=meta).where("case_number IS NOT NULL").select("stem", "case_number", "df", "weight"), "read")


@query("""SELECT 0 AS pos, 'read' AS stage, count(*) AS rows FROM documents UNION ALL SELECT 1, 'public', count(*) FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 2, 'by-source', count(*) FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 7 <> 0)""")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a job's stages as its log has them."""
    log = operations.StageLog(spark)
    read = log.stage(table(spark, sf_dir, "documents").select("doc_id", "source"), "read", table="documents")
    public = log.stage(read.where("doc_id % 7 <> 0"), "public")
    log.stage(public.groupBy("source").count(), "by-source")
    return log.table().where("error IS NULL AND seconds >= 0").select("pos", "stage", "rows")


@query("""WITH l AS (SELECT ts, event_type <> 'error' AS fine, CAST(event_id AS VARCHAR) || ':' || value AS payload FROM events WHERE ts <= '2024-01-15'), g AS (SELECT max(ts) AS ts, arg_max(payload, ts) AS payload FROM l WHERE fine)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, payload FROM g WHERE epoch('2024-01-15'::TIMESTAMP) - epoch(ts) <= 30 * 60""")
def cached_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news that are still served on a day, if the last good fetch before it was within half an hour."""
    log = table(spark, sf_dir, "events").where("ts <= '2024-01-15'").select("ts", F.when(F.col("event_type") != "error", "ok").otherwise("failed").alias("status"), F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("value").cast("string")).alias("payload"))
    return operations.cached_news(log, "2024-01-15 00:00:00").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "payload")


PUBLIC = "public AS (SELECT * FROM placed WHERE NOT isConfidential AND coalesce(attachmentId, 0) <> 0 AND attachment LIKE '%.pdf')"


def _scanned(spark: SparkSession, sf_dir: str) -> scan.MetadataScan:
    """A scan that stops by its budget, is held by a page, and is taken up twice by new objects."""
    path, target = _landed(spark, sf_dir), new_folder(spark, "scan")
    n = table(spark, sf_dir, "documents").count()
    new = lambda: scan.MetadataScan(spark, path, target, shards=3, records=max(100, n // 5), now="2026-01-01T00:00:00Z", tries="1", pace="0")
    new().run(most_seconds=0)
    store, gap = paged.Store(path), paged.page_name(max(0, n // 100 - 2))
    held = store.read(gap)
    store.write(gap, b'{"status": 503}')
    with contextlib.suppress(paged.PageUnavailable):
        new().run()
    store.write(gap, held)
    last = new()
    last.run()
    last.recent("1997-01-01")  # takes what it knows again
    return last


@query(f"WITH {LANDED}, {PUBLIC} SELECT filingId AS filing_id, 'FC' || CAST(1000 + filingId % 97 AS VARCHAR) AS case_number, docketNumber AS docket_number, attachment AS title, receivedDate AS received_date FROM public")
def scanned_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests after a whole scan and a recent one: each public record once, in its case."""
    done = _scanned(spark, sf_dir)
    return manifests.read_manifests(spark, done.manifests).where("metadata_only").select("filing_id", "case_number", "docket_number", "title", "received_date")


@query(f"WITH {LANDED}, {PUBLIC} SELECT (SELECT count(*) FROM placed) AS official_records, (SELECT count(*) FROM placed) AS scanned, (SELECT count(*) FROM public) AS public_pdfs, true AS complete, '2026-01-01T00:00:00Z' AS updated_at")
def metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.metadata_coverage(_scanned(spark, sf_dir).states())
