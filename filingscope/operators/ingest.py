"""Ingest algebra: predicates, manifests, upserts and failure state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

MOST_ATTEMPTS, MOST_STATE = 3, 5000


def is_public_pdf(confidential: Column, archived: Column, attachment_id: Column, attachment: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return no(confidential) & no(archived) & F.coalesce(attachment_id.cast("string") != "0", F.lit(False)) & F.coalesce(F.lower(attachment).endswith(".pdf"), F.lit(False))


def metadata_rows(raw: DataFrame) -> DataFrame:
    """Filing records as the API gives them to metadata rows; the title falls back on file names."""
    first = lambda *c: F.coalesce(*(F.nullif(text.strip_html(F.col(x)) if x == "description" else F.col(x), F.lit("")) for x in c))
    title = F.coalesce(first("description", "attachmentFileName", "attachment"), F.lit("Filing"))
    return raw.select(F.col("filingId").cast("long").alias("filing_id"), F.explode(text.docket_cases(F.col("docketNumber"))).alias("case_number"), F.col("docketNumber").alias("docket_number"), title.alias("title"), F.col("receivedDate").alias("received_date"), F.lit(True).alias("metadata_only"))


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_manifests(parts: DataFrame) -> DataFrame:
    """One row a (case, filing) of all manifest parts: a row with content wins, then the earlier part."""
    return newest(parts, ["case_number", "filing_id"], F.desc(F.col("r2_key").isNotNull()), F.col("part"))


def merge_metadata(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Key-wise merge: the existing row's columns win, null or not; new rows are added."""
    fields = [c for c in new.columns if c not in keys]
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.alias("b")
    joined = a.join(b, keys, "full")
    return joined.select(*keys, *(F.when(F.col("a._old").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in fields))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; a tie goes to the new table."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return newest(both, keys, F.desc(version), F.desc("_side")).drop("_side")


def stale_keys(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return previous.select(key).distinct().join(current.select(key), key, "left_anti")


def document_status(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """'missing', 'legacy' or 'compact' for each wanted filing."""
    known = stored.groupBy("filing_id").agg(F.max(F.col("content_format") == "compact").alias("compact"))
    return wanted.join(known, "filing_id", "left").select("filing_id", F.when(F.col("compact").isNull(), "missing").when(F.col("compact"), "compact").otherwise("legacy").alias("status"))


def failure_state(pending: DataFrame, unavailable: DataFrame, failures: DataFrame, resolved: DataFrame, permanent: DataFrame) -> DataFrame:
    """(filing_id, state, attempts) after a batch: pending ids with attempts, resolved and permanent ones taken out, three failures make an id unavailable."""
    gone = resolved.select("filing_id").unionByName(permanent.select("filing_id")).distinct()
    left = pending.join(gone, "filing_id", "left_anti")
    counted = left.select("filing_id", F.greatest(F.lit(1), F.coalesce("attempts", F.lit(1))).cast("long").alias("attempts")).unionByName(failures.groupBy("filing_id").agg(F.count("*").alias("attempts"))).groupBy("filing_id").agg(F.sum("attempts").alias("attempts"))
    failed = counted.select("filing_id", F.when(F.col("attempts") >= MOST_ATTEMPTS, "unavailable").otherwise("pending").alias("state"), F.when(F.col("attempts") < MOST_ATTEMPTS, F.col("attempts")).alias("attempts"))
    fixed = unavailable.select("filing_id").unionByName(permanent.select("filing_id")).distinct().select("filing_id", F.lit("unavailable").alias("state"), F.lit(None).cast("long").alias("attempts"))
    every = newest(failed.unionByName(fixed), ["filing_id", "state"], F.col("filing_id"))
    # The largest ids of each state: tasks keep no more than that many.
    best = lambda s: every.where(F.col("state") == s).orderBy(F.desc("filing_id")).limit(MOST_STATE)
    return best("pending").unionByName(best("unavailable"))


def shrink_guard(new_cases: int, previous_cases: int | None, allow: bool = False) -> None:
    """Refuse to publish an index with under half of the previous one's cases."""
    if previous_cases and not allow and new_cases * 2 < previous_cases:
        raise ValueError(f"the new index has {new_cases} cases, the previous one {previous_cases}")


def related_rows(filings: DataFrame, most: int | None = 12) -> DataFrame:
    """(filing_id, pos, case_number): a filing's case and those of its docket list."""
    return filings.select("filing_id", F.posexplode(text.related_cases(F.col("case_number"), F.col("docket_number"), most)).alias("pos", "case_number"))


def migrated_state(state: DataFrame, shard: int, shards: int, capacity: int = 250_000, from_version: int = 2, version: int = 3) -> DataFrame:
    """Ingest states of the version before (…, documentsIndexed, failedFilingIds, failureAttempts as a map) in the current form.

    They begin again at their shard's first record; a failed filing counts one attempt
    unless its attempts are known.
    """
    failed = F.coalesce("failedFilingIds", F.array().cast("array<bigint>"))
    once_each = F.map_from_entries(F.transform(F.array_distinct(failed), lambda i: F.struct(i.cast("string"), F.lit(1))))
    attempts = F.when(F.coalesce(F.cardinality("failureAttempts"), F.lit(0)) > 0, F.col("failureAttempts")).otherwise(once_each)
    fixed = {"version": version, "shardIndex": shard, "shardCount": shards, "nextOffset": capacity // shards * shard, "documentsCompacted": 0, "migrationFromStateVersion": from_version}
    return state.withColumns({"failureAttempts": attempts, "failedFilingIds": failed, "documentsIndexed": F.coalesce("documentsIndexed", F.lit(0))}).withColumns({k: F.lit(v) for k, v in fixed.items()})


def saved_state(state: DataFrame, at: str, writes: int, next_offset: int | None = None, version: int = 3) -> DataFrame:
    """States as they are saved at a time: writes of the month go on, or begin again in a new month, and the save is one."""
    month = F.date_format(F.to_timestamp(F.lit(at)), "yyyy-MM")
    before = F.when(F.col("writeMonth") == month, F.coalesce("writesThisMonth", F.lit(0))).otherwise(F.lit(0))
    out = state.withColumn("writesThisMonth", (before + writes + 1).cast("long")).withColumns({"writeMonth": month, "updatedAt": F.lit(at), "version": F.lit(version)})
    return out.withColumn("nextOffset", F.lit(next_offset)) if next_offset is not None else out


def indexed_documents(pages: DataFrame, filings: DataFrame, done: DataFrame) -> DataFrame:
    """(filing_id, case_number, key, html, sha256, pages, empty) of filings that aren't indexed yet, from their pages' text.

    ``pages``: filing_id, page_number, page. The key names the year of receipt.
    """
    from .records import document_html, ocr_candidates, unpublished

    fresh = unpublished(filings, done, "filing_id")
    html = document_html(pages).join(ocr_candidates(pages), "filing_id")
    year = F.coalesce(F.nullif(F.substring("received_date", 1, 4), F.lit("")), F.lit("unknown"))
    rows = fresh.join(html, "filing_id")
    return rows.select("filing_id", "case_number", F.concat(F.lit("filings/"), year, F.lit("/"), F.col("filing_id").cast("string"), F.lit(".html.gz")).alias("key"), "html", F.sha2("html", 256).alias("sha256"), "pages", "empty")


def net_growth(new_size: Column, old_size: Column) -> Column:
    """Bytes that an overwrite adds to the store."""
    return new_size - F.coalesce(old_size, F.lit(0))


def running_budget(writes: DataFrame, limit: float) -> DataFrame:
    """Writes by day in order with the running sum of bytes, and whether the day's limit still holds.

    A task sums the writes of a minute; what earlier minutes of the day used is added.
    """
    marked = writes.withColumn("_minute", F.date_trunc("minute", "ts"))
    before = Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("day", "_minute").agg(F.sum("bytes").alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    order = Window.partitionBy("day", "_minute").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumn("_own", F.sum("bytes").over(order)).join(base.drop("_all"), ["day", "_minute"])
    return out.withColumn("used", F.round(F.col("_base") + F.col("_own"), 2)).withColumn("allowed", F.col("used") <= limit).drop("_minute", "_base", "_own")
