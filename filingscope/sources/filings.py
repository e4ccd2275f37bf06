"""Landed filing records, page files, PDFs and news markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators.ingest import is_public_pdf

RECORD = "filingId long, docketNumber string, attachment string, attachmentFileName string, attachmentId long, description string, receivedDate string, isConfidential boolean, isArchived boolean"


def read_records(spark: SparkSession, path: str, newest_first: bool = False, skip: int = 0, take: int | None = None, since: str | None = None) -> DataFrame:
    """Public PDF records of landed API pages (JSON, gzip too), in receipt order with a window of rows."""
    rows = spark.read.schema(RECORD).json(path, recursiveFileLookup=True)
    rows = rows.where(is_public_pdf(F.col("isConfidential"), F.col("isArchived"), F.col("attachmentId"), F.col("attachment")))
    rows = rows.where(F.col("receivedDate") >= since) if since else rows
    if not skip and take is None:
        return rows
    order = F.desc("receivedDate") if newest_first else F.asc("receivedDate")
    rows = rows.orderBy(order, "filingId").offset(skip)
    return rows if take is None else rows.limit(take)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(filing_id, page_number, page) of stored page markup, a file for each filing named by its id."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("filing_id", F.regexp_extract(F.input_file_name(), r"(\d+)\.html(?:\.gz)?$", 1).cast("long"))
    numbers = text.matches(F.col("value"), r"(?is)<section\s+data-page=[\"'](\d+)[\"'][^>]*>(.*?)</section>", 1)
    bodies = text.matches(F.col("value"), r"(?is)<section\s+data-page=[\"'](\d+)[\"'][^>]*>(.*?)</section>", 2)
    return rows.select("filing_id", F.inline(F.arrays_zip(numbers.alias("n"), bodies.alias("body")))).select("filing_id", F.col("n").cast("int").alias("page_number"), text.strip_html(F.col("body")).alias("page"))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, is_pdf): downloaded files and whether they open with the PDF mark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def parse_news(pages: DataFrame, html_col: str, domain: str, marker: str, most: int | None = 5) -> DataFrame:
    """(keys, position, title, date, summary, url) of news blocks in page markup; only links to the official domain count."""
    blocks = F.slice(F.split(F.col(html_col), F.lit("\\Q" + marker + "\\E")), F.lit(2), F.lit(2**30))
    each = pages.select("*", F.posexplode(blocks).alias("at", "block"))
    anchor = r"(?is)<h2>\s*<a[^>]*href=\"([^\"]+)\"[^>]*>(.*?)</a>\s*</h2>"
    href = text.decode_entities(F.regexp_extract("block", anchor, 1))
    url = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("/"), F.concat(F.lit(f"https://{domain}"), href)).otherwise(F.concat(F.lit(f"https://{domain}/"), href))
    title = text.strip_html(F.regexp_extract("block", anchor, 2))
    date = F.coalesce(F.nullif(text.decode_entities(F.regexp_extract("block", r"(?is)fa-calendar-o.*?</i>\s*([^<\n]+)", 1)), F.lit("")), F.lit("Latest update"))
    summary = F.coalesce(F.nullif(text.strip_html(F.regexp_extract("block", r"(?is)<p>(.*?)</p>", 1)), F.lit("")), title)
    found = each.where(F.regexp_like("block", F.lit(anchor))).withColumns({"url": url, "title": title, "date": date, "summary": summary}).where(text.is_official_url(F.col("url"), domain))
    keys = [c for c in pages.columns if c != html_col]
    found = found.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
    return (found.where(F.col("position") <= most) if most else found).select(*keys, "position", "title", "date", "summary", "url")
