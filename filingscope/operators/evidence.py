"""Filings of a case to evidence rows: candidates, verified excerpts, diversity and read budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, scoring, text
from .index import held_places
from .routing import DECIMALS
from .shared import once, small

MOST_READS, GROUPS, ROWS, A_DOCUMENT, A_CASE, SOURCES, RECORDS = 20, 10, 12, 2, 3, 10, 8
BEFORE, AFTER = 500, 1700
#: Terms of a case that a filter is asked for at once.
TERMS_AT_ONCE = 256


def pages_of(filings: DataFrame) -> DataFrame:
    """(filing_id, page_number, page): a page for each line of the text, from 1."""
    return filings.select("filing_id", F.posexplode(F.split("text", "\n")).alias("at", "page")).select("filing_id", (F.col("at") + 1).alias("page_number"), "page")


def candidates(searches: DataFrame, filings: DataFrame, filters: DataFrame, bits: bool = False) -> DataFrame:
    """Filings of each search's case whose filters may hold enough of its terms, with ``hits``, title and received_date.

    Texts stay behind until it is known which are read; ``bits`` tells whether the filters come along.

    Searches have question_id, case_number, terms, years and least. A filter is asked
    for the distinct terms of its own case alone, some hundred at a time.
    """
    asked = small(searches.select("question_id", "case_number", F.explode("terms").alias("term")))
    each = asked.select("case_number", "term").distinct().withColumn("part", F.floor(F.row_number().over(Window.partitionBy("case_number").orderBy("term")) / TERMS_AT_ONCE))
    spots = hashing.filter_bits(F.lower("term"))
    lists = each.groupBy("case_number", "part").agg(F.collect_list(F.struct("term", spots.alias("spots"))).alias("wanted"))
    held = filings.where("text IS NOT NULL").select("filing_id", "case_number").join(filters, "filing_id").join(small(lists, 1000), "case_number")
    places = held_places("bits", F.flatten(F.transform("wanted", lambda w: w["spots"])))
    found = held.select("filing_id", "case_number", "wanted", F.explode(places).alias("at")).select("filing_id", "case_number", F.get("wanted", F.col("at"))["term"].alias("term"))
    hits = found.join(asked, ["case_number", "term"]).groupBy("question_id", "case_number", "filing_id").agg(F.count("*").cast("int").alias("hits"))
    kept = hits.join(small(searches), ["question_id", "case_number"]).where("hits >= least")
    found = kept.join(filings.select("filing_id", "case_number", "title", "received_date"), ["filing_id", "case_number"])
    return found.join(filters, "filing_id") if bits else found


def rank_documents(found: DataFrame, as_of: str, adjusted: bool = False) -> DataFrame:
    """``found`` with score and rank (from 1): by score, then date, then filing."""
    hits = scoring.adjusted_hits(F.col("hits"), F.size("terms"), scoring.fill_ratio(F.col("bits"), 2048)) if adjusted else F.col("hits")
    scored = found.withColumn("score", F.round(scoring.document_score(hits, F.col("received_date"), F.col("years"), as_of), DECIMALS))
    order = Window.partitionBy("question_id", "case_number").orderBy(F.desc("score"), F.desc(F.coalesce("received_date", F.lit(""))), "filing_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def excerpts(searched: DataFrame, pages: DataFrame, most: int = A_DOCUMENT) -> DataFrame:
    """Up to two pages of each filing with most stems: question_id, case_number, filing_id, rank, depth, page_number, matched, excerpt.

    Stems are looked for as substrings and count each, equal ones too.
    """
    plain = text.decode_entities(F.regexp_replace("page", "<[^>]*>", " "))
    tasks = pages.sparkSession.sparkContext.defaultParallelism  # by number: a page costs far more to look through than its bytes tell
    cleaned = pages.repartition(tasks, "filing_id").select("filing_id", "page_number", plain.alias("plain"))  # once, however many searches read the filing
    rows = searched.withColumn("stems", F.transform("terms", text.stem)).join(cleaned, "filing_id").withColumn("low", F.lower("plain"))
    rows = rows.withColumn("spots", F.filter(F.transform("stems", lambda t: F.instr(F.col("low"), t)), lambda i: i > 0)).withColumn("matched", F.size("spots")).where(F.col("matched") >= F.col("least"))
    first = F.array_min("spots") - 1
    start, end = F.greatest(F.lit(0), first - BEFORE), F.least(F.length("plain"), first + AFTER)
    excerpt = F.concat(F.when(start > 0, "…").otherwise(""), F.substring("plain", start + 1, end - start), F.when(end < F.length("plain"), "…").otherwise(""))
    order = Window.partitionBy("question_id", "case_number", "filing_id").orderBy(F.desc("matched"), "page_number")
    return rows.withColumn("depth", F.row_number().over(order).cast("long")).where(F.col("depth") <= most).select("question_id", "case_number", "filing_id", "title", "received_date", "rank", "depth", "page_number", "matched", excerpt.alias("excerpt"))


def first_groups(rows: DataFrame, most: int = GROUPS) -> DataFrame:
    """Rows of the first ten filings, in rank order, that have any."""
    order = Window.partitionBy("question_id", "case_number").orderBy("rank")
    return rows.withColumn("group", F.dense_rank().over(order)).where(F.col("group") <= most)


def diverse_documents(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """First excerpts of all filings before second ones; ``slot`` from 1."""
    order = Window.partitionBy("question_id", "case_number").orderBy("depth", "rank")
    return rows.withColumn("slot", F.row_number().over(order).cast("long")).where(F.col("slot") <= most)


def diverse_cases(rows: DataFrame, a_case: int = A_CASE, most: int = ROWS) -> DataFrame:
    """At most three rows of a case, in case order; a (filing, page) of several cases keeps its first place and last case."""
    own = Window.partitionBy("question_id", "case_rank").orderBy("slot")
    few = rows.withColumn("own", F.row_number().over(own)).where(F.col("own") <= a_case)
    same = few.groupBy("question_id", "filing_id", "page_number").agg(F.min(F.struct("case_rank", "own")).alias("first"), F.max_by("case_number", F.struct("case_rank", "own")).alias("case_number"))
    order = Window.partitionBy("question_id").orderBy("first")
    return same.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("question_id", "place", "case_number", "filing_id", "page_number")


def within_budget(ranked: DataFrame) -> DataFrame:
    """Filings that a routed case's place lets be read: five, three, then two."""
    return ranked.where(F.col("rank") <= scoring.read_budget(F.col("case_rank") - 1))


def record_rows(searches: DataFrame, filings: DataFrame, as_of: str, most: int = RECORDS) -> DataFrame:
    """The best records by their titles alone; without terms, the newest."""
    low = F.lower(F.concat_ws(" ", "title", F.lit("")))
    rows = filings.join(searches, "case_number").withColumn("hits", F.size(F.filter("terms", lambda t: F.contains(low, t)))).where((F.size("terms") == 0) | (F.col("hits") > 0))
    return rank_documents(rows, as_of).where(F.col("rank") <= most).select("question_id", "case_number", "filing_id", "rank", "hits", "score")


def search_case(searches: DataFrame, filings: DataFrame, filters: DataFrame, as_of: str, reads: int = MOST_READS) -> DataFrame:
    """Evidence of each (question, case): ranked candidates, the first twenty read, ten groups, twelve rows."""
    named = ["question_id", "case_number", "filing_id", "title", "received_date", "terms", "least", "rank"]
    read = once(rank_documents(candidates(searches, filings, filters), as_of).where(F.col("rank") <= reads).select(*named), "read")
    return diverse_documents(first_groups(excerpts(read, read_pages(read, filings))))


def read_pages(read: DataFrame, filings: DataFrame) -> DataFrame:
    """The pages of the filings that are read, each filing's once."""
    return pages_of(filings.select("filing_id", "text").join(small(read.select("filing_id").distinct(), 100_000), "filing_id", "left_semi"))


def asked_filings(searches: DataFrame, filings: DataFrame) -> DataFrame:
    """The filings of the cases that are searched, written once: all steps of a search read them."""
    return once(filings.join(small(searches.select("case_number").distinct()), "case_number", "left_semi").select(*filings.columns), "asked-filings")


def sources(rows: DataFrame, most: int = SOURCES) -> DataFrame:
    """Distinct filings of an answer: at the first row's place, with the last row's page."""
    each = rows.groupBy("question_id", "filing_id").agg(F.min("slot").alias("first"), F.max_by("page_number", "slot").alias("page_number"))
    order = Window.partitionBy("question_id").orderBy("first")
    return each.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("question_id", "place", "filing_id", "page_number")
