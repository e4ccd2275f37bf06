"""Answers from the local index and enrichment of short questions: citations, context blocks, sources and hints.

Results have question_id, rank (from 1), case_number, docket_number, filing_id, filename,
filing_type, filer, received_date, page, matched_terms, phrase, url and text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text
from .render import joined

#: News that are looked through, and those that are shown.
NEWS, SHOWN = 6, 3
# What a message must say for a hint, and the hint.
HINTS = {
    r"(?i)(pepco|potomac electric)": "Utility hint: Pepco refers to Potomac Electric Power Company. Prioritize electric distribution, reliability, multiyear rate plan, grid modernization, and climate/clean-energy compliance context when relevant.",
    r"(?i)(washington gas|wgl)": "Utility hint: Washington Gas matters usually connect to gas system upgrades, pipeline safety, emissions, rate design, and public hearings.",
    r"(?i)(dc water|water)": "Utility hint: Water-related questions may overlap with DC Water proceedings, infrastructure, and utility oversight records.",
    r"(?i)(renewable|solar|clean energy|climate)": "Topic hint: Renewable-energy questions often connect to clean-energy goals, distributed energy resources, virtual power plants, interconnection, and climate commitments.",
    r"(?i)(rate|rates)": "Topic hint: Rate questions should mention how to identify the relevant formal case, current status, recent filings, hearings, and where to monitor official updates.",
}


def local_page_url(url: Column, page: Column) -> Column:
    """The address of a page in a PDF; what is no URL stays as it is."""
    return F.when(text.host(url).isNotNull(), text.pdf_page_url(url, page)).otherwise(url)


def local_citation(filename: Column, page: Column, url: Column) -> Column:
    label = F.trim(F.regexp_replace(F.regexp_replace(filename, r"[\[\]\r\n]+", " "), r"\s+", " "))
    return F.concat(F.lit("["), label, F.lit(" — p. "), page.cast("string"), F.lit("]("), local_page_url(url, page), F.lit(")"))


def local_context(results: DataFrame) -> DataFrame:
    """(question_id, context): the results as records of evidence, in the order of their rank."""
    # The heading, the instruction and the labels of a record.
    head = "LOCAL E-DOCKET RETRIEVAL RESULTS:\n\nUse these excerpts as the primary evidence for claims about filing contents. Do not claim that an excerpt says something it does not say. Use each record's Required citation exactly; never display Local Source N labels."
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Internal evidence record "), F.col("rank").cast("string"), F.lit(" (do not expose this number to the user)")),
        line("Required citation", local_citation(F.col("filename"), F.col("page"), F.col("url"))),
        line("Case", "case_number"),
        line("Docket", "docket_number"),
        line("Document", "filename"),
        line("Filing type", known("filing_type")),
        line("Filer", known("filer")),
        line("Received", known("received_date")),
        line("Page", F.col("page").cast("string")),
        line("Matched terms", F.coalesce(F.nullif(F.array_join("matched_terms", ", "), F.lit("")), F.lit("metadata match"))),
        line("Full cleaned query appears as an exact phrase", F.when(F.col("phrase"), "yes").otherwise("no")),
        line("Official PDF", local_page_url(F.col("url"), F.col("page"))),
        line("Excerpt", F.coalesce("text", F.lit(""))),
    )
    return results.groupBy("question_id").agg(F.concat(F.lit(head + "\n\n"), joined("rank", block, "\n\n")).alias("context"))


def labels_replaced(reply: str, citations: list[str]) -> str:
    """'Local Source n', bracketed (with a target or not) or plain, becomes the n-th citation, in one pass."""
    page = r"(?:\s*,?\s*p(?:age)?\.?\s*\d+)?"
    label = re.compile(rf"\[\s*Local\s+Source\s+(\d+){page}\s*\](?:\([^\n)]+\))?|\bLocal\s+Source\s+(\d+){page}\b", re.I)

    def cited(match: re.Match) -> str:
        n = int(match.group(1) or match.group(2))
        return citations[n - 1] if 1 <= n <= len(citations) else match.group()

    return label.sub(cited, reply)


@F.pandas_udf(T.StringType())
def local_labels(reply: pd.Series, citations: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else labels_replaced(r, list(c) if c is not None else []) for r, c in zip(reply, citations, strict=True)])


def local_replies(replies: DataFrame, results: DataFrame) -> DataFrame:
    """(question_id, reply) of replies (question_id, reply): labels become citations, and the sources follow, each page of a filing once, at its first rank."""
    pages = Window.partitionBy("question_id", "filing_id", "page").orderBy("rank")
    rows = results.withColumn("first", F.row_number().over(pages) == 1)
    label = F.concat(F.coalesce(F.nullif("docket_number", F.lit("")), "case_number"), F.lit(" — "), "filename", F.lit(", p. "), F.col("page").cast("string"))
    source = F.when(F.col("first"), F.concat(F.lit("- ["), label, F.lit("]("), local_page_url(F.col("url"), F.col("page")), F.lit(")")))
    entry = F.struct("rank", local_citation(F.col("filename"), F.col("page"), F.col("url")).alias("citation"), source.alias("source"))
    held = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("own"))  # a question's results are few
    both = replies.join(held, "question_id", "left")
    shown = local_labels(F.col("reply"), F.transform("own", lambda x: x["citation"]))
    lines = F.array_join(F.filter(F.transform("own", lambda x: x["source"]), lambda x: x.isNotNull()), "\n")
    # Fixed value: the heading of the sources.
    end = F.when(F.size("own") > 0, F.concat(F.lit("\n\n---\n**Retrieved from the local e-Docket index:**\n"), lines)).otherwise("")
    return both.select("question_id", F.concat(shown, end).alias("reply"))


def short_query_enrichment(questions: DataFrame, news: DataFrame, agency: str, links: list[tuple[str, str]]) -> DataFrame:
    """(question_id, context, links) of short questions on the topic: search terms, hints, and news (position, title, date, summary, url) that a word of the question occurs in.

    Without such news the newest are shown. ``links`` are the (url, title) that every answer
    may use; those of matching news follow.
    """
    latest = news.where(F.col("position") <= NEWS).agg(F.array_sort(F.collect_list(F.struct("position", "title", "date", "summary", "url"))).alias("news"))  # one row of NEWS items
    asked = questions.where(text.is_short_query(F.col("message")) & text.is_on_topic(F.col("message"))).crossJoin(F.broadcast(latest))
    asked = asked.withColumn("words", text.short_query_words(F.col("message")))
    meets = lambda item: F.exists("words", lambda w: F.contains(F.lower(F.concat_ws(" ", item["title"], item["summary"])), w))
    asked = asked.withColumn("matched", F.slice(F.filter("news", meets), 1, SHOWN))
    listed = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["title"], F.lit(" ("), x["date"], F.lit(")"))), "\n")
    # The sentences of the context.
    terms = F.when(F.size("words") > 0, F.concat(F.lit("Suggested e-Docket search terms: "), F.array_join(F.transform("words", lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", "), F.lit(".")))
    hints = [F.when(F.col("message").rlike(test), F.lit(hint)) for test, hint in HINTS.items()]
    shown = F.when(F.size("matched") > 0, F.concat(F.lit(f"Recent official {agency} items related to this query:\n"), listed(F.col("matched")))).otherwise(F.concat(F.lit(f"Recent official {agency} items available now:\n"), listed(F.slice("news", 1, SHOWN))))
    lines = ["SHORT-QUERY ENRICHMENT:", f"The user's message is brief but relevant to the {agency}. Be proactively helpful rather than minimal.", "Give a compact overview, then add the most useful next places to look, likely records or proceeding types, and official links.", "If you mention a recent official news item from the context below, use the exact title text so the server can link it inline."]
    context = F.concat_ws("\n", *map(F.lit, lines), terms, *hints, shown)
    fixed = F.array(*(F.struct(F.lit(url).alias("url"), F.lit(title).alias("title")) for url, title in links))
    more = F.transform("matched", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title")))
    return asked.select("question_id", context.alias("context"), F.concat(fixed, more).alias("links"))
