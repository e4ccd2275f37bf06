"""Evidence rows to prompt context, answers and source lists; ordered text without driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markdown, text
from .shared import once

CONTEXT_CHARS, ANSWER_CHARS, TURNS, TURN_CHARS = 2200, 700, 10, 5000
# Sentences of answers.
NO_CONTEXT = "No matching indexed filing excerpts were found. Do not claim that the corpus proves an answer."
EXHAUSTIVE_NOTE = "\n\n> **Search scope:** Every indexed case was searched for your terms. Ranking favours rarer, more distinctive terms. Filings still being indexed, and filings whose text could not be extracted, are not covered."
NO_EVIDENCE = r"(?i)\b(?:no|insufficient|not enough)\s+(?:matching\s+)?evidence\b|\bcould(?:n['’]t| not)\s+find\b"


#: Rows of one report.
DIGEST_ROWS = 100


def joined(order: str, value: Column, separator: str) -> Column:
    """An aggregate: the group's values in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("value")))), lambda x: x["value"]), separator)


def source_context(rows: DataFrame) -> DataFrame:
    """(question_id, context) from rows with slot, case_number, title, received_date, page_number, url, excerpt."""
    # The labels of a record.
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Internal evidence record "), F.col("slot").cast("string"), F.lit(" (do not expose this number to the user)")),
        F.concat(F.lit("Required citation: "), text.citation(F.col("title"), F.col("url"), F.col("page_number"), F.lit(None).cast("string"))),
        F.concat(F.lit("Case: "), "case_number"),
        F.concat(F.lit("Filing: "), "title"),
        F.concat(F.lit("Date: "), F.coalesce("received_date", F.lit("unknown"))),
        F.concat(F.lit("Page: "), F.col("page_number").cast("string")),
        F.concat(F.lit("Official PDF page URL: "), text.pdf_page_url(F.col("url"), F.col("page_number"))),
        F.concat(F.lit("Excerpt: "), F.substring("excerpt", 1, CONTEXT_CHARS)),
    )
    return rows.groupBy("question_id").agg(joined("slot", block, "\n\n").alias("context"))


def transcripts(turns: DataFrame, capped: bool = True) -> DataFrame:
    """(conv_id, transcript): the last ten turns before the last message, and that message; all of them without a cap."""
    role = F.when(F.col("role") == "model", "Assistant").otherwise("User")
    content = F.substring("content", 1, TURN_CHARS) if capped else F.col("content")
    line = F.concat(role, F.lit(": "), content)
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("place", F.row_number().over(last)).where(F.col("place") <= TURNS + 1) if capped else turns  # the others' texts don't move
    grouped = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return grouped.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("transcript"))


def direct_answers(rows: DataFrame, search_url: str) -> DataFrame:
    """(question_id, answer): the excerpts themselves, without a model."""
    # The sentences of a direct answer.
    block = F.concat_ws("\n\n", F.concat(F.lit("**"), F.col("slot").cast("string"), F.lit(". "), F.col("case_number"), F.lit(": "), F.col("title"), F.lit(" — page "), F.col("page_number").cast("string"), F.lit("**")), F.substring("excerpt", 1, ANSWER_CHARS), F.concat(F.lit("[Open the official PDF at page "), F.col("page_number").cast("string"), F.lit("]("), text.pdf_page_url(F.col("url"), F.col("page_number")), F.lit(")")))
    intro = F.concat(F.lit("I found "), F.count("*").cast("string"), F.lit(" matching excerpt(s) in the indexed filings. AI synthesis is disabled, so these results are shown directly without any model/API charge."))
    return rows.groupBy("question_id").agg(intro.alias("intro"), joined("slot", block, "\n\n---\n\n").alias("body")).select("question_id", F.concat_ws("\n\n---\n\n", "intro", "body", F.lit(f"[Search the complete official records]({search_url})")).alias("answer"))


def answer_suffix(message: Column, reply: Column, exhaustive: Column, source_lines: Column, narrow_note: str) -> Column:
    """The scope note (none if the message names a case) and, unless the reply reports no evidence, the source list."""
    note = F.when(text.case_identifier(message).isNotNull(), "").when(exhaustive, F.lit(EXHAUSTIVE_NOTE)).otherwise(F.lit(narrow_note))
    bare = reply.rlike(NO_EVIDENCE) | (F.size(source_lines) == 0)
    return F.concat(note, F.when(bare, "").otherwise(F.concat(F.lit("\n\n---\n**Official filing sources**\n"), F.array_join(source_lines, "\n"))))


def source_line(case_number: Column, title: Column, received: Column, page: Column, url: Column, kind: Column) -> Column:
    dated = F.concat(text.citation_title(title), F.lit(" ("), text.long_date(received), F.lit(")"))
    record = F.concat(F.lit("- ["), case_number, F.lit(": "), dated, F.lit("]("), url, F.lit(") — metadata indexed; full text pending"))
    content = F.concat(F.lit("- ["), case_number, F.lit(": "), dated, F.lit(" — page "), page.cast("string"), F.lit("]("), text.pdf_page_url(url, page), F.lit(")"))
    return F.when(kind.eqNullSafe("metadata"), record).otherwise(content)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with number, from 0 in the order of ``order``: places within ranges, and a sum of the ranges' sizes."""
    ranged = once(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each task
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_at").bitwiseAND(2**33 - 1)).drop("_at", "_range", "_size", "_start")


def feedback_digest(rows: DataFrame, most: int = DIGEST_ROWS) -> DataFrame:
    """(batch, up, down, n, digest): all feedback (rating, reason, updated_at, request_id, question, answer_excerpt, comment) by time, ``most`` rows a digest; batch from 0."""
    rows = _numbered(rows, "updated_at", "request_id").withColumn("batch", F.floor(F.col("number") / most))
    # The digest's headings and reasons.
    labels = F.create_map(*(F.lit(x) for kv in {"incorrect": "Incorrect or misleading", "missing": "Missed important information", "citation": "Citation or source problem", "unclear": "Unclear or hard to use", "other": "Other"}.items() for x in kv))
    section = F.concat_ws("\n", F.concat(F.lit(". "), F.coalesce(F.try_element_at(labels, F.col("reason")), F.lit("Unspecified"))), F.lit(""), F.concat(F.lit("- Submitted: `"), text.safe_text(F.col("updated_at"), 40), F.lit("`")), F.concat(F.lit("- Request ID: `"), text.safe_text(F.col("request_id"), 40), F.lit("`")), F.lit(""), F.lit("**Question**"), F.lit(""), text.indented(F.col("question"), 1500), F.lit(""), F.lit("**Answer excerpt**"), F.lit(""), text.indented(F.col("answer_excerpt"), 2500), F.lit(""), F.lit("**User comment**"), F.lit(""), text.indented(F.col("comment"), 1000))
    down = F.col("rating") == "down"
    one = rows.groupBy("batch").agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(down).alias("down"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(down, F.struct("updated_at", "request_id", section.alias("s"))))).alias("sections"))
    head = F.concat(F.lit("## Answer feedback summary\n\n- 👍 Useful: **"), F.col("up").cast("string"), F.lit("**\n- 👎 Needs improvement: **"), F.col("down").cast("string"), F.lit("**\n- Total responses in this digest: **"), F.col("n").cast("string"), F.lit("**\n\nReview the negative responses below and decide which should become product or retrieval fixes."))
    body = F.array_join(F.transform("sections", lambda x, i: F.concat(F.lit("\n\n### "), (i + 1).cast("string"), x["s"])), "")
    return one.select("batch", "up", "down", "n", F.concat(head, body, F.lit("\n\n---\nThis digest was generated automatically from the site's answer feedback controls.\n")).alias("digest"))


def final_reply(message: Column, raw: Column, rows: Column, exhaustive: Column, source_lines: Column, narrow_note: str) -> Column:
    """A model's reply as it is shown: labels become citations, bare citations get links, then scope note and sources.

    ``rows``: array of (title, url, page_number, kind) in the order of the labels.
    """
    reply = markdown.relink(markdown.source_labels(raw, rows), rows)
    return F.concat(reply, answer_suffix(message, reply, exhaustive, source_lines, narrow_note))


def request_payload(instructions: Column, context: Column, transcript: Column, model: str, stream: bool = False) -> Column:
    """The JSON of a model request: instructions, and excerpts and conversation as its input."""
    asked = F.concat(F.lit("INDEXED E-DOCKET EXCERPTS:\n"), context, F.lit("\n\nCONVERSATION:\n"), transcript)
    plain = F.struct(F.struct(F.lit("text").alias("type")).alias("format"))
    return F.to_json(F.struct(F.lit(model).alias("model"), instructions.alias("instructions"), asked.alias("input"), plain.alias("text"), F.lit(stream).alias("stream")))


def response_text(payload: Column) -> Column:
    """The text of a model's answer in JSON: its plain text, else its output parts in lines; empty without either."""
    p = F.from_json(payload, "output_text string, output array<struct<content:array<struct<type:string,text:string>>>>")
    parts = F.flatten(F.transform(F.coalesce(p["output"], F.from_json(F.lit("[]"), "array<struct<content:array<struct<type:string,text:string>>>>")), lambda o: F.coalesce(o["content"], F.from_json(F.lit("[]"), "array<struct<type:string,text:string>>"))))
    texts = F.transform(F.filter(parts, lambda x: (x["type"] == "output_text") & x["text"].isNotNull()), lambda x: x["text"])
    return F.regexp_replace(F.coalesce(p["output_text"], F.array_join(texts, "\n"), F.lit("")), r"^\s+|\s+$", "")


def answer_or_excerpts(answer: Column, excerpts: Column) -> Column:
    """A model's answer, or the excerpts themselves if it gave none."""
    return F.when(F.length(F.trim(F.coalesce(answer, F.lit("")))) > 0, answer).otherwise(excerpts)


def static_stream(reply: Column, request_id: Column, token: Column) -> Column:
    """Array of the two events of an answer that is there at once."""
    done = F.to_json(F.struct(request_id.alias("requestId"), token.alias("feedbackToken")), {"ignoreNullFields": "false"})
    return F.array(event_frame(F.lit("delta"), F.to_json(F.struct(reply.alias("delta")))), event_frame(F.lit("done"), done))


def event_frame(kind: Column, payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


def parse_events(stream: Column, schema: str = "delta string, error string") -> Column:
    """Array of (event, data) of a stream of server-sent events; frames without data go."""
    frames = F.filter(F.split(stream, r"\r?\n\r?\n"), lambda f: F.contains(f, F.lit("data:")))
    return F.transform(frames, lambda f: F.struct(F.regexp_extract(f, r"(?m)^event:\s*(.*)$", 1).alias("event"), F.from_json(F.regexp_extract(f, r"(?m)^data:\s*(.*)$", 1), schema).alias("data")))


def session_title(turns: DataFrame) -> DataFrame:
    """(conv_id, title): the first user turn, cut to 30 characters."""
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("content", "turn").alias("first"))
    return first.select("conv_id", F.when(F.length("first") > 30, F.concat(F.substring("first", 1, 30), F.lit("..."))).otherwise(F.col("first")).alias("title"))
