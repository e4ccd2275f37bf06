"""One search for every question: by its case, over all cases, or over the chunks, whichever answers first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import evidence, routing, search
from .shared import once, small


def carried_cases(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """(question_id, pos, case_number): for questions that lean on the one before, the cases of their conversation's last citing answer.

    Questions have conv_id, message and terms; turns conv_id, turn, role and content.
    """
    from .operations import recent_cases

    leaning = questions.where(text.is_follow_up(F.col("message"), F.col("terms"))).select("question_id", "conv_id")
    return recent_cases(turns).join(small(leaning), "conv_id").select("question_id", "pos", "case_number")


def routed_cases(questions: DataFrame, exhaustive: DataFrame, entries: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """(question_id, rank, case_number, routing): carried cases, then those of the whole index, or of the sampled router where it is not available."""
    listed = exhaustive.where("available AND rank IS NOT NULL").select("question_id", "rank", "case_number")
    open_ = questions.join(exhaustive.where("NOT available").select("question_id").distinct(), "question_id", "left_semi")
    sampled = routing.route_by_filters(open_, entries, part=-1).select("question_id", "rank", "case_number")
    way = exhaustive.groupBy("question_id").agg(F.when(F.max("available"), "exhaustive").otherwise("sampled").alias("routing"))
    both = listed.unionByName(sampled)
    none = both.select("question_id", F.lit(0).alias("pos"), "case_number").limit(0)
    return routing.carry_over(both, none if carried is None else carried).join(way, "question_id", "left").withColumn("routing", F.coalesce("routing", F.lit("sampled")))


def search_dockets(questions: DataFrame, filings: DataFrame, filters: DataFrame, chunks: DataFrame, exhaustive: DataFrame, entries: DataFrame, as_of: str, carried: DataFrame | None = None) -> DataFrame:
    """(question_id, way, place, case_number, filing_id, page_number): the evidence rows of each question.

    A question (question_id, message, terms, years) that names a case is searched in it.
    Any other one with terms is searched in at most five cases (``exhaustive`` is what
    ``route_published`` gives, ``entries`` are the router's), with a read budget by
    place and at most three rows of a case. What neither answers goes to the chunks
    (id, filing_id, case_number, page_number, received_date, text): by its terms, or
    without terms the newest ones of its case. ``way`` is case, exhaustive, sampled or
    chunks. A question without terms and case has no row.
    """
    asked = once(questions.select("question_id", "message", "terms", "years").withColumn("case_number", text.case_identifier(F.col("message"))), "asked")
    named = asked.where("case_number IS NOT NULL").withColumn("least", F.lit(1))
    in_case = evidence.search_case(named.drop("message"), filings, filters, as_of)
    in_case = in_case.select("question_id", F.lit("case").alias("way"), F.col("slot").alias("place"), "case_number", "filing_id", "page_number")

    open_ = asked.where("case_number IS NULL AND size(terms) > 0").drop("case_number")
    routed = once(routed_cases(open_, exhaustive.join(open_, "question_id", "left_semi"), entries, carried), "routed")
    searches = routed.withColumnRenamed("rank", "case_rank").join(open_.drop("message"), "question_id").withColumn("least", F.least(F.lit(2), F.size("terms")))
    read = once(evidence.within_budget(evidence.rank_documents(evidence.candidates(searches, filings, filters), as_of)), "read")
    found = evidence.excerpts(read.select("question_id", "case_number", "filing_id", "title", "received_date", "terms", "least", "rank"), evidence.read_pages(read, filings))
    slots = evidence.diverse_documents(evidence.first_groups(found)).join(routed.select("question_id", "case_number", F.col("rank").alias("case_rank")), ["question_id", "case_number"])
    over_all = evidence.diverse_cases(slots).join(routed.select("question_id", F.col("routing").alias("way")).distinct(), "question_id")

    columns = ["question_id", "way", "place", "case_number", "filing_id", "page_number"]
    answered = once(in_case.select(*columns).unionByName(over_all.select(*columns)), "answered")
    rest = asked.join(answered.select("question_id").distinct(), "question_id", "left_anti")
    ranked = search.phrase_search(rest.where("size(terms) > 0").select("question_id", "terms", F.col("case_number").alias("case")), chunks).select("question_id", F.col("rank").alias("place"), "id")
    by_terms = ranked.join(chunks.select("id", "case_number", "filing_id", "page_number"), "id")
    bare = rest.where("size(terms) = 0 AND case_number IS NOT NULL").select("question_id", "case_number")
    newest = search.newest_chunks(bare.select("case_number").distinct(), chunks).join(bare, "case_number").withColumnRenamed("rank", "place")
    last = by_terms.select("question_id", "place", "case_number", "filing_id", "page_number").unionByName(newest.select("question_id", "place", "case_number", "filing_id", "page_number"))
    return answered.unionByName(last.withColumn("way", F.lit("chunks")).select(*columns))
