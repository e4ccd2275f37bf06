"""Questions to cases: exhaustive by postings, or sampled by folded Bloom filters.

Questions have question_id and terms; all questions run in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from .index import members
from .shared import once, small

MOST_STEMS, CANDIDATES, VERIFIED = 8, 8, 5
#: Postings of a block.
BLOCK_POSTINGS = 32
#: Scores are compared at this many decimals, so that the order of summation decides nothing.
DECIMALS = 6


def question_stems(questions: DataFrame) -> DataFrame:
    """(question_id, pos, stem): the first eight distinct stems in the order of the terms."""
    wanted = F.slice(F.array_distinct(F.transform("terms", text.stem)), 1, MOST_STEMS)
    return questions.select("question_id", F.posexplode(wanted).alias("pos", "stem"))


def case_scores(questions: DataFrame, postings: DataFrame) -> DataFrame:
    """(question_id, case_number, score, hits) of every case that a term reaches."""
    wanted = small(question_stems(questions))
    weight = scoring.idf(F.col("df"), F.col("cases"))
    joined = postings.where("case_number IS NOT NULL").join(wanted, "stem").withColumn("idf", weight).where("idf > 0")
    scored = joined.groupBy("question_id", "case_number").agg(F.sum(F.col("idf") * F.col("weight") / scoring.WEIGHT_SCALE).alias("score"), F.count("*").alias("hits"))
    return scored.withColumn("score", F.round("score", DECIMALS))


def route(questions: DataFrame, postings: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(question_id, rank, case_number, score, hits): the best cases by score, then hits, then number; rank from 1."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("hits"), "case_number")
    return case_scores(questions, postings).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("question_id", F.col("rank").cast("long"), "case_number", "score", "hits")


def posting_blocks(postings: DataFrame, rows: int = BLOCK_POSTINGS) -> DataFrame:
    """(stem, df, cases, block, top, n, entries): each stem's postings by falling weight, in blocks of ``rows``; top is a block's largest weight.

    Capped stems have no postings and so no block.
    """
    order = Window.partitionBy("stem").orderBy(F.desc("weight"), "case_number")
    placed = postings.where("case_number IS NOT NULL").withColumn("block", F.floor((F.row_number().over(order) - 1) / rows).cast("int"))
    entry = F.struct((-F.col("weight")).alias("back"), "case_number", "weight")
    held = placed.groupBy("stem", "block").agg(F.first("df").alias("df"), F.first("cases").alias("cases"), F.max("weight").alias("top"), F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("all"))  # rows postings
    return held.select("stem", "df", "cases", "block", "top", "n", F.transform("all", lambda e: F.struct(e["case_number"].alias("case_number"), e["weight"].alias("weight"))).alias("entries"))


def _summed(blocks: DataFrame) -> DataFrame:
    """(question_id, case_number, score, hits) of the postings in blocks with idf."""
    each = blocks.select("question_id", "idf", F.inline("entries"))
    return each.groupBy("question_id", "case_number").agg(F.sum(F.col("idf") * F.col("weight") / scoring.WEIGHT_SCALE).alias("score"), F.count("*").alias("hits"))


def needed_blocks(questions: DataFrame, blocks: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The blocks that can hold one of a question's best cases: question_id, stem, block, n, needed, and idf and entries for those.

    The best cases by each stem's first block alone set a score that is reached for sure. A case in a
    block scores at most the block's top and the first tops of all the question's other stems;
    where that is less, none of the block's cases is among the best, so it isn't opened. All
    blocks of every case among the best are opened, and their scores are whole.
    """
    wanted = small(question_stems(questions))
    asked = blocks.join(wanted, "stem").withColumn("idf", scoring.idf(F.col("df"), F.col("cases"))).where("idf > 0")
    tops = asked.select("question_id", "stem", "block", "n", (F.col("idf") * F.col("top") / scoring.WEIGHT_SCALE).alias("top"))
    best = tops.where("block = 0").groupBy("question_id").agg(F.sum("top").alias("all"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score")))
    reached = _summed(asked.where("block = 0")).withColumn("place", place).where(F.col("place") <= most).groupBy("question_id").agg(F.when(F.max("place") == most, F.min("score")).otherwise(0.0).alias("reached"))
    limits = small(once(best.join(reached, "question_id"), "limits"), 100_000)
    first = tops.where("block = 0").select("question_id", "stem", F.col("top").alias("own"))
    slack = 10.0**-DECIMALS  # more than sums in another order differ by
    bounded = tops.join(small(first, 100_000), ["question_id", "stem"]).join(limits, "question_id").withColumn("needed", F.col("top") + F.col("all") - F.col("own") >= F.col("reached") - slack)
    return bounded.select("question_id", "stem", "block", "n", "needed")


def route_by_blocks(questions: DataFrame, blocks: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The same best cases as ``route``, from the needed blocks (``posting_blocks``, written before) alone."""
    needed = small(once(needed_blocks(questions, blocks, most).where("needed").select("question_id", "stem", "block"), "needed"), 100_000)
    opened = blocks.join(needed, ["stem", "block"]).withColumn("idf", scoring.idf(F.col("df"), F.col("cases")))
    scored = _summed(opened).withColumn("score", F.round("score", DECIMALS))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("hits"), "case_number")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("question_id", "rank", "case_number", "score", "hits")


def term_report(questions: DataFrame, postings: DataFrame) -> DataFrame:
    """(question_id, discriminating, capped, missing): how the index knows a question's stems."""
    known = postings.groupBy("stem").agg(F.max(F.col("case_number").isNotNull()).alias("listed"))
    joined = question_stems(questions).join(known, "stem", "left")
    return joined.groupBy("question_id").agg(F.count_if("listed").alias("discriminating"), F.count_if(~F.col("listed")).alias("capped"), F.count_if(F.col("listed").isNull()).alias("missing"))


def route_by_filters(questions: DataFrame, entries: DataFrame, part: int | None = None, most: int = CANDIDATES) -> DataFrame:
    """Cases whose folded filters may hold at least two of a question's terms (or its only one).

    ``part`` None looks at all parts, -1 at the one that the terms' seed names, another
    number at that one.
    """
    from ..functions.hashing import ROUTER_BYTES, ROUTER_PARTS, route_seed

    asked = questions.where(F.size("terms") > 0).withColumn("chosen", (route_seed(F.col("terms")) % ROUTER_PARTS).cast("int")).withColumn("least", F.least(F.lit(2), F.size("terms")))
    asked = asked.select("question_id", "least", "chosen", F.explode("terms").alias("term"))
    entries = entries if part is None or part == -1 else entries.where(F.col("part") == part)
    hit = members(entries, asked, ROUTER_BYTES, "case_number", "band", "part").join(small(asked), "term")
    hit = hit.where("part = chosen") if part == -1 else hit
    scored = hit.groupBy("question_id", "case_number", "least").agg(F.count_distinct("term").alias("hits"), F.count("*").alias("score")).where("hits >= least")
    scored = scored.join(entries.select("case_number", "content_filings", "latest", "set_bits").distinct(), "case_number")
    order = Window.partitionBy("question_id").orderBy(F.desc("hits"), F.desc("score"), "set_bits", "content_filings", F.desc(F.coalesce("latest", F.lit(""))), "case_number")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("question_id", "rank", "case_number", "hits", "score", "set_bits")


def carry_over(routed: DataFrame, carried: DataFrame, most: int = VERIFIED) -> DataFrame:
    """Carried cases first (question_id, pos, case_number), then the routed ones that aren't among them."""
    fresh = routed.join(carried.select("question_id", "case_number"), ["question_id", "case_number"], "left_anti")
    both = carried.select("question_id", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("at"), "case_number").unionByName(fresh.select("question_id", F.lit(1).alias("kind"), F.col("rank").alias("at"), "case_number"))
    order = Window.partitionBy("question_id").orderBy("kind", "at")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("question_id", "rank", "case_number", (F.col("kind") == 0).alias("carried"))


def separation(routed: DataFrame) -> DataFrame:
    """How far the best kept case stands above the last."""
    return routed.groupBy("question_id").agg(F.round(F.max("score"), 2).alias("top"), F.round(F.max("score") - F.min("score"), 2).alias("separation"))


def rewordings(questions: DataFrame) -> DataFrame:
    """Each question with its terms as they are, reversed and rotated."""
    turned = F.concat(F.slice("terms", F.lit(2), F.greatest(F.size("terms") - 1, F.lit(0))), F.slice("terms", 1, 1))
    orders = F.array(F.struct(F.lit(0).alias("variant"), F.col("terms")), F.struct(F.lit(1).alias("variant"), F.reverse("terms").alias("terms")), F.struct(F.lit(2).alias("variant"), turned.alias("terms")))
    return questions.select("question_id", F.inline(orders))


def word_order_stability(questions: DataFrame, postings: DataFrame) -> DataFrame:
    """Whether a question's cases stay the same when its terms are reordered."""
    each = rewordings(questions).withColumn("asked", F.col("question_id")).withColumn("question_id", F.struct("asked", "variant"))
    routed = route(each, postings).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "case_number"))).alias("cases"))
    return routed.groupBy(F.col("question_id.asked").alias("question_id")).agg((F.count_distinct("cases") == 1).alias("stable"))
