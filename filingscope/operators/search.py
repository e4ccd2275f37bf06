"""Text search over chunks: BM25 of any-term queries, and a fielded search with boosts, prefixes and near spellings.

Both scores are this engine's own: k1 1.2, b 0.75.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text
from . import fielded
from .routing import DECIMALS
from .shared import once, small, small_batches

K1, B, ROWS = 1.2, 0.75, 8
#: A word of a chunk's text for phrases.
PLAIN_WORD = r"[\p{L}\p{N}]+"
# The local search's boosts and widths.
FIELDS = {"filename": 4.0, "docket_number": 3.0, "case_number": 3.0, "filing_type": 2.0, "filer": 2.0, "text": 1.0}
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY_SHARE, PHRASE_BOOST, CASE_BOOST = 0.375, 0.45, 0.12, 8.0, 5.0
#: Questions that a pass over the chunks answers, and terms whose df each of its tasks knows (12 bytes each).
QUESTIONS, COMMON = 2_000, 6_000_000


def _field_words(chunks: DataFrame, fields: list[str], *columns: str) -> DataFrame:
    """``columns``, field and words: a row for each field of a chunk."""
    return chunks.select(*columns, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), text.tokens(F.col(f)).alias("words")) for f in fields))))


def vocabulary(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """(field, term, df, docs, all), written: chunks with the term; docs and all sum up over a field's terms to its chunks with words, and their words."""
    each = _field_words(chunks, fields).select("field", F.size("words").alias("size"), F.posexplode(F.array_distinct("words")).alias("at", "term"))
    first = F.col("at") == 0
    return once(each.groupBy("field", "term").agg(F.count("*").alias("df"), F.count_if(first).alias("docs"), F.sum(F.when(first, F.col("size")).otherwise(0)).alias("all")), "vocabulary")


def _best_by_bm25(asked: DataFrame, counts: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(question_id, rank, id, score) of questions (question_id, case, term) by term counts (id, case_number, term, tf) and all chunks' sizes (id, size)."""
    totals = F.broadcast(sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean")))  # one row
    df = small(counts.groupBy("term").agg(F.count("*").alias("df")), 100_000)
    part = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    # A term's part is the same for all who ask for it; questions come last, when a chunk's terms lie together.
    parts = counts.join(df, "term").join(sizes, "id").crossJoin(totals).select("term", "id", "case_number", part.alias("part"))
    scored = parts.join(asked, "term").where("case IS NULL OR case = case_number")
    best = scored.groupBy("question_id", "id").agg(F.round(F.sum("part"), DECIMALS).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("question_id", "rank", "id", "score")


def bm25_search(questions: DataFrame, chunks: DataFrame, most: int = ROWS) -> DataFrame:
    """(question_id, rank, id, score): chunks that hold any term; one case only where the question names one.

    Texts are read once, and all words that nobody asks for become one row a chunk before anything moves.
    """
    asked = small(questions.select("question_id", "case", F.explode("terms").alias("term")))
    terms = small(questions.select(F.explode("terms").alias("term")).distinct().withColumn("asked", F.lit(True)))
    words = chunks.select("id", "case_number", F.explode_outer(text.tokens(F.col("text"))).alias("term")).join(terms, "term", "left")
    term = F.when(F.col("asked"), F.col("term"))
    counts = once(words.groupBy("id", "case_number", term.alias("asked_term")).agg(F.count("term").alias("tf")).withColumnRenamed("asked_term", "term"), "counts")
    return _best_by_bm25(asked, counts.where("term IS NOT NULL"), counts.groupBy("id").agg(F.sum("tf").alias("size")), most)


def positional_postings(chunks: DataFrame, words: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(word, key, gaps): where a word stands in a chunk, as the first place and the steps to each further one.

    Words are runs of letters and digits; ``words`` (word) are those that are wanted, all by default.
    """
    each = chunks.select(key, F.posexplode(text.matches(F.lower(F.coalesce("text", F.lit(""))), PLAIN_WORD)).alias("at", "word"))
    each = each if words is None else each.join(words, "word", "left_semi")
    held = each.groupBy("word", key).agg(F.sort_array(F.collect_list("at")).alias("at"))  # of one chunk
    gaps = F.zip_with("at", F.concat(F.array(F.lit(0)), F.slice("at", F.lit(1), F.size("at") - 1)), lambda x, before: x - before)
    return held.select("word", key, gaps.alias("gaps"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def places(gaps: pd.Series) -> pd.Series:
    """The places again."""
    return gaps.map(lambda g: np.cumsum(g, dtype=np.int32))


def _runs(spots: Column, n: int) -> Column:
    """Each ``n`` words that stand next to each other, joined by blanks; ``spots`` holds (at, word) by place."""
    if n == 1:
        return F.transform(spots, lambda x: x["word"])
    joined = F.transform(
        F.sequence(F.lit(0), F.size(spots) - n),
        lambda i: F.when(F.get(spots, i + (n - 1))["at"] == F.get(spots, i)["at"] + (n - 1), F.array_join(F.transform(F.slice(spots, i + 1, F.lit(n)), lambda x: x["word"]), " ")),
    )
    return F.when(F.size(spots) >= n, joined).otherwise(F.array().cast("array<string>"))


def phrase_counts(terms: DataFrame, postings: DataFrame, key: str = "id") -> DataFrame:
    """(term, key, tf): how often a term's words stand next to each other, by their places.

    A term is cut where it has neither letter nor digit; one word is a phrase of one, and
    a term without any is nowhere. A chunk's asked words are put in order once, and each run of
    as many as a term has is looked up, so the work grows with the words, not with words times terms.
    """
    cut = terms.select("term").distinct().withColumn("words", text.matches(F.lower("term"), PLAIN_WORD)).where(F.size("words") > 0)
    lengths = sorted(r[0] for r in cut.select(F.size("words")).distinct().collect())  # of terms, so a few numbers
    if not lengths:
        return postings.select(F.lit("").alias("term"), key, F.lit(0).cast("long").alias("tf")).limit(0)
    wanted = small(cut.select(F.explode("words").alias("word")).distinct(), 100_000)
    asked = small(cut.select("term", F.array_join("words", " ").alias("run")), 100_000)
    held = postings.join(wanted, "word", "left_semi").select(key, F.struct("word", places("gaps").alias("at")).alias("posting"))
    spots = F.flatten(F.transform("postings", lambda x: F.transform(x["at"], lambda at: F.struct(at.alias("at"), x["word"].alias("word")))))
    ordered = held.groupBy(key).agg(F.collect_list("posting").alias("postings")).select(key, F.sort_array(spots).alias("spots"))  # of one chunk
    runs = ordered.select(key, F.explode(F.array_compact(F.concat(*(_runs(F.col("spots"), n) for n in lengths)))).alias("run"))
    return runs.join(asked, "run").groupBy("term", key).agg(F.count("*").alias("tf"))


def phrase_search(questions: DataFrame, chunks: DataFrame, most: int = ROWS) -> DataFrame:
    """(question_id, rank, id, score): like ``bm25_search``, but a term of several words counts where they stand next to each other."""
    asked = small(questions.select("question_id", "case", F.explode("terms").alias("term")))
    words = small(questions.select(F.explode(F.flatten(F.transform("terms", lambda t: text.matches(F.lower(t), PLAIN_WORD)))).alias("word")).distinct(), 100_000)
    counts = once(phrase_counts(asked, positional_postings(chunks, words)), "phrases")
    sizes = chunks.select("id", "case_number", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(PLAIN_WORD)).alias("size"))
    sizes = once(sizes, "sizes")
    return _best_by_bm25(asked, counts.join(sizes.select("id", "case_number"), "id"), sizes.select("id", "size"), most)


def matching_rows(hits: DataFrame, chunks: DataFrame, documents: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Search hits (question_id, rank, id) with their chunk (id, filing_id, page_number) and document (filing_id, case_number, title, received_date).

    ``cases`` (question_id, case_number) keeps a question to one case; a question
    without a row there, or with a null, is free.
    """
    rows = hits.join(chunks, "id").join(documents, "filing_id")
    if cases is None:
        return rows
    wanted = rows.join(small(cases.select("question_id", F.col("case_number").alias("_case"))), "question_id", "left")
    return wanted.where(F.col("_case").isNull() | (F.col("_case") == F.col("case_number"))).drop("_case")


def newest_chunks(cases: DataFrame, chunks: DataFrame, most: int = ROWS) -> DataFrame:
    """Without terms: the first chunk of a case's newest filings."""
    first = chunks.join(cases, "case_number").groupBy("case_number", "filing_id").agg(F.min_by("text", F.struct("page_number", "id")).alias("text"), F.min("page_number").alias("page_number"), F.max("received_date").alias("received_date"))
    order = Window.partitionBy("case_number").orderBy(F.desc("received_date"), "filing_id")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def _frequencies(words: DataFrame, fields: list[str], seed: int = 0) -> tuple[DataFrame, fielded.Frequencies]:
    """Keys of all terms (key, df, field, term), and the df that tasks know: of the commonest ``COMMON`` terms, unless one chunk alone has them."""
    number = F.array_position(F.lit(fields), F.col("field")) - 1
    keyed = words.select(fielded.df_key(F.col("term"), number, seed).alias("key"), F.col("df").cast("int").alias("df"), "field", "term")
    n, distinct = keyed.agg(F.count("*"), F.count_distinct("key")).first()
    if n != distinct:  # two terms met at a key
        return _frequencies(words, fields, seed + 1)
    least, held = 2, 0
    for df, k in sorted(map(tuple, words.where("df > 1").groupBy("df").count().collect()), reverse=True):  # as many rows as there are different df
        if held + k > COMMON:
            least = df + 1
            break
        held += k
    return keyed, _known(keyed.where(F.col("df") >= least), least, seed)


def _known(keyed: DataFrame, least: int, seed: int) -> fielded.Frequencies:
    """``COMMON`` rows (key, df) as arrays, by key."""
    rows = keyed.select("key", "df").toArrow()
    keys, df = (rows.column(c).to_numpy() for c in ("key", "df"))
    order = np.argsort(keys)
    return fielded.Frequencies(keys[order], df[order], least, seed)


def _rare(chunks: DataFrame, fields: list[str], keyed: DataFrame, known: fielded.Frequencies) -> fielded.Frequencies:
    """What is known, with the df of all terms of ``chunks``."""
    own = _field_words(chunks, fields).select("field", F.explode("words").alias("term")).distinct()
    more = _known(keyed.where((F.col("df") > 1) & (F.col("df") < known.least)).join(small(own, 100_000), ["field", "term"], "left_semi"), 2, known.seed)
    keys, df = np.concatenate([known.keys, more.keys]), np.concatenate([known.df, more.df])
    order = np.argsort(keys)
    return fielded.Frequencies(keys[order], df[order], 2, known.seed)


def _few_best(chunks: DataFrame, asked: DataFrame, own: dict[str, float], stats: dict[str, tuple[int, int]], keyed: DataFrame, known: fielded.Frequencies, few: int) -> DataFrame:
    """(question_id, id, base), written: the ``few`` best chunks of each question (question_id, terms, numbers) by words alone."""
    spark = chunks.sparkSession
    told = fielded.Asked([tuple(r) for r in asked.collect()], {f: (b, *stats.get(f, (0, 0))) for f, b in own.items()}, (PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY_SHARE), (K1, B))
    share = spark.sparkContext.broadcast
    questions, order = share(told), Window.partitionBy("question_id").orderBy(F.desc("base"), "id")
    schema = T.StructType().add("question_id", asked.schema["question_id"].dataType).add("id", chunks.schema["id"].dataType).add("base", "double")

    def best(of: DataFrame, df: fielded.Frequencies, floors: dict | None = None) -> DataFrame:
        rows = of.select("id", "case_number", *(F.lower(F.coalesce(f, F.lit(""))).alias(f"f{i}") for i, f in enumerate(own)))
        found = rows.mapInArrow(fielded.best_chunks(questions, share(df), to_arrow_schema(schema), DECIMALS, few, floors), schema)
        if floors is not None:
            return once(found.select("id").distinct(), "close")
        return once(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= few).drop("_n"), "few")

    small_batches(spark)
    out = best(chunks, known)
    if known.least > 2:  # some df are between bounds: chunks that may be among the best by the upper one are read again
        last = out.groupBy("question_id").agg(F.count("*").alias("n"), F.min("base").alias("base")).where(F.col("n") >= few)
        close = chunks.join(small(best(chunks, known, {r["question_id"]: r["base"] for r in last.collect()}), 1_000_000), "id", "left_semi")
        out = best(close, _rare(close, list(own), keyed, known))
    return out


def fielded_search(questions: DataFrame, chunks: DataFrame, fields: dict[str, float] = FIELDS, most: int = 6) -> DataFrame:
    """(question_id, rank, id, score, phrase): boosted fields, longer words that a term opens, near spellings, phrase and case boosts.

    ``questions``: question_id, message. An id is one chunk's. The texts are read for the vocabulary, and once for each
    ``QUESTIONS`` questions, which tasks know with the df of terms that two chunks have; nothing is shuffled but the
    vocabulary and each task's best chunks. Of more than ``COMMON`` such terms the rarest lie between bounds, and
    what they leave open is read again.
    The best chunks by words alone, five times as many as are wanted and 25 at least, get
    the phrase and case boosts; where numbers are named, only their cases' chunks count.
    """
    own = {f: b for f, b in fields.items() if f in chunks.columns}
    words = vocabulary(chunks, list(own))
    asked = questions.select("question_id", text.local_query(F.col("message")).alias("query"), F.array_distinct(text.matches(F.col("message"), r"(?i)\b(?:FC\s*)?(\d{3,5})\b", 1)).alias("numbers"))
    terms = asked.select("question_id", F.array_distinct(text.tokens(F.col("query"))).alias("terms"), "numbers")
    stats = {r["field"]: (r["docs"], r["all"]) for r in words.groupBy("field").agg(F.sum("all").alias("all"), F.sum("docs").alias("docs")).collect()}  # a row for each field
    keyed, known = _frequencies(words, list(own))
    blocks = -(-max(1, questions.count()) // QUESTIONS)
    of_block = lambda i: terms.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
    few = reduce(DataFrame.unionByName, (_few_best(chunks, of_block(i), own, stats, keyed, known, max(5 * most, 25)) for i in range(blocks)))
    cased = F.exists("numbers", lambda n: F.contains(F.col("case_number"), n))
    # Texts stay where they are read.
    read = chunks.join(small(few.select("id").distinct(), 1_000_000), "id", "left_semi")
    full = small(few.join(small(asked), "question_id"), 100_000).join(read, "id")
    form = text.phrase_form(F.col("query"))
    phrase = (F.length(form) >= 5) & F.contains(text.phrase_form(F.concat_ws(" ", *(c for c in ("filename", "text") if c in chunks.columns))), form)
    full = full.withColumn("phrase", phrase).withColumn("score", F.round(F.col("base") + F.when(phrase, PHRASE_BOOST).otherwise(0.0) + F.when(cased, CASE_BOOST).otherwise(0.0), DECIMALS))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return full.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("question_id", "rank", "id", "score", "phrase")
