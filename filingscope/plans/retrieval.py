"""Queries of posting blocks and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import index, routing, search
from ..operators.shared import once
from .corpus import filings, questions, table
from .parts import CRC
from .queries import FILINGS, FOLDED, INDEX, QTERMS
from .registry import query

#: Postings of a block here: the tables have some hundred cases, so a list has a few blocks.
ROWS = 8


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(routing.posting_blocks(index.postings(filings(spark, sf_dir)), ROWS), "blocks")


@query(f"WITH {INDEX} SELECT * FROM routed")
def block_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best cases, by the posting blocks that can hold one."""
    return routing.route_by_blocks(questions(spark, sf_dir), _blocks(spark, sf_dir))


@query(f"""WITH {INDEX}, placed AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY stem ORDER BY weight DESC, case_number) - 1) / {ROWS}) AS INT) AS block, greatest(0, ln((cases + 1) / (df + 1))) AS idf FROM postings),
asked AS (SELECT question_id, stem, block, case_number, idf * weight / 100 AS w FROM placed JOIN qstems USING (stem) WHERE idf > 0),
tops AS (SELECT question_id, stem, block, max(w) AS top, count(*) AS n FROM asked GROUP BY ALL),
firsts AS (SELECT question_id, stem, top AS own, sum(top) OVER (PARTITION BY question_id) AS all_ FROM tops WHERE block = 0),
partial_ AS (SELECT question_id, case_number, sum(w) AS s FROM asked WHERE block = 0 GROUP BY ALL),
reached AS (SELECT question_id, CASE WHEN count(*) = 8 THEN min(s) ELSE 0 END AS reached FROM (SELECT * FROM partial_ QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY s DESC) <= 8) GROUP BY 1)
SELECT question_id, CAST(sum(n) AS BIGINT) AS postings, CAST(coalesce(sum(n) FILTER (top + all_ - own >= reached - 1e-6), 0) AS BIGINT) AS opened FROM tops JOIN firsts USING (question_id, stem) JOIN reached USING (question_id) GROUP BY 1""")
def block_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a question's postings are opened for its best cases."""
    found = routing.needed_blocks(questions(spark, sf_dir), _blocks(spark, sf_dir))
    return found.groupBy("question_id").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("needed"), F.col("n"))), F.lit(0)).alias("opened"))


# Phrases: a question's terms, and each two words that follow each other in it, as one term.
PHRASES = "pwords AS (SELECT item_id AS question_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), phrases AS (SELECT DISTINCT question_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE w || [w[i] || '-' || w[i + 1] FOR i IN range(1, len(w))] END) AS term FROM pwords), parts AS (SELECT term, unnest(string_split(term, '-')) AS word, generate_subscripts(string_split(term, '-'), 1) AS k, len(string_split(term, '-')) AS size FROM (SELECT DISTINCT term FROM phrases))"
PLACES = "places AS (SELECT filing_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS word, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), 1) AS spot FROM filings), starts AS (SELECT term, id, spot - k AS start FROM parts JOIN places USING (word) GROUP BY term, id, start, size HAVING count(*) = size), tf AS (SELECT term, id, count(*) AS tf FROM starts GROUP BY ALL)"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.matches(F.lower("text"), search.PLAIN_WORD)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("-"), b))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), words.alias("w")).select("question_id", F.array_distinct(F.concat("w", pairs)).alias("terms"), F.lit(None).cast("string").alias("case"))


@query(f"WITH {FILINGS}, {PHRASES}, {PLACES} SELECT term, id, tf FROM tf")
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the questions' words and pairs of words stand in a filing, by positional postings."""
    rows = filings(spark, sf_dir).select(F.col("filing_id").alias("id"), "text")
    return search.phrase_counts(_phrases(spark, sf_dir).select(F.explode("terms").alias("term")), once(search.positional_postings(rows), "positions"))


@query(f"""WITH {FILINGS}, {PHRASES}, {PLACES}, sz AS (SELECT filing_id AS id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS size FROM filings), tot AS (SELECT count(*) AS n, avg(size) AS mean FROM sz), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score FROM phrases JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (id), tot GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 8""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).select(F.col("filing_id").alias("id"), "case_number", "text")
    return search.phrase_search(_phrases(spark, sf_dir), rows)


@query(f"""WITH {FOLDED.replace(QTERMS + ', ', '').replace(' UNION SELECT term FROM qterms', '')}, p AS (SELECT case_number, count(DISTINCT filing_id) AS n, count(DISTINCT filing_id) FILTER (text IS NOT NULL) AS c FROM filings GROUP BY 1), b AS (SELECT DISTINCT case_number, filing_id % 4 AS band FROM filings WHERE text IS NOT NULL)
SELECT count(*) AS cases, count(*) FILTER (c > 0) AS content_cases, CAST(sum(n) AS BIGINT) AS associations, CAST(sum(c) AS BIGINT) AS content_associations, (SELECT count(DISTINCT {CRC}) FROM b) AS parts, (SELECT 256 * count(*) FROM b) AS filter_bytes FROM p""")
def router_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir)
    return index.router_totals(index.router_entries(rows), rows)


# Counts of shards as they may come: by source, some as text, some missing.
@query("WITH s AS (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS documents, CAST(coalesce(sum(chars) FILTER (n % 2 = 0), 0) AS BIGINT) AS chars FROM s WHERE source IS NOT NULL")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    shards = each.where("source IS NOT NULL").select(F.col("n").cast("string").alias("documents"), F.when(F.col("n") % 2 == 0, F.col("chars").cast("string")).otherwise("none").alias("chars"))
    return index.summed_counts(shards.unionByName(shards.limit(1).select(F.lit(None).cast("string").alias("documents"), F.lit("").alias("chars"))), "documents", "chars")
