"""Queries of answers from the local index and of short questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import local
from .corpus import table
from .registry import query

# Each document is a result of one of fifty questions; two in a row are of one filing, so pages repeat.
RESULTS = ("doc_id % 50 AS question_id", "'FC' || CAST(1000 + doc_id % 9 AS STRING) AS case_number", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'FC' || CAST(1000 + doc_id % 9 AS STRING) || ' - ' || lang END AS docket_number", "doc_id % 100 AS filing_id", "'[' || source || '].pdf' AS filename", "CASE WHEN doc_id % 3 = 0 THEN lang END AS filing_type", "source AS filer", "CASE WHEN doc_id % 5 > 0 THEN '2024-01-02' END AS received_date", "doc_id % 3 - 1 AS page", "doc_id % 2 = 0 AS phrase", "CASE WHEN doc_id % 7 = 0 THEN 'no url' ELSE 'https://x.org/' || source || '.pdf#old' END AS url", "text", "doc_id")
RANKED = f"results AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_id) AS rank FROM (SELECT {', '.join(RESULTS)} FROM documents WHERE source IS NOT NULL))"
URL = "CASE WHEN url = 'no url' THEN url ELSE 'https://x.org/' || filer || '.pdf#page=' || greatest(1, page) END"
CITED = f"'[' || filer || ' .pdf — p. ' || page || '](' || {URL} || ')'"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").selectExpr(*RESULTS)
    words = F.slice(F.array_distinct(text.tokens(F.col("filer"))), 1, F.when(F.col("phrase"), 5).otherwise(0))
    return rows.withColumn("matched_terms", words).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")))


@query(f"""WITH {RANKED} SELECT question_id, 'LOCAL E-DOCKET RETRIEVAL RESULTS:' || chr(10) || chr(10) || 'Use these excerpts as the primary evidence for claims about filing contents. Do not claim that an excerpt says something it does not say. Use each record''s Required citation exactly; never display Local Source N labels.' || chr(10) || chr(10) || string_agg(concat_ws(chr(10),
  'Internal evidence record ' || rank || ' (do not expose this number to the user)', 'Required citation: ' || {CITED}, 'Case: ' || case_number, 'Docket: ' || docket_number, 'Document: ' || filename, 'Filing type: ' || coalesce(filing_type, 'Unknown'), 'Filer: ' || filer, 'Received: ' || coalesce(received_date, 'Unknown'), 'Page: ' || page, 'Matched terms: ' || CASE WHEN phrase AND len(filer) > 1 THEN filer ELSE 'metadata match' END, 'Full cleaned query appears as an exact phrase: ' || CASE WHEN phrase THEN 'yes' ELSE 'no' END, 'Official PDF: ' || {URL}, 'Excerpt: ' || coalesce(text, '')), chr(10) || chr(10) ORDER BY rank) AS context FROM results GROUP BY 1""")
def local_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.local_context(_results(spark, sf_dir))


@query(f"""WITH {RANKED}, marked AS (SELECT *, row_number() OVER (PARTITION BY question_id, filing_id, page ORDER BY rank) = 1 AS first_ FROM results),
c AS (SELECT question_id, max({CITED}) FILTER (rank = 1) AS one, coalesce(max({CITED}) FILTER (rank = 2), 'Local  source 2, p. 9') AS two, string_agg('- [' || coalesce(nullif(docket_number, ''), case_number) || ' — ' || filename || ', p. ' || page || '](' || {URL} || ')', chr(10) ORDER BY rank) FILTER (first_) AS lines FROM marked GROUP BY 1)
SELECT r.question_id, CASE WHEN one IS NULL THEN 'By [Local Source 1](x), Local  source 2, p. 9 and Local Source 99999.' ELSE 'By ' || one || ', ' || two || ' and Local Source 99999.' || chr(10) || chr(10) || '---' || chr(10) || '**Retrieved from the local e-Docket index:**' || chr(10) || lines END AS reply FROM (SELECT DISTINCT doc_id % 60 AS question_id FROM documents) r LEFT JOIN c USING (question_id)""")
def local_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose labels become citations, with their sources; some questions have no result."""
    replies = table(spark, sf_dir, "documents").select((F.col("doc_id") % 60).alias("question_id")).distinct().withColumn("reply", F.lit("By [Local Source 1](x), Local  source 2, p. 9 and Local Source 99999."))
    return local.local_replies(replies, _results(spark, sf_dir))


BRIEF = ("doc_id AS question_id", "source || CASE doc_id % 5 WHEN 0 THEN ' solar rates' WHEN 1 THEN ' Pepco' WHEN 2 THEN ' utility' WHEN 3 THEN ' water' ELSE ' and what follows makes this message much too long to be short' END AS message")
ITEMS = ("n_nationkey + 1 AS position", "CASE WHEN n_nationkey % 4 = 1 THEN 'Solar and src3 in ' ELSE 'Notice of ' END || n_name AS title", "'January ' || CAST(n_nationkey + 1 AS STRING) AS date", "CASE WHEN n_nationkey % 3 = 0 THEN 'pepco and src1' ELSE '' END AS summary", "'https://x.org/' || n_name AS url")


@query(f"""WITH q AS (SELECT question_id, message, list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda w: length(w) >= 3) AS words FROM (SELECT {', '.join(BRIEF)} FROM documents WHERE source IS NOT NULL AND doc_id % 5 <> 4)),
n AS (SELECT {', '.join(ITEMS)} FROM nation WHERE n_nationkey < 6), m AS (SELECT question_id, position, title, date, url FROM q, n WHERE len(list_filter(words, lambda w: contains(lower(title || ' ' || summary), w))) > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY position) <= 3),
g AS (SELECT question_id, string_agg('- ' || title || ' (' || date || ')', chr(10) ORDER BY position) AS listed, count(*) AS hits FROM m GROUP BY 1), f AS (SELECT string_agg('- ' || title || ' (' || date || ')', chr(10) ORDER BY position) AS listed FROM n WHERE position <= 3)
SELECT question_id, concat_ws(chr(10), 'SHORT-QUERY ENRICHMENT:', 'The user''s message is brief but relevant to the agency. Be proactively helpful rather than minimal.', 'Give a compact overview, then add the most useful next places to look, likely records or proceeding types, and official links.', 'If you mention a recent official news item from the context below, use the exact title text so the server can link it inline.',
  'Suggested e-Docket search terms: ' || array_to_string(list_transform(words, lambda w: '"' || w || '"'), ', ') || '.',
  {', '.join(f"CASE WHEN regexp_matches(message, '{t}') THEN '{h}' END" for t, h in local.HINTS.items())},
  CASE WHEN g.listed IS NOT NULL THEN 'Recent official agency items related to this query:' || chr(10) || g.listed ELSE 'Recent official agency items available now:' || chr(10) || f.listed END) AS context, 1 + coalesce(hits, 0) AS links FROM q LEFT JOIN g USING (question_id), f""")
def short_query_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context and links of short questions on the topic; each fifth message is too long."""
    asked = table(spark, sf_dir, "documents").where("source IS NOT NULL").selectExpr(*BRIEF)
    news = table(spark, sf_dir, "nation").selectExpr(*ITEMS)
    found = local.short_query_enrichment(asked, news, "agency", [("https://x.org/search", "Search")])
    return found.select("question_id", "context", F.size("links").cast("long").alias("links"))
