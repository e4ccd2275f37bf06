"""Queries of the search engine over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hashing, scoring, text
from ..operators import evidence, index, ingest, operations, records, render, routing, search
from ..operators.shared import once, small
from ..streaming import jobs
from .corpus import AS_OF, filings, questions, table, turns
from .registry import query

# SQL that several oracles share.
FILINGS = """filings AS (SELECT doc_id AS filing_id, CASE WHEN doc_id % 3 = 0 THEN 'FC1000' ELSE 'FC' || CAST(1001 + doc_id % 96 AS VARCHAR) END AS case_number,
  left(text, 80) AS title, strftime(o_orderdate, '%Y-%m-%d') AS received_date, 'https://records.example.org/filing/' || doc_id AS url, text FROM documents LEFT JOIN orders ON o_orderkey = doc_id)"""


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9''-]{{1,39}}')"


def stem_sql(w: str) -> str:
    cases = [f"WHEN length({w}) <= 5 OR ends_with({w}, '''s') THEN {w}"]
    for endings, least in ((text.DERIVED_ENDINGS, text.DERIVED_LEAST), (text.INFLECTED_ENDINGS, text.STEM_LEAST)):
        cases += [f"WHEN ends_with({w}, '{e}') AND length({w}) - {len(e)} >= {least} THEN left({w}, length({w}) - {len(e)})" for e in endings]
    return f"(CASE {' '.join(cases)} ELSE {w} END)"


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
QTERMS = f"""qwords AS (SELECT item_id AS question_id, text AS message, {tok("array_to_string(regexp_extract_all(text, '[“\"]([^”\"]{2,80})[”\"]', 1), ' ') || ' ' || text")} AS l FROM benchmark),
qfirst AS (SELECT question_id, w, min(p) AS p FROM (SELECT question_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM qwords) GROUP BY ALL),
qterms AS (SELECT question_id, w AS term, row_number() OVER (PARTITION BY question_id ORDER BY p) AS pos FROM qfirst WHERE w NOT IN ({STOP}) AND NOT regexp_matches(w, '^fc?[0-9]+$') QUALIFY pos <= 12)"""
QSTEMS = f"""qstem1 AS (SELECT question_id, {stem_sql("term")} AS stem, min(pos) AS p FROM qterms GROUP BY ALL),
qstems AS (SELECT question_id, stem, row_number() OVER (PARTITION BY question_id ORDER BY p) AS pos FROM qstem1 QUALIFY pos <= 8)"""
TERMS = f"""toks AS (SELECT DISTINCT filing_id, case_number, {stem_sql("t")} AS stem FROM (SELECT filing_id, case_number, unnest({tok("text")}) AS t FROM filings)),
case_terms AS (SELECT case_number, stem, count(*) AS n FROM toks GROUP BY ALL),
sizes AS (SELECT case_number, count(*) AS filings FROM filings GROUP BY ALL),
totals AS (SELECT count(*) AS cases, avg(filings) AS mean, greatest(32, CAST(floor(0.15 * count(*)) AS INT)) AS cap FROM sizes WHERE case_number IN (SELECT case_number FROM case_terms)),
dfs AS (SELECT stem, count(*) AS df FROM case_terms GROUP BY stem)"""
POSTINGS = """postings AS (SELECT stem, case_number, df, greatest(1, CAST(round_even(100 * (n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * (filings / mean)))), 0) AS INT)) AS weight, cases
  FROM case_terms JOIN sizes USING (case_number) JOIN dfs USING (stem), totals WHERE df <= cap)"""
SCORES = """scores AS (SELECT question_id, case_number, round(sum(greatest(0, ln((cases + 1) / (df + 1))) * weight / 100), 6) AS score, count(*) AS hits FROM postings JOIN qstems USING (stem) WHERE ln((cases + 1) / (df + 1)) > 0 GROUP BY ALL),
routed AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, hits DESC, case_number) AS rank, case_number, score, hits FROM scores QUALIFY rank <= 8)"""
INDEX = f"{FILINGS}, {QTERMS}, {QSTEMS}, {TERMS}, {POSTINGS}, {SCORES}"
BITS = f"""codes AS (SELECT DISTINCT term, list_transform(string_split(term, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS l FROM words),
hashes AS (SELECT term, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), l), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h1,
  list_reduce(list_prepend(CAST(2654435769 AS BIGINT), l), lambda h, c: xor(h, (c + 2654435769 + h * 64 + h // 4) % 4294967296)) AS h2 FROM codes),
bits AS (SELECT term, h1, i, ((h1 + (i * (h2 | 1)) % 4294967296 + i * i) % 4294967296) % 16384 AS bit FROM hashes, (SELECT unnest([0, 1, 2, 3, 4]) AS i))"""


# Text

@query(f"SELECT doc_id, len({tok('text')}) AS n_tokens, len(list_distinct({tok('text')})) AS n_distinct, array_to_string(list_slice({tok('text')}, 1, 20), ' ') AS first_tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"), F.array_join(F.slice(words, 1, 20), " ").alias("first_tokens"))


@query(f"WITH {QTERMS} SELECT question_id, pos, term FROM qterms")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", F.posexplode("terms").alias("at", "term")).select("question_id", (F.col("at") + 1).cast("long").alias("pos"), "term")


@query(f"SELECT w AS word, {stem_sql('w')} AS stem, count(*) AS n FROM (SELECT unnest({tok('text')}) AS w FROM documents) GROUP BY ALL")
def stem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", text.stem(F.col("word")))


HTML = "trim(regexp_replace({0}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))".format("replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'gi'), '&#39;', ''''), '&#x27;', ''''), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')")


@query(f"SELECT page_id, {HTML} AS plain FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(f"WITH {FILINGS}, toks AS (SELECT DISTINCT filing_id, {stem_sql('t')} AS stem FROM (SELECT filing_id, unnest({tok('text')}) AS t FROM filings)) SELECT filing_id, count(*) AS n_stems, min(stem) AS first_stem, max(stem) AS last_stem FROM toks GROUP BY ALL")
def doc_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("filing_id", F.explode(text.stems(F.col("text"))).alias("stem")).groupBy("filing_id").agg(F.count("*").alias("n_stems"), F.min("stem").alias("first_stem"), F.max("stem").alias("last_stem"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "line")


@query("SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM benchmark")
def phrase_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.phrase_form(F.col("text")).alias("phrase"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\[\\]\\r\\n]+', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(left(t, 117)) || '...' ELSE t END AS title FROM c""")
def citation_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.citation_title(F.col("text")).alias("title"))


FOLLOW = "regexp_matches(text, '(?i)\\b(?:what about|how about|and (?:in|for)|same for|those|these|that case|it|they)\\b')"


@query(f"""SELECT conv_id, turn, regexp_matches(lower(text), '(system|developer)[ \\t\\n\\r\\f\\v]+(prompt|instructions?)') OR regexp_matches(lower(text), '(api|secret|access)[ \\t\\n\\r\\f\\v]*keys?') OR regexp_matches(lower(text), 'reveal.{{0,40}}(prompt|instructions?|keys?|secrets?)') OR regexp_matches(lower(text), 'ignore.{{0,40}}(previous|prior|system|developer).{{0,40}}(instructions?|prompt)') AS probe,
  {FOLLOW} AS refers_back, length(trim(text)) > 0 AND (len(regexp_extract_all(trim(text), '[^ \\t\\n\\r\\f\\v]+')) <= 4 OR length(trim(text)) <= 32) AS short, {' OR '.join(f"contains(lower(text), '{w}')" for w in text.TOPIC_WORDS)} AS topical FROM conversations""")
def message_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    topical = F.exists(F.array(*map(F.lit, text.TOPIC_WORDS)), lambda w: F.contains(F.lower(t), w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_probe(t).alias("probe"), t.rlike(text.FOLLOW_UP).alias("refers_back"), text.is_short_query(t).alias("short"), topical.alias("topical"))


# Hashes and filters

WORDS = f"words AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM benchmark)"


@query(f"WITH {WORDS}, {BITS} SELECT DISTINCT term, CAST(h1 % 4096 AS INT) AS shard FROM bits")
def term_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", hashing.term_shard(F.col("term")).alias("shard"))


@query(f"WITH {WORDS}, {BITS} SELECT term, CAST(i AS INT) AS i, CAST(bit AS INT) AS bit FROM bits")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return words.select("term", F.posexplode(hashing.filter_bits(F.col("term"))).alias("i", "bit"))


DOCBITS = f"{FILINGS}, doc_words AS (SELECT DISTINCT filing_id, unnest({tok('text')}) AS term FROM filings), words AS (SELECT DISTINCT term FROM doc_words), {BITS}, doc_bits AS (SELECT DISTINCT filing_id, bit FROM doc_words JOIN bits USING (term))"


@query(f"WITH {DOCBITS} SELECT filing_id, round(count(bit) / 16384.0, 6) AS fill FROM filings LEFT JOIN doc_bits USING (filing_id) GROUP BY ALL")
def fill_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_filters(filings(spark, sf_dir)).select("filing_id", F.round(scoring.fill_ratio(F.col("bits"), hashing.FILTER_BYTES), 6).alias("fill"))


@query(f"""WITH {FILINGS}, {QTERMS}, q AS (SELECT DISTINCT term FROM qterms), doc_words AS (SELECT DISTINCT filing_id, unnest({tok('text')}) AS term FROM filings), words AS (SELECT DISTINCT term FROM doc_words UNION SELECT term FROM q), {BITS},
doc_bits AS (SELECT DISTINCT filing_id, bit FROM doc_words JOIN bits USING (term)), need AS (SELECT term, count(DISTINCT bit) AS n FROM bits WHERE term IN (SELECT term FROM q) GROUP BY term),
hit AS (SELECT term, filing_id, count(*) AS n FROM (SELECT DISTINCT term, bit FROM bits WHERE term IN (SELECT term FROM q)) JOIN doc_bits USING (bit) GROUP BY ALL)
SELECT term, count(*) AS filings, min(filing_id) AS first_filing FROM hit JOIN need USING (term) WHERE hit.n = need.n GROUP BY term""")
def bloom_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = questions(spark, sf_dir).select(F.explode("terms").alias("term"))
    found = index.members(index.term_filters(filings(spark, sf_dir)), terms, hashing.FILTER_BYTES, "filing_id")
    return found.groupBy("term").agg(F.count("*").alias("filings"), F.min("filing_id").alias("first_filing"))


@query(f"""WITH {QTERMS}, j AS (SELECT question_id, string_agg(term, '|' ORDER BY pos) AS s FROM qterms GROUP BY ALL)
SELECT question_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS seed FROM j""")
def route_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).where(F.size("terms") > 0).select("question_id", hashing.route_seed(F.col("terms")).alias("seed"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))


# Index

@query(f"WITH {FILINGS}, {TERMS} SELECT * FROM case_terms")
def case_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.case_terms(filings(spark, sf_dir))


@query(f"WITH {FILINGS}, {TERMS} SELECT stem, df, df > cap AS capped, round(greatest(0, ln((cases + 1) / (df + 1))), 6) AS idf FROM dfs, totals")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir)
    terms = once(index.case_terms(rows), "case-terms")
    totals = F.broadcast(index.index_totals(terms, index.case_sizes(rows)))
    return index.document_frequency(terms).crossJoin(totals).select("stem", "df", (F.col("df") > F.col("cap")).alias("capped"), F.round(scoring.idf(F.col("df"), F.col("cases")), 6).alias("idf"))


@query(f"WITH {FILINGS}, {TERMS}, {POSTINGS} SELECT stem, case_number, df, weight FROM postings UNION ALL SELECT stem, NULL, df, NULL FROM dfs, totals WHERE df > cap")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(filings(spark, sf_dir)).select("stem", "case_number", "df", "weight")


# Routing

def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = once(questions(spark, sf_dir), "questions")
    return once(routing.route(asked, index.postings(filings(spark, sf_dir), routing.question_stems(asked))), "routed")


@query(f"WITH {INDEX} SELECT * FROM routed")
def route_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir)


@query(f"WITH {INDEX}, known AS (SELECT stem, df <= cap AS listed FROM dfs, totals) SELECT question_id, count(*) FILTER (listed) AS discriminating, count(*) FILTER (NOT listed) AS capped, count(*) FILTER (listed IS NULL) AS missing FROM qstems LEFT JOIN known USING (stem) GROUP BY ALL")
def term_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.term_report(questions(spark, sf_dir), index.postings(filings(spark, sf_dir)))


@query(f"WITH {INDEX} SELECT question_id, round(max(score), 2) AS top, round(max(score) - min(score), 2) AS separation FROM routed GROUP BY ALL")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.separation(_routed(spark, sf_dir))


@query(f"""WITH {INDEX}, carried AS (SELECT question_id, unnest([0, 1]) AS pos, unnest(['FC1000', 'FC1001']) AS case_number FROM (SELECT DISTINCT item_id AS question_id FROM benchmark WHERE item_id % 2 = 0)),
both_ AS (SELECT question_id, 0 AS kind, pos AS place, case_number FROM carried UNION ALL SELECT question_id, 1, rank, case_number FROM routed WHERE (question_id, case_number) NOT IN (SELECT question_id, case_number FROM carried))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY kind, place) AS rank, case_number, kind = 0 AS carried FROM both_ QUALIFY rank <= 5""")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    carried = asked.where("question_id % 2 = 0").select("question_id", F.posexplode(F.array(F.lit("FC1000"), F.lit("FC1001"))).alias("pos", "case_number"))
    return routing.carry_over(_routed(spark, sf_dir), carried)


FOLDED = f"""{FILINGS}, {QTERMS}, doc_words AS (SELECT DISTINCT case_number, filing_id % 4 AS band, unnest({tok('text')}) AS term FROM filings), words AS (SELECT DISTINCT term FROM doc_words UNION SELECT term FROM qterms), {BITS},
band_bits AS (SELECT DISTINCT case_number, band, bit % 2048 AS bit FROM doc_words JOIN bits USING (term)),
set_bits AS (SELECT case_number, count(*) AS set_bits FROM band_bits GROUP BY ALL)"""


@query(f"""WITH {FOLDED}, qb AS (SELECT DISTINCT term, bit % 2048 AS bit FROM bits WHERE term IN (SELECT term FROM qterms)), need AS (SELECT term, count(*) AS n FROM qb GROUP BY term),
hit AS (SELECT term, case_number, band, count(*) AS n FROM qb JOIN band_bits USING (bit) GROUP BY ALL), full_ AS (SELECT term, case_number, band FROM hit JOIN need USING (term) WHERE hit.n = need.n),
stats AS (SELECT case_number, count(DISTINCT filing_id) AS content, max(received_date) AS latest FROM filings GROUP BY ALL),
s AS (SELECT question_id, case_number, count(DISTINCT term) AS hits, count(*) AS score FROM qterms JOIN full_ USING (term) GROUP BY ALL),
lim AS (SELECT question_id, least(2, count(*)) AS least_ FROM qterms GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, score DESC, set_bits, content, coalesce(latest, '') DESC, case_number) AS rank, case_number, hits, score, CAST(set_bits AS BIGINT) AS set_bits
FROM s JOIN lim USING (question_id) JOIN set_bits USING (case_number) JOIN stats USING (case_number) WHERE hits >= least_ QUALIFY rank <= 8""")
def bloom_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_by_filters(questions(spark, sf_dir), index.router_entries(filings(spark, sf_dir)))


@query(f"WITH {FOLDED.replace(QTERMS + ', ', '').replace(' UNION SELECT term FROM qterms', '')}, s AS (SELECT case_number, count(DISTINCT filing_id) AS filings, max(received_date) AS latest FROM filings GROUP BY ALL) SELECT case_number, filings, latest, CAST(set_bits AS BIGINT) AS set_bits FROM s JOIN set_bits USING (case_number)")
def router_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.router_entries(filings(spark, sf_dir)).select("case_number", "filings", "latest", "set_bits").distinct()


# Ranking and evidence: each question is asked of its best case

def _searches(spark: SparkSession, sf_dir: str, cases: int = 1) -> DataFrame:
    routed = _routed(spark, sf_dir).where(F.col("rank") <= cases).select("question_id", "case_number", F.col("rank").alias("case_rank"))
    return routed.join(questions(spark, sf_dir), "question_id").withColumn("least", F.lit(1) if cases == 1 else F.least(F.lit(2), F.size("terms")))


def _search_tables(spark: SparkSession, sf_dir: str, cases: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Searches, the filings of their cases and those filings' filters."""
    searches = once(_searches(spark, sf_dir, cases), "searches")
    rows = evidence.asked_filings(searches, filings(spark, sf_dir))
    return searches, rows, once(index.term_filters(rows), "filters")


def _ranked(spark: SparkSession, sf_dir: str, cases: int = 1, adjusted: bool = False) -> DataFrame:
    return evidence.rank_documents(evidence.candidates(*_search_tables(spark, sf_dir, cases), bits=adjusted), AS_OF, adjusted)


CAND = f"""{INDEX}, doc_words AS (SELECT DISTINCT filing_id, unnest({tok('text')}) AS term FROM filings), words AS (SELECT DISTINCT term FROM doc_words UNION SELECT term FROM qterms), {BITS},
doc_bits AS (SELECT DISTINCT filing_id, bit FROM doc_words JOIN bits USING (term)),
qb AS (SELECT DISTINCT term, bit FROM bits WHERE term IN (SELECT term FROM qterms)), need AS (SELECT term, count(*) AS n FROM qb GROUP BY term),
hit AS (SELECT term, filing_id, count(*) AS n FROM qb JOIN doc_bits USING (bit) GROUP BY ALL), may AS (SELECT term, filing_id FROM hit JOIN need USING (term) WHERE hit.n = need.n),
fills AS (SELECT filing_id, count(*) / 16384.0 AS fill FROM doc_bits GROUP BY ALL),
qyears AS (SELECT DISTINCT item_id AS question_id, CAST(unnest(regexp_extract_all(text, '\\b(?:19|20)[0-9]{{2}}\\b')) AS INT) AS y FROM benchmark),
cand AS (SELECT r.question_id, r.case_number, f.filing_id, f.title, f.received_date, f.text, count(*) AS hits FROM routed r JOIN filings f USING (case_number) JOIN qterms q USING (question_id) JOIN may m ON m.filing_id = f.filing_id AND m.term = q.term WHERE r.rank = 1 GROUP BY ALL),
scored AS (SELECT *, round(hits + CASE WHEN EXISTS (SELECT 1 FROM qyears y WHERE y.question_id = cand.question_id AND y.y BETWEEN 1990 AND 2027 AND CAST(left(received_date, 4) AS INT) IN (y.y, y.y + 1)) THEN 0.9 ELSE 0 END + 0.6 * least(1, greatest(0, 1 - (2026 - CAST(left(received_date, 4) AS INT)) / 12)), 6) AS score FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, case_number ORDER BY score DESC, coalesce(received_date, '') DESC, filing_id) AS rank FROM scored)"""


@query(f"WITH {CAND} SELECT question_id, case_number, filing_id, hits, score, rank FROM ranked")
def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("question_id", "case_number", "filing_id", F.col("hits").cast("long"), "score", "rank")


@query(f"WITH {CAND}, nq AS (SELECT question_id, count(*) AS n FROM qterms GROUP BY ALL) SELECT question_id, filing_id, round(greatest(0, hits - n * pow(fill, 5)), 6) AS adjusted FROM cand JOIN fills USING (filing_id) JOIN nq USING (question_id)")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.candidates(*_search_tables(spark, sf_dir), bits=True)
    return found.select("question_id", "filing_id", F.round(scoring.adjusted_hits(F.col("hits"), F.size("terms"), scoring.fill_ratio(F.col("bits"), hashing.FILTER_BYTES)), 6).alias("adjusted"))


EXCERPTS = f"""{CAND}, read_ AS (SELECT * FROM ranked WHERE rank <= 20),
pages_ AS (SELECT question_id, case_number, filing_id, title, received_date, rank, generate_subscripts(string_split(text, chr(10)), 1) AS page_number, unnest(string_split(text, chr(10))) AS page FROM read_),
plain AS (SELECT *, {HTML.replace("coalesce(html, '')", "page")} AS plain FROM pages_),
spots AS (SELECT p.question_id, p.case_number, p.filing_id, p.title, p.received_date, p.rank, p.page_number, p.plain, instr(lower(p.plain), {stem_sql("q.term")}) AS spot FROM plain p JOIN qterms q USING (question_id)),
matched AS (SELECT question_id, case_number, filing_id, title, received_date, rank, page_number, plain, count(*) AS matched, min(spot) - 1 AS first_ FROM spots WHERE spot > 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id, case_number, filing_id ORDER BY matched DESC, page_number) AS depth FROM matched QUALIFY depth <= 2),
excerpts AS (SELECT *, CASE WHEN first_ > 500 THEN '…' ELSE '' END || substring(plain, CAST(greatest(0, first_ - 500) + 1 AS INT), CAST(least(length(plain), first_ + 1700) - greatest(0, first_ - 500) AS INT)) || CASE WHEN first_ + 1700 < length(plain) THEN '…' ELSE '' END AS excerpt,
  dense_rank() OVER (PARTITION BY question_id, case_number ORDER BY rank) AS grp FROM best),
slots AS (SELECT *, row_number() OVER (PARTITION BY question_id, case_number ORDER BY depth, rank) AS slot FROM excerpts WHERE grp <= 10 QUALIFY slot <= 12)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.search_case(*_search_tables(spark, sf_dir), AS_OF)


@query(f"WITH {EXCERPTS} SELECT question_id, case_number, filing_id, rank, depth, CAST(page_number AS INT) AS page_number, CAST(matched AS INT) AS matched, excerpt, slot FROM slots")
def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("question_id", "case_number", "filing_id", "rank", "depth", "page_number", "matched", "excerpt", "slot")


@query(f"WITH {EXCERPTS}, one AS (SELECT question_id, filing_id, min(slot) AS first_, arg_max(page_number, slot) AS page_number FROM slots GROUP BY ALL) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY first_) AS place, filing_id, CAST(page_number AS INT) AS page_number FROM one QUALIFY place <= 10")
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sources(_evidence(spark, sf_dir))


@query(f"""WITH {INDEX}, s AS (SELECT r.question_id, r.case_number, f.filing_id, f.received_date, count(*) AS hits FROM routed r JOIN filings f USING (case_number) JOIN qterms q USING (question_id) WHERE r.rank = 1 AND contains(lower(f.title) || ' ', q.term) GROUP BY ALL)
SELECT question_id, case_number, filing_id, row_number() OVER (PARTITION BY question_id, case_number ORDER BY sc DESC, coalesce(received_date, '') DESC, filing_id) AS rank, hits, sc AS score FROM (SELECT *, round(hits + 0.6 * least(1, greatest(0, 1 - (2026 - CAST(left(received_date, 4) AS INT)) / 12)), 6) AS sc FROM s) QUALIFY rank <= 8""")
def record_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _searches(spark, sf_dir).withColumn("years", F.array().cast("array<int>"))
    return evidence.record_rows(asked, filings(spark, sf_dir), AS_OF).select("question_id", "case_number", "filing_id", "rank", F.col("hits").cast("long"), "score")


# Rendering

@query(f"""WITH {EXCERPTS} SELECT question_id, string_agg('Internal evidence record ' || slot || ' (do not expose this number to the user)' || chr(10) || 'Required citation: [' || ct || ' — p. ' || page_number || '](' || u || '#page=' || page_number || ')' || chr(10) || 'Case: ' || case_number || chr(10) || 'Filing: ' || title || chr(10) || 'Date: ' || coalesce(received_date, 'unknown') || chr(10) || 'Page: ' || page_number || chr(10) || 'Official PDF page URL: ' || u || '#page=' || page_number || chr(10) || 'Excerpt: ' || left(excerpt, 2200), chr(10) || chr(10) ORDER BY slot) AS context
FROM (SELECT *, 'https://records.example.org/filing/' || filing_id AS u, trim(regexp_replace(regexp_replace(title, '[\\[\\]\\r\\n]+', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS ct FROM slots) GROUP BY ALL""")
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.source_context(_evidence(spark, sf_dir).withColumn("url", F.concat(F.lit("https://records.example.org/filing/"), F.col("filing_id").cast("string"))))


@query(f"""WITH {EXCERPTS} SELECT question_id, 'I found ' || count(*) || ' matching excerpt(s) in the indexed filings. AI synthesis is disabled, so these results are shown directly without any model/API charge.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('**' || slot || '. ' || case_number || ': ' || title || ' — page ' || page_number || '**' || chr(10) || chr(10) || left(excerpt, 700) || chr(10) || chr(10) || '[Open the official PDF at page ' || page_number || '](https://records.example.org/filing/' || filing_id || '#page=' || page_number || ')', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY slot) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[Search the complete official records](https://records.example.org/)' AS answer FROM slots GROUP BY ALL""")
def direct_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumn("url", F.concat(F.lit("https://records.example.org/filing/"), F.col("filing_id").cast("string")))
    return render.direct_answers(rows, "https://records.example.org/")


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Assistant' ELSE 'User' END || ': ' || left(text, 5000) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS transcript FROM t WHERE n <= 11 GROUP BY ALL""")
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.transcripts(turns(spark, sf_dir))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS filed FROM orders")
def long_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.long_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("filed"))


@query("SELECT conv_id, CASE WHEN length(f) > 30 THEN left(f, 30) || '...' ELSE f END AS title FROM (SELECT conv_id, arg_min(text, turn) AS f FROM conversations WHERE role = 'user' GROUP BY ALL)")
def session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.session_title(turns(spark, sf_dir))


@query("""SELECT conv_id, turn, question FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations WHERE role <> 'system') WHERE role = 'assistant'""")
def feedback_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.feedback_questions(turns(spark, sf_dir))


# Ingest

PARTS = "parts AS (SELECT doc_id AS filing_id, 'FC' || (1001 + doc_id % 96) AS case_number, 1 AS part, CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id END AS r2_key, source AS title FROM documents UNION ALL SELECT doc_id, 'FC' || (1001 + doc_id % 96), 2, CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id END, lang FROM documents WHERE doc_id % 5 <> 0)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    case = F.concat(F.lit("FC"), (1001 + F.col("doc_id") % 96).cast("string")).alias("case_number")
    key = lambda n, p: F.when(F.col("doc_id") % n == 0, F.concat(F.lit(p), F.col("doc_id").cast("string"))).alias("r2_key")
    one = docs.select(F.col("doc_id").alias("filing_id"), case, F.lit(1).alias("part"), key(2, "k"), F.col("source").alias("title"))
    return one.unionByName(docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("filing_id"), case, F.lit(2).alias("part"), key(3, "m"), F.col("lang").alias("title")))


@query(f"WITH {PARTS} SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY case_number, filing_id ORDER BY r2_key IS NOT NULL DESC, part) = 1")
def merge_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_manifests(_parts(spark, sf_dir))


@query(f"WITH {PARTS}, o AS (SELECT * FROM parts WHERE part = 1 AND filing_id % 4 <> 0), n AS (SELECT * FROM parts WHERE part = 2) SELECT filing_id, case_number, CASE WHEN o.part IS NOT NULL THEN o.part ELSE n.part END AS part, CASE WHEN o.part IS NOT NULL THEN o.r2_key ELSE n.r2_key END AS r2_key, CASE WHEN o.part IS NOT NULL THEN o.title ELSE n.title END AS title FROM o FULL JOIN n USING (filing_id, case_number)")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return ingest.merge_metadata(parts.where("part = 1 AND filing_id % 4 <> 0"), parts.where("part = 2"), ["filing_id", "case_number"])


@query(f"WITH {PARTS} SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY part DESC) = 1")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return ingest.upsert(parts.where("part = 1"), parts.where("part = 2"), ["filing_id"], "part")


@query(f"WITH {PARTS} SELECT DISTINCT filing_id FROM parts WHERE part = 1 AND filing_id NOT IN (SELECT filing_id FROM parts WHERE part = 2)")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return ingest.stale_keys(parts.where("part = 1"), parts.where("part = 2"), "filing_id")


@query("""WITH d AS (SELECT doc_id AS filing_id, 'FC' || (1001 + doc_id % 96) AS a, upper(lang) || '-' || (doc_id % 7) AS b FROM documents), l AS (SELECT filing_id, [a, b, a] AS l, a, b FROM d)
SELECT filing_id, 0 AS pos, a AS case_number FROM l UNION ALL SELECT filing_id, 1, b FROM l WHERE regexp_matches(b, '^[A-Z][A-Z0-9-]{2,30}$')""")
def related_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, other = F.concat(F.lit("FC"), (1001 + F.col("doc_id") % 96).cast("string")), F.concat("lang", F.lit("-"), (F.col("doc_id") % 7).cast("string"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing_id"), case.alias("case_number"), F.concat(other, F.lit(" - 12, "), case, F.lit(" - E - 3")).alias("docket"))
    docs = docs.withColumn("docket_number", F.replace("docket", F.lit(" - E"), F.lit(""))).drop("docket")
    return ingest.related_rows(docs)


@query("""WITH p AS (SELECT doc_id AS filing_id, 1 + doc_id % 2 AS attempts FROM documents WHERE doc_id % 3 = 0), u AS (SELECT doc_id AS filing_id FROM documents WHERE doc_id % 11 = 0), f AS (SELECT doc_id AS filing_id FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS filing_id FROM documents WHERE doc_id % 5 = 0), x AS (SELECT doc_id AS filing_id FROM documents WHERE doc_id % 7 = 0),
l AS (SELECT * FROM p WHERE filing_id NOT IN (SELECT filing_id FROM r UNION SELECT filing_id FROM x)), c AS (SELECT filing_id, CAST(sum(a) AS BIGINT) AS a FROM (SELECT filing_id, attempts AS a FROM l UNION ALL SELECT filing_id, 1 FROM f) GROUP BY ALL),
s AS (SELECT filing_id, CASE WHEN a >= 3 THEN 'unavailable' ELSE 'pending' END AS state, CASE WHEN a < 3 THEN a END AS attempts FROM c UNION SELECT filing_id, 'unavailable', NULL FROM (SELECT filing_id FROM u UNION SELECT filing_id FROM x))
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY state ORDER BY filing_id DESC) <= 5000""")
def failure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing_id"))
    every = lambda n: ids.where(F.col("filing_id") % n == 0)
    return ingest.failure_state(every(3).withColumn("attempts", 1 + F.col("filing_id") % 2), every(11), every(2), every(5), every(7))


@query("SELECT doc_id, CAST(doc_id % 4 AS INT) AS shard, 'term-index/v1/slots/a/shard-' || lpad(CAST(doc_id % 4096 AS VARCHAR), 4, '0') || '.json.gz' AS key, lang = 'en' AND source <> 'src1' AND n_chars > 0 AS public_pdf FROM documents")
def shard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = ingest.is_public_pdf(F.col("lang") != "en", F.col("source") == "src1", F.col("n_chars"), F.lit("A.PDF"))
    return table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(4)).cast("int").alias("shard"), hashing.shard_key("a", F.col("doc_id") % 4096).alias("key"), public.alias("public_pdf"))


@query("SELECT event_id, day, used, used <= 100000 AS allowed FROM (SELECT event_id, CAST(ts AS DATE) AS day, round(sum(coalesce(value, 0)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS used FROM events)")
def write_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.to_date("ts").alias("day"), F.coalesce("value", F.lit(0.0)).alias("bytes"))
    return ingest.running_budget(writes, 100_000).select(F.col("id").alias("event_id"), "day", "used", "allowed")


# Operations

@query("""WITH s AS (SELECT source, count(*) AS indexed, count(*) FILTER (doc_id % 50 = 0) AS failed, count(*) FILTER (doc_id % 40 = 1) AS unavailable FROM documents GROUP BY ALL), t AS (SELECT CAST(sum(indexed) AS BIGINT) AS indexed, CAST(sum(failed) AS BIGINT) AS retry_pending, CAST(sum(unavailable) AS BIGINT) AS unavailable FROM s)
SELECT true AS available, indexed, retry_pending, unavailable, greatest(0, 12000 - indexed - unavailable) AS unaccounted, least(100, round(indexed * 100 / 12000, 2)) AS searchable_percent, least(100, round((indexed + unavailable) * 100 / 12000, 2)) AS accounted_percent, retry_pending = 0 AND indexed + unavailable >= 12000 AS complete FROM t""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("string").alias("indexed"), F.collect_list(F.when(F.col("doc_id") % 50 == 0, F.col("doc_id"))).alias("failed"), F.collect_list(F.when(F.col("doc_id") % 40 == 1, F.col("doc_id"))).alias("unavailable"))
    return operations.coverage(shards, 12_000)


@query("SELECT user_id, last, last >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 36 HOUR AS fresh FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY ALL)")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", "last", scoring.is_fresh(F.col("last").cast("string"), "2024-01-30 00:00:00").alias("fresh"))


@query("""WITH m AS (SELECT date_trunc('minute', ts) AS window_start, user_id AS actor, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT window_start, sum(n) AS a FROM m GROUP BY ALL) SELECT window_start, actor, n, n > 2 AS over_actor, a > 4 AS over_all FROM m JOIN w USING (window_start)""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.rate_limits(table(spark, sf_dir, "events"), per_actor=2, overall=4)


@query("""WITH f AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS rating, CASE WHEN toxic = 1 THEN 'incorrect' WHEN doc_id % 3 = 0 THEN 'other' END AS reason FROM labels) SELECT rating, count(*) AS n, count(reason) AS with_reason FROM (SELECT rating, CASE WHEN rating = 'down' THEN reason END AS reason FROM f WHERE rating = 'up' OR reason IS NOT NULL) GROUP BY ALL""")
def feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("toxic") == 1, "incorrect").when(F.col("doc_id") % 3 == 0, "other").otherwise("none")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("request_id"), F.lit("2024-01-01").alias("updated_at"), F.lit(None).cast("string").alias("reported_at"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"), reason.alias("reason"), F.lit(" c ").alias("comment"), F.lit("q").alias("question"), F.lit("a").alias("answer_excerpt"))
    return operations.valid_feedback(rows).groupBy("rating").agg(F.count("*").alias("n"), F.count("reason").alias("with_reason"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') SELECT conv_id, bool_and(CASE WHEN n = 1 THEN length(trim(text)) BETWEEN 1 AND 5000 ELSE length(text) <= 5000 END) AND count(*) <= 11 AS valid FROM l GROUP BY ALL""")
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.valid_requests(turns(spark, sf_dir))


@query("""SELECT count(*) AS documents, count(text) AS with_text, (SELECT count(DISTINCT source) FROM documents) AS sources, sum(length(text)) AS chars FROM documents""")
def storage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.count_distinct("source").alias("sources"), F.sum(F.length("text").cast("long")).alias("chars"))


# Evaluation

def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question over its best case: candidates, ties, true matches, precision, overlap, evidence."""
    searches, rows, filters = _search_tables(spark, sf_dir)
    found = once(evidence.candidates(searches, rows, filters).select("question_id", "filing_id", "hits"), "candidates")
    plain = F.lower("text")
    true = rows.where("text IS NOT NULL").join(small(searches), "case_number").withColumn("true_terms", F.size(F.filter("terms", lambda t: F.contains(plain, t))))
    true = true.select("question_id", "filing_id", "received_date", "true_terms")
    slots = once(evidence.search_case(searches, rows, filters, AS_OF), "slots")
    got = slots.groupBy("question_id").agg(F.count("*").alias("evidence_rows"), F.collect_set("filing_id").alias("got"), F.array_distinct(F.transform(F.collect_list(2026 - text.document_year(F.col("received_date"))), lambda x: x)).alias("ages"))
    got = got.withColumn("distinct_filings", F.size("got").cast("long"))
    order = Window.partitionBy("question_id").orderBy(F.desc("true_terms"), F.desc(F.coalesce("received_date", F.lit(""))), "filing_id")
    oracle = true.where("true_terms > 0").withColumn("place", F.row_number().over(order)).join(got.select("question_id", "distinct_filings"), "question_id").where("place <= distinct_filings").groupBy("question_id").agg(F.collect_set("filing_id").alias("best"))
    tops = found.join(found.groupBy("question_id").agg(F.max("hits").alias("top")), "question_id").join(true.select("question_id", "filing_id", "true_terms"), ["question_id", "filing_id"])
    found = tops.groupBy("question_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("hits") == F.col("top")).alias("tied_at_top"), F.round(F.avg((F.col("true_terms") > 0).cast("int")), 3).alias("bloom_precision"))
    matches = true.groupBy("question_id").agg(F.count_if(F.col("true_terms") > 0).alias("true_matches"))
    out = found.join(matches, "question_id").join(got, "question_id", "left").join(oracle, "question_id", "left")
    return out.select("question_id", "candidates", "tied_at_top", "true_matches", "bloom_precision", F.coalesce("evidence_rows", F.lit(0)).alias("evidence_rows"), F.coalesce("distinct_filings", F.lit(0)).alias("distinct_filings"), F.round(F.size(F.array_intersect("got", "best")) / F.col("distinct_filings"), 3).alias("oracle_overlap"), "ages")


EVALUATION = f"""{EXCERPTS}, true_ AS (SELECT r.question_id, f.filing_id, f.received_date, count(*) FILTER (contains(lower(f.text), q.term)) AS tt FROM routed r JOIN filings f USING (case_number) JOIN qterms q USING (question_id) WHERE r.rank = 1 GROUP BY ALL),
got AS (SELECT question_id, count(*) AS evidence_rows, count(DISTINCT filing_id) AS distinct_filings FROM slots GROUP BY ALL),
orc AS (SELECT question_id, filing_id FROM (SELECT t.question_id, t.filing_id, distinct_filings, row_number() OVER (PARTITION BY t.question_id ORDER BY tt DESC, coalesce(received_date, '') DESC, t.filing_id) AS p FROM true_ t JOIN got USING (question_id) WHERE tt > 0) WHERE p <= distinct_filings),
ov AS (SELECT s.question_id, count(DISTINCT s.filing_id) AS n FROM slots s JOIN orc USING (question_id, filing_id) GROUP BY ALL),
tops AS (SELECT question_id, count(*) AS candidates, count(*) FILTER (hits = mh) AS tied_at_top, round(avg(CASE WHEN tt > 0 THEN 1 ELSE 0 END), 3) AS bloom_precision FROM (SELECT ranked.question_id, hits, tt, max(hits) OVER (PARTITION BY ranked.question_id) AS mh FROM ranked JOIN true_ USING (question_id, filing_id)) GROUP BY ALL),
ev AS (SELECT question_id, candidates, tied_at_top, (SELECT count(*) FROM true_ t WHERE t.question_id = tops.question_id AND tt > 0) AS true_matches, bloom_precision, coalesce(evidence_rows, 0) AS evidence_rows, coalesce(distinct_filings, 0) AS distinct_filings, round(coalesce(n, 0) / distinct_filings, 3) AS oracle_overlap FROM tops LEFT JOIN got USING (question_id) LEFT JOIN ov USING (question_id))"""


@query(f"WITH {EVALUATION} SELECT * FROM ev")
def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).drop("ages")


@query(f"WITH {EVALUATION} SELECT count(*) AS questions, count(*) FILTER (evidence_rows > 0) AS answered, round(avg(evidence_rows), 2) AS mean_evidence_rows, round(avg(distinct_filings), 2) AS mean_distinct_filings, round(avg(oracle_overlap), 3) AS mean_oracle_overlap FROM ev")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _evaluation(spark, sf_dir).withColumn("years_covered", F.lit(None).cast("boolean"))
    return operations.evaluation_summary(results, AS_OF).drop("year_coverage", "median_age")


# Records and links

@query(f"WITH {FILINGS} SELECT filing_id, received_date, title FROM filings WHERE case_number = 'FC1000' ORDER BY received_date DESC NULLS LAST, filing_id LIMIT 40 OFFSET 10")
def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir)
    return records.case_documents(rows.select("filing_id", "case_number"), rows.select("filing_id", "received_date", "title"), "FC1000", 40, 10)


@query("""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS p FROM pages) SELECT page_id, CASE WHEN h <> 'example.org' AND NOT ends_with(h, '.example.org') THEN 'external' WHEN contains(p, '/casenumber/') THEN 'case' WHEN contains(p, '/download') THEN 'download' WHEN contains(p, '/search') THEN 'search' ELSE 'site' END AS kind, kind <> 'external' AS verified FROM u""")
def verify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = filings(spark, sf_dir).select("case_number").distinct()
    return records.verify_links(table(spark, sf_dir, "pages").select("page_id", "url"), cases, "example.org").select("page_id", "kind", "verified")


@query(f"WITH {FILINGS}, p AS (SELECT filing_id, unnest(string_split(text, chr(10))) AS page FROM filings) SELECT filing_id, count(*) AS pages, count(*) FILTER (length(trim(page)) < 40) AS empty FROM p GROUP BY ALL")
def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ocr_candidates(evidence.pages_of(filings(spark, sf_dir)))


@query("SELECT doc_id AS filing_id, string_agg('<section data-page=\"' || pos || '\"><pre>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></section>', '' ORDER BY pos) AS html FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY ALL")
def document_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.document_html(evidence.pages_of(filings(spark, sf_dir)))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-joins with pruned columns and a pushed filter; the two small fixed tables are broadcast."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").where("o_orderstatus = 'F'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT user_id, day, writes, bytes FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS writes, round(sum(value), 2) AS bytes FROM events GROUP BY ALL)")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("writes"), F.round(F.sum("value"), 2).alias("bytes"))


# Text search and streams

@query(f"""WITH {FILINGS}, {QTERMS}, w AS (SELECT filing_id AS id, unnest({tok('text')}) AS term FROM filings), sz AS (SELECT filing_id AS id, len({tok('text')}) AS size FROM filings), tot AS (SELECT count(*) AS n, avg(size) AS mean FROM sz), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 6) AS score FROM qterms JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (id), tot GROUP BY ALL) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 8""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = filings(spark, sf_dir).select(F.col("filing_id").alias("id"), "case_number", "text")
    return search.bm25_search(questions(spark, sf_dir).withColumn("case", F.lit(None).cast("string")), chunks)


@query("SELECT date_trunc('minute', ts) AS window_start, user_id AS actor, count(*) AS n FROM events GROUP BY ALL")
def rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rate_counts(table(spark, sf_dir, "events"))
