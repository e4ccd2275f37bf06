"""Queries over the whole synthetic tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(spread(_table(spark, sf_dir, "documents"))).documents()


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(spread(_table(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(spread(_table(spark, sf_dir, "pages")))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import materialise

    return materialise(_table(spark, sf_dir, "documents"), _tokenizer())


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spread(_table(spark, sf_dir, "documents")), _tokenizer())


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(spread(_table(spark, sf_dir, "documents")), shingle_words=3, percent=85)


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import link_quotes

    return link_quotes(_table(spark, sf_dir, "conversations"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import DigestIndex

    index = DigestIndex(spark)
    decided = index.ingest(_table(spark, sf_dir, "documents"))
    index.drop()  # new and only of this call
    return decided


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(spread(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    every = (op1_source_mixing, op2_nearest_neighbours, op3_language_id, op4_html_extraction, op5_token_output, op6_best_fit_packing, op7_secret_scan, op8_minhash_near_dedup, op9_quotation_linking, op10_exact_dedup, op11_hard_negatives, op12_quality_classifier, op13_vector_codes)
    return {f.__name__: f for f in every}


def _codes_sql(rounds: int = 2) -> str:
    """Rounds of assignment and update over parts as rows; a vector's length is a multiple of 16."""
    steps = """,
            off{r} AS (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM part AS x JOIN book{r} AS b USING (part, place) GROUP BY ALL),
            near{r} AS (SELECT vec_id, part, min(d * 64 + entry) % 64 AS entry, min(d) AS d FROM off{r} GROUP BY ALL)"""
    update = """,
            book{n} AS (
                SELECT b.part, b.place, b.entry, coalesce(m.v, b.v) AS v
                FROM book{r} AS b LEFT JOIN (SELECT part, place, entry, floor(sum(v) / count(*))::BIGINT AS v FROM part JOIN near{r} USING (vec_id, part) GROUP BY ALL) AS m USING (part, place, entry))"""
    return (
        """
            WITH kept AS (
                SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
                FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
            part AS (
                SELECT vec_id, (i - 1) // (len(q) // 16) AS part, (i - 1) % (len(q) // 16) AS place, q[i] AS v
                FROM (SELECT vec_id, q, unnest(range(1, len(q) + 1)) AS i FROM kept)),
            book0 AS (
                SELECT part, place, entry, v
                FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64) USING (vec_id))"""
        + "".join(steps.format(r=r) + update.format(r=r, n=r + 1) for r in range(rounds))
        + steps.format(r=rounds)
        + f""",
            coded AS (SELECT vec_id, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
            SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
                (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
            FROM coded JOIN kept USING (vec_id)"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
            WINDOW w AS (PARTITION BY norm)""",
        "op11_hard_negatives": """
            WITH v AS (
                SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
                FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
            scored AS (
                SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
                FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
            positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
            SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER w AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
            FROM positive AS p JOIN scored AS n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
            WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
            QUALIFY rank <= 5""",
        "op13_vector_codes": _codes_sql(),
    }
