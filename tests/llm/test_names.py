"""No column of the user's meets one of an operator's own: tables with every internal name go through unchanged."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filingscope.llm.exact_dedup import kept_documents
from filingscope.llm.mixing import Mix

DATA = "/root/testdata/sf0.001"
NAMES = "_digest _pair _row _h _id _mark _cuts _source _key _0 digest pair row id key keep_id group group_size kept size mark cuts start first n times block no words chars range position word item bin fill size_ a b".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = rows.withColumns({c: F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")) for c in NAMES})
    return rows.unionByName(rows.where("doc_id % 10 = 0")).unionByName(rows.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))


def unchanged(out):
    wrong = [F.count_if(~F.col(f"`{c}`").eqNullSafe(F.concat(F.lit(c + ":"), F.col("doc_id").cast("string"))) & F.col("doc_id").isNotNull()).alias(c) for c in NAMES]
    assert not any(out.agg(*wrong).first()) and out.count() > 0


def test_exact_dedup(docs):
    out = kept_documents(docs)
    assert out.columns == docs.columns
    unchanged(out)


def test_mixing(docs):
    out = Mix(docs).fragments(docs, chars_col="n_chars")
    assert out.schema == docs.schema and out.where("n_chars != length(text)").isEmpty()
    unchanged(out)


def test_stages(spark, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, DATA)
        assert rows.columns == docs.columns, name
        unchanged(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, DATA).count() > 0


def test_nothing_is_left_behind(spark):
    from filingscope.llm import queries, workspace

    tables = len(spark.catalog.listTables())
    out = queries.op10_exact_dedup(spark, DATA).collect()
    assert len(spark.catalog.listTables()) == tables and out
    made = list(workspace.MADE)
    workspace.clear(spark)
    folder = workspace.shared_root(spark).removeprefix("file://")
    import os

    assert made and not workspace.MADE and not any(os.path.exists(m.removeprefix("file://")) for m in made) and os.path.exists(folder)
