"""The quality model: its parts against plain versions, and held-out accuracy."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingscope.llm import quality
from filingscope.llm.quality import NAMES, Additive, measures, pair_tree, score_quality, tree

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = score_quality(docs, labels).join(labels, "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [r for r in found if r.held_out]
    assert len(out) > 60 and sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    good, bad = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    ask = lambda known: {r.doc_id: r.score for r in score_quality(docs, known).collect()}
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert ask(labels) == ask(turned)
    # ... and neither do other columns
    assert ask(labels) == {r.doc_id: r.score for r in score_quality(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "score": F.lit(1)}).repartition(7), labels.withColumn("toxic", F.lit(None))).collect()}


def plain(text):
    """Each measure by its definition."""
    raw, words = text.encode(), text.split()
    n, size = max(1, len(words)), len(raw)
    if not size:
        return [0.0] * len(NAMES)
    return [sum(b in kind for b in raw) / size for kind in quality.KINDS.values()] + [np.log1p(size), np.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 15 for w in words) / n, sum(len(w) < 4 for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, max([words.count(w) for w in set(words)], default=0) / n, sum(w.isupper() for w in words) / n, sum(not w.isalnum() for w in words) / n, len(set(zip(words, words[1:]))) / n]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aA bB.é\n|$9 -", max_size=120), st.integers(1, 30))
def test_measures_by_definition(text, cut):
    was, quality.CUT = quality.CUT, cut  # a long text's pieces change nothing
    try:
        assert np.allclose(measures(text), plain(text))
    finally:
        quality.CUT = was


def test_every_byte_has_a_kind():
    assert (quality._KIND.sum(axis=1) == 1).all()


def test_trees_against_every_cut():
    rng = np.random.default_rng(4)
    for _ in range(30):
        grad, weight = rng.normal(size=9), rng.uniform(1, 3, size=9)
        gain = lambda g, w: g.sum() ** 2 / (w.sum() + quality.PULL)
        best = max(range(1, 9), key=lambda m: gain(grad[:m], weight[:m]) + gain(grad[m:], weight[m:]))
        step = tree(grad, weight, 2)
        if len(set(step)) == 2:
            assert np.flatnonzero(np.diff(step)).tolist() == [best - 1]
    cross = np.where((np.arange(6)[:, None] < 3) == (np.arange(6) < 3), 5.0, -5.0)  # no single measure tells them apart
    step, value = pair_tree(cross, np.ones((6, 6)))
    assert value > 100 and (np.sign(step) == np.sign(cross)).all() and not tree(cross.sum(axis=0), np.ones(6) * 6).any()


def test_pairs_learn_what_tables_cannot():
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = Additive(x, y)
    assert model.pairs[0] == (0, 2) and ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text"), (1, "good text"), (None, "x"), (2, None), (3, ""), (4, "wort " * 400_000), (5, "x" * 3_000_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 1)], "doc_id long, quality int")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    none = score_quality(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert score_quality(docs.limit(0), labels).collect() == []
    one = score_quality(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")).collect()
    assert all(r.score > 0.5 for r in one)
