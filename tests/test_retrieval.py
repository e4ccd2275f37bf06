"""Posting blocks, bit slices and phrases against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingscope.functions import hashing
from filingscope.operators import fielded, index, routing, search
from filingscope.plans.corpus import filings
from tests.conftest import DATA


@pytest.mark.parametrize(("seed", "rows"), [(0, 1), (1, 3), (2, 16), (3, 500)])
def test_blocks_find_the_same_cases(spark, seed, rows):
    rnd = random.Random(seed)
    postings = []
    for s in range(12):
        cases = rnd.sample(range(400), rnd.choice([3, 40, 200]))
        postings += [(f"s{s}", f"FC{c:03d}", len(cases), min(220, int(4 / rnd.random()) + 1), 400) for c in cases]
    postings.append(("capped", None, 390, None, 400))
    table = spark.createDataFrame(postings, "stem string, case_number string, df long, weight int, cases long")
    asked = spark.createDataFrame([(q, [f"s{rnd.randrange(13)}" for _ in range(rnd.randrange(1, 5))] + ["capped"]) for q in range(20)], "question_id long, terms array<string>")
    blocks = routing.posting_blocks(table, rows).cache()
    assert sorted(map(tuple, routing.route_by_blocks(asked, blocks).collect())) == sorted(map(tuple, routing.route(asked, table).collect()))
    assert blocks.agg(F.sum("n")).first()[0] == len(postings) - 1 and blocks.where(F.size("entries") > rows).isEmpty()
    needed = routing.needed_blocks(asked, blocks).agg(F.sum("n"), F.sum(F.when(F.col("needed"), F.col("n")))).first()
    assert needed[1] <= needed[0] and (rows != 16 or needed[1] < 0.9 * needed[0])


def test_blocks_of_nothing(spark):
    table = spark.createDataFrame([("a", None, 9, None, 9)], "stem string, case_number string, df long, weight int, cases long")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "question_id long, terms array<string>")
    assert routing.route_by_blocks(asked, routing.posting_blocks(table)).collect() == []


def test_bit_slices_hold_what_filters_hold(spark, monkeypatch):
    monkeypatch.setattr(index, "SLICE_ROWS", 16)
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.choice([0, 3, 30])))) for i in range(150)]
    filters = index.term_filters(spark.createDataFrame(rows, "filing_id long, text string"), 256).cache()
    terms = [f"w{i}" for i in range(0, 60, 3)] + ["W9", "never"]
    bits = {r.filing_id: np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little") for r in filters.collect()}
    spots = {r.t: list(r.s) for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", hashing.filter_bits(F.lower("t"), 256).alias("s")).collect()}
    want = sorted((i, t) for i, own in bits.items() for t in terms if own.any() and all(own[s] for s in spots[t]))
    asked = spark.createDataFrame([(t,) for t in [*terms, *terms]], "term string")
    found = index.members(filters, asked, 256, "filing_id")
    assert sorted(map(tuple, found.select("filing_id", "term").collect())) == want and want
    whole = index.bit_slices(filters, 256, "filing_id")  # an index of all bits
    assert sorted(map(tuple, index.members_of(whole, asked, 256).select("filing_id", "term").collect())) == want
    assert index.members(filters.limit(0), asked, 256, "filing_id").isEmpty()


def test_phrases_are_adjacent_words(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["a", "bb", "c-d", "pepco's", "É", "a."]) for _ in range(rnd.choice([0, 5, 60]))), "FC1" if i % 2 else "FC2") for i in range(40)] + [(99, None, "FC1")]
    chunks = spark.createDataFrame(rows, "id long, text string, case_number string")
    terms = ["a-bb", "bb", "c-d", "Pepco's", "a-a", "a-bb-c", "é", "--", "zz-a", "a-a-a"]
    cut = lambda x: "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()
    want = {}
    for i, text, _ in rows:
        words = cut(text)
        for t in terms:
            p = cut(t)
            n = sum(words[k : k + len(p)] == p for k in range(len(words) - len(p) + 1)) if p else 0
            if n:
                want[t, i] = n
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    postings = search.positional_postings(chunks).cache()
    assert {(r.term, r.id): r.tf for r in search.phrase_counts(asked, postings).collect()} == want
    decoded = {(r.word, r.id): list(r.at) for r in postings.select("word", "id", search.places(F.col("gaps")).alias("at")).collect()}
    assert decoded == {(w, i): [k for k, x in enumerate(cut(t)) if x == w] for i, t, _ in rows for w in set(cut(t))}
    best = search.phrase_search(spark.createDataFrame([(1, ["a-bb"], None), (2, ["a-bb"], "FC1"), (3, ["--"], None)], "question_id long, terms array<string>, case string"), chunks).collect()
    assert {r.id for r in best if r.question_id == 2} <= {i for i, _, c in rows if c == "FC1"} and {r.question_id for r in best} == {1, 2}


@pytest.mark.parametrize("constant", [10_000, 3])
def test_an_index_of_asked_stems_has_the_same_numbers(spark, monkeypatch, constant):
    monkeypatch.setattr(index, "ASKED_STEMS", constant)
    rnd = random.Random(7)
    rows = [(i, f"FC{rnd.randrange(60)}", "t", None, rnd.choice([None, "", "x", " ".join(f"word{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 25))) + " common"])) for i in range(600)]
    filings = spark.createDataFrame(rows, "filing_id long, case_number string, title string, received_date string, text string")
    asked = spark.createDataFrame([(s,) for s in ("word1", "word2", "common", "never", "word1", "word9", "word11")], "stem string")
    got = index.postings(filings, asked)
    want = index.postings(filings).join(asked.distinct(), "stem", "left_semi")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.where("case_number IS NULL").count() == 1
    assert index.postings(filings, asked.limit(0)).isEmpty()


def test_phrases_that_share_a_word_cost_no_row_each(spark):
    text = "a " * 20_000
    chunks = spark.createDataFrame([(i, text + f"w{i}") for i in range(4)], "id long, text string")
    terms = spark.createDataFrame([(f"a-w{i}",) for i in range(4_000)], "term string")
    began = time.time()
    found = {(r.term, r.id): r.tf for r in search.phrase_counts(terms, search.positional_postings(chunks)).collect()}
    assert found == {(f"a-w{i}", i): 1 for i in range(4)} and time.time() - began < 40
    assert search.phrase_counts(terms.limit(0), search.positional_postings(chunks)).isEmpty()


def test_texts_are_not_moved_for_dates_that_nobody_asks_for(spark):
    plan = lambda *columns: filings(spark, DATA).select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("filing_id", "case_number", "title", "text") and "Join" in plan("filing_id", "received_date")
    dated = filings(spark, DATA).where("received_date IS NOT NULL").count()
    assert dated == spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/orders.parquet"), F.expr("doc_id = o_orderkey")).count() > 0


def _spelt(rnd, n):
    return "".join(rnd.choice("ab") for _ in range(n))


def test_asked_words_are_found_by_equality_opening_and_edits():
    rnd = random.Random(8)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    asked = sorted({_spelt(rnd, n) for n in (2, 4, 5, 6, 8, 12, 13, 15, 20, 21, 22, 39) for _ in range(4)})
    words = [_spelt(rnd, rnd.randrange(2, 24)) for _ in range(300)]
    for t in asked:  # some that are near
        for _ in range(12):
            w = list(t)
            for _ in range(rnd.randrange(5)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randrange(2)] = _spelt(rnd, rnd.randrange(2))
                w = w or ["a"]
            words.append("".join(w))
    told = fielded.Asked([(1, asked, [])], {}, (0.375, 0.45, 0.12), (1.2, 0.75))
    near = 0
    for w in words:
        want = {}
        for t in asked:
            d, most = edits(t, w), round(len(t) * 0.12)
            if w == t or w.startswith(t):
                want[t] = 1.0 if w == t else 0.375 * len(t) / len(w)
            elif most and d <= most:
                want[t], near = 0.45 * len(t) / (len(t) + d), near + 1
        assert {t: told.like(w)[i] for t, i in told.terms.items() if i in told.like(w)} == want
    assert near > 300


def _searched(rnd, chunks, words):
    vocabulary = [f"{rnd.choice(['rate', 'storm', 'grid', 'meter'])}{i}" for i in range(words)]
    texts = [(i, f"FC{1000 + i % 7}" if i % 9 else None, f"title {rnd.choice(vocabulary)}", " ".join(vocabulary[int(words * rnd.random() ** 3)] for _ in range(rnd.choice([0, 4, 30])))) for i in range(chunks)]
    texts += [(chunks + i, "FC1001", *texts[3][2:]) for i in range(60)]  # copies: more than are kept
    asked = [(i, " ".join(rnd.choice([x, x[:-1], "rate", "grid"]) for x in rnd.sample(vocabulary, 4)) + (" in FC 1001" if i % 4 == 0 else "")) for i in range(17)] + [(98, None), (99, "never heard of")]
    return asked, texts


@pytest.mark.parametrize(("common", "questions"), [(0, 2_000), (40, 5), (4_000_000, 5)])
def test_a_fielded_search_of_parts_finds_the_same(spark, monkeypatch, common, questions):
    asked, texts = _searched(random.Random(9), 400, 300)
    asked, chunks = spark.createDataFrame(asked, "question_id long, message string"), spark.createDataFrame(texts, "id long, case_number string, filename string, text string").repartition(5)
    want = sorted(map(tuple, search.fielded_search(asked, chunks).collect()))
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(search, "QUESTIONS", questions)
    assert sorted(map(tuple, search.fielded_search(asked, chunks).collect())) == want and len(want) > 80


def test_a_fielded_search_shuffles_no_postings(spark):
    rnd = random.Random(10)
    words = [f"rate{i}" for i in range(1_500)]
    rows = [(i, "FC1", "t", " ".join(rnd.choice(words) for _ in range(1_500))) for i in range(300)]
    chunks = spark.createDataFrame(rows, "id long, case_number string, filename string, text string")
    asked = spark.createDataFrame([(i, f"rate {rnd.choice(words)}") for i in range(10)], "question_id long, message string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert len(search.fielded_search(asked, chunks).collect()) == 60
    time.sleep(1)
    assert written() - before < 1 << 20  # 300,000 postings take some megabytes
