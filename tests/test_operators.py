"""Index, filters, ingest and operations on small handmade inputs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from filingscope.functions import hashing, text
from filingscope.operators import evidence, index, ingest, operations, records, render, routing
from filingscope.sources import filings as sources
from filingscope.sources import generations, manifests
from filingscope.streaming import jobs

FILINGS = "filing_id long, case_number string, title string, received_date string, text string"


def corpus(spark, rows):
    return spark.createDataFrame(rows, FILINGS)


def test_more_filings_on_a_topic_weigh_more_and_size_is_normalised(spark):
    rows = [(i, "FC1176", "t", "2024-01-01", "storm damage") for i in range(3)] + [(9, "FC1184", "t", "2024-01-01", "storm")]
    weights = {r.case_number: r.weight for r in index.postings(corpus(spark, rows)).where("stem = 'storm'").collect()}
    assert weights["FC1176"] > weights["FC1184"]
    rows = [(i, "SMALL1", "t", None, "storm") for i in range(6)] + [(100 + i, "LARGE1", "t", None, "storm" if i < 8 else "other") for i in range(200)]
    weights = {r.case_number: r.weight for r in index.postings(corpus(spark, rows)).where("stem = 'storm'").collect()}
    assert weights["SMALL1"] > weights["LARGE1"]


def test_stems_above_the_cap_keep_their_frequency_only(spark):
    rows = [(i, f"FC{1000 + i}", "t", None, "commission uncollectible" if i < 3 else "commission") for i in range(301)]
    found = {(r.stem, r.case_number) for r in index.postings(corpus(spark, rows)).collect()}
    assert ("commiss", None) in found and ("uncollectible", "FC1000") in found and ("commiss", "FC1000") not in found


def test_filters_have_no_false_negatives_and_fold(spark):
    rows = corpus(spark, [(1, "FC1", "t", None, "storm damage report and pepco's reply"), (2, "FC1", "t", None, ""), (3, "FC1", "t", None, None)])
    filters = index.term_filters(rows)
    words = rows.where("filing_id = 1").select("filing_id", F.explode(text.tokens(F.col("text"))).alias("w"))
    assert words.join(filters, "filing_id").where(~index.may_contain(F.col("w"), F.col("bits"))).count() == 0
    assert filters.where("filing_id > 1").select(F.max(F.bitmap_count("bits"))).first()[0] == 0
    entry = index.router_entries(corpus(spark, [(i, "FC9", "t", "2026-01-01", "storm") for i in (4, 5, 6)]))
    hit = entry.where(index.may_contain(F.lit("storm"), F.col("bits"), hashing.ROUTER_BYTES))
    assert hit.count() == 3 and entry.select("filings", "content_filings", "latest").first() == (3, 3, "2026-01-01")


def test_diversity(spark):
    rows = spark.createDataFrame([(1, "A", f, d, f, 1) for f in range(1, 9) for d in (1, 2)], "question_id int, case_number string, rank int, depth int, filing_id int, page_number int")
    slots = evidence.diverse_documents(rows).orderBy("slot").collect()
    assert len(slots) == 12 and [r.depth for r in slots[:8]] == [1] * 8 and [r.filing_id for r in slots[8:]] == [1, 2, 3, 4]
    groups = spark.createDataFrame([(1, c, f"C{c}", 10 * c + s, 1, s) for c in range(1, 6) for s in range(1, 6)], "question_id int, case_rank int, case_number string, filing_id int, page_number int, slot int")
    kept = evidence.diverse_cases(groups).collect()
    assert len(kept) == 12 and {r.case_number for r in kept} == {"C1", "C2", "C3", "C4"}


def test_merges(spark):
    part = "case_number string, filing_id long, part int, r2_key string"
    rows = ingest.merge_manifests(spark.createDataFrame([("A", 1, 1, None), ("A", 1, 2, "k"), ("A", 2, 1, None)], part)).orderBy("filing_id").collect()
    assert [(r.filing_id, r.r2_key) for r in rows] == [(1, "k"), (2, None)]
    old, new = spark.createDataFrame([(1, None)], "id int, title string"), spark.createDataFrame([(1, "x"), (2, "y")], "id int, title string")
    assert {r.id: r.title for r in ingest.merge_metadata(old, new, ["id"]).collect()} == {1: None, 2: "y"}


def test_third_failure_makes_a_filing_unavailable(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "filing_id long")
    pending = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "filing_id long, attempts int")
    out = {(r.filing_id, r.state): r.attempts for r in ingest.failure_state(pending, ids(9), ids(1, 2, 4), ids(3), ids(7)).collect()}
    assert out == {(1, "unavailable"): None, (2, "pending"): 2, (4, "pending"): 1, (7, "unavailable"): None, (9, "unavailable"): None}


def test_guards():
    with pytest.raises(ValueError):
        ingest.shrink_guard(5, 40)
    ingest.shrink_guard(5, 40, allow=True)
    ingest.shrink_guard(5, None)


def test_public_pdf(spark):
    raw = spark.createDataFrame([(1, "FC1 - 1", "A.PDF", None, 5, "<b>x</b>", "2024-01-01", None, False), (2, "FC1 - 1", "a.doc", None, 5, "", None, False, False), (3, "FC1 - 1", "a.pdf", "n.pdf", 5, "", None, False, True)], sources.RECORD)
    keep = raw.where(ingest.is_public_pdf(F.col("isConfidential"), F.col("isArchived"), F.col("attachmentId"), F.col("attachment")))
    assert [r.filingId for r in keep.collect()] == [1]
    assert ingest.metadata_rows(raw.where("filingId = 1")).first().title == "x"


def test_health_and_monitor(spark):
    parts = spark.createDataFrame([("metadata", "2026-01-01 00:00:00"), ("case-router", None), ("term-index", "2025-12-25 00:00:00")], "part string, updated_at string")
    assert operations.health(parts, "2026-01-01 12:00:00").first() == ("degraded", "case-router-unavailable")
    seen = spark.createDataFrame([(1, "200", json.dumps({"status": "ok"})), (2, "200", json.dumps({"status": "ok", "healthSource": "last-known-good", "liveIssues": ["a\nb"]})), (3, "503", "oops"), (4, "500", json.dumps({"status": "ok"}))], "id int, http_code string, payload string")
    assert {r.id: (r.status, r.issues) for r in operations.monitor(seen).collect()} == {1: ("ok", "none"), 2: ("degraded", "a b"), 3: ("unreachable", "HTTP 503"), 4: ("unreachable", "HTTP 500")}


def test_missing_shard_makes_coverage_unknown(spark):
    shards = spark.createDataFrame([("5", [1], [2]), (None, None, None)], "indexed string, failed array<int>, unavailable array<int>")
    row = operations.coverage(shards, 10).first()
    assert row.searchable_percent is None and not row.complete and row.indexed == 5


def test_recent_cases_come_from_the_last_answer_with_any(spark):
    talk = spark.createDataFrame([(1, 0, "model", "FC1176"), (1, 1, "model", "ET2019-01 and FC1130, FC1130"), (1, 2, "model", "no case"), (1, 3, "user", "FC9999")], "conv_id int, turn int, role string, content string")
    assert [r.case_number for r in operations.recent_cases(talk).orderBy("pos").collect()] == ["ET2019-01", "FC1130"]


def test_feedback(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", None, "down", None, "c", "q", "x"), ("b", "2024-01-02", None, "down", "incorrect", " c ", "q", "x"), ("c", "2024-01-03", None, "up", "other", "c", "q", "x")], "request_id string, updated_at string, reported_at string, rating string, reason string, comment string, question string, answer_excerpt string")
    good = operations.valid_feedback(rows)
    assert {r.request_id: (r.reason, r.comment) for r in good.collect()} == {"b": ("incorrect", "c"), "c": (None, None)}
    digest = render.feedback_digest(good).first()
    assert (digest.up, digest.down) == (1, 1) and "### 1. Incorrect or misleading" in digest.digest and "    q" in digest.digest
    acked = operations.acknowledge(good, spark.createDataFrame([("b",)], "request_id string"), "now")
    assert operations.feedback_report(acked).count() == 1


def test_sse_round_trip(spark):
    frame = render.event_frame(F.lit("delta"), F.to_json(F.struct(F.lit("hi").alias("delta"))))
    got = spark.range(1).select(render.parse_events(F.concat(frame, frame)).alias("e")).first().e
    assert [(x.event, x.data.delta) for x in got] == [("delta", "hi")] * 2


def test_published_index_swaps_slots_and_prunes(spark, tmp_path):
    rows = corpus(spark, [(i, f"FC{i}", "t", None, f"storm word{i}") for i in range(10)])
    path = str(tmp_path / "index")
    first = generations.publish_index(index.postings(rows), path)
    second = generations.publish_index(index.postings(rows), path)
    assert (first["slot"], second["slot"]) == ("a", "b") and generations.read_postings(spark, path, ["storm"]).select("case_number").distinct().count() == 10
    with pytest.raises(ValueError):
        generations.publish_index(index.postings(rows.limit(2)), path)
    assert generations.current_generation(spark, path)["generation"] == second["generation"]


def test_stored_files(spark, tmp_path):
    folder = tmp_path / "manifests" / "FC1176"
    folder.mkdir(parents=True)
    (folder / "part-0-of-4.json").write_text(json.dumps({"version": 2, "caseNumber": "FC1176", "documents": [{"filing_id": 1, "title": "t"}]}))
    (folder / "part-1-of-4.json").write_text(json.dumps({"version": 2, "caseNumber": "OTHER", "documents": [{"filing_id": 2}]}))
    assert [(r.case_number, r.filing_id) for r in manifests.read_manifests(spark, str(tmp_path / "manifests")).collect()] == [("FC1176", 1)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "77.html").write_text("<section data-page='2'><pre>a &amp;\n b</pre></section>")
    assert sources.read_pages(spark, str(tmp_path / "pages")).collect() == [(77, 2, "a & b")]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"<html>")
    assert {r.path[-5:]: r.is_pdf for r in sources.read_pdfs(spark, str(tmp_path / "pdf")).collect()} == {"a.pdf": True, "b.pdf": False}


def test_news(spark):
    block = '<div class="blog-list style-1"><h2><a href="/n/1">T &amp; t</a></h2><i class="fa-calendar-o"></i> May 1<p>Sum <b>x</b></p></div><div class="blog-list style-1"><h2><a href="https://evil.org/">E</a></h2></div>'
    rows = sources.parse_news(spark.createDataFrame([(1, block)], "id int, html string"), "html", "example.org", '<div class="blog-list style-1">').collect()
    assert [tuple(r) for r in rows] == [(1, 1, "T & t", "May 1", "Sum x", "https://example.org/n/1")]


def test_stream_ingest_resumes_without_doubling(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"id": 1, "v": 1}\n{"id": 2, "v": 1}')
    run = lambda: jobs.ingest(spark, str(source), "id long, v long", str(tmp_path / "out"), str(tmp_path / "check"), ["id"], "v", 1).awaitTermination()
    run()
    run()
    (source / "2.json").write_text('{"id": 2, "v": 5}\n{"id": 3, "v": 1}')
    run()
    read = lambda: sorted(tuple(r) for r in jobs.read_ingested(spark, str(tmp_path / "out"), ["id"], "v").collect())
    assert read() == [(1, 1), (2, 5), (3, 1)]
    jobs.compact(spark, str(tmp_path / "out"), ["id"], "v")
    assert read() == [(1, 1), (2, 5), (3, 1)] and len(list((tmp_path / "out").glob("delta=*"))) == 0
    (source / "3.json").write_text('{"id": 3, "v": 7}')
    run()
    assert read() == [(1, 1), (2, 5), (3, 7)]


def test_a_counting_stream_equals_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    counts = jobs.rate_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").exceptAll(jobs.rate_counts(events)).isEmpty()


def test_word_order_and_carried_cases(spark):
    asked = spark.createDataFrame([(1, ["storm", "damage"])], "question_id int, terms array<string>")
    posts = index.postings(corpus(spark, [(i, f"FC{i % 3}00", "t", None, "storm damage" if i % 3 else "storm") for i in range(9)] + [(50 + i, f"X{i}00", "t", None, "other words") for i in range(40)]))
    assert routing.word_order_stability(asked, posts).first().stable
    carried = spark.createDataFrame([(1, 0, "FC100")], "question_id int, pos int, case_number string")
    assert [r.case_number for r in routing.carry_over(routing.route(asked, posts), carried).orderBy("rank").collect()][:1] == ["FC100"]


def test_titles_come_from_whole_texts(spark, tmp_path):
    from filingscope.plans import queries

    spark.createDataFrame([(1, "Notice" + " \n" * 150 + "of a " + "hearing " * 20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    title = queries.citation_title(spark, str(tmp_path)).first()["title"]
    assert title == ("Notice of a " + "hearing " * 20)[:117].rstrip() + "..."


def test_positions_of_many_words_equal_the_expressions(spark):
    import numpy as np

    words = ["storm", "a1", "pepco's", "x" * 40, "9-9"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.filter_bits(F.col("w")).alias("bits")).collect()
    assert {r.w: r.bits for r in rows} == dict(zip(words, hashing.filter_positions(np.array([w.encode() for w in words], dtype="S40")).tolist(), strict=True))


def test_members_need_all_positions(spark):
    rows = corpus(spark, [(1, "FC1", "t", None, "storm damage"), (2, "FC1", "t", None, "calm"), (3, "FC1", "t", None, None)])
    terms = spark.createDataFrame([("Storm",), ("calm",), ("storm",), ("absent",), ("calm",)], "term string")
    found = index.members(index.term_filters(rows), terms, hashing.FILTER_BYTES, "filing_id")
    assert sorted(map(tuple, found.collect())) == [(1, "Storm"), (1, "storm"), (2, "calm")]
    assert index.members(index.term_filters(rows.limit(0)), terms, hashing.FILTER_BYTES, "filing_id").count() == 0


def test_the_dispatcher_takes_the_narrowest_search_that_answers(spark):
    from filingscope.operators import dispatch, routing

    rows = corpus(spark, [(i, f"FC{1000 + i % 3}", "t", f"2025-01-0{1 + i % 9}", f"storm damage report {i}" if i % 3 else "meter rates review") for i in range(9)])
    asked = spark.createDataFrame(
        [(1, "storm damage in FC 1001", ["storm", "damage"], 1), (2, "meter rates", ["meter", "rates"], 1), (3, "storm damage", ["storm", "damage"], 1), (4, "FC 1002", [], 1), (5, "absent words", ["absent", "words"], 1), (6, "review in FC 1001", ["review"], 1), (7, "it", ["it"], 2)],
        "question_id long, message string, terms array<string>, conv_id long",
    ).withColumn("years", F.array().cast("array<int>"))
    postings = index.postings(rows)
    whole = routing.route(asked, postings).where("question_id = 2")
    exhaustive = asked.select("question_id", (F.col("question_id") != 3).alias("available")).join(whole, "question_id", "left")
    chunks = rows.select(F.col("filing_id").alias("id"), "filing_id", "case_number", F.lit(1).alias("page_number"), "received_date", "text")
    entries = index.router_entries(rows).withColumn("part", (F.pmod(hashing.route_seed(F.array(F.lit("storm"), F.lit("damage"))), F.lit(16))).cast("int"))
    turns = spark.createDataFrame([(2, 0, "user", "?"), (2, 1, "model", "See FC1000 and FC1002.")], "conv_id long, turn int, role string, content string")
    carried = dispatch.carried_cases(asked, turns)
    assert sorted(map(tuple, carried.collect())) == [(7, 0, "FC1000"), (7, 1, "FC1002")]
    found = {}
    for r in dispatch.search_dockets(asked, rows, index.term_filters(rows), chunks, exhaustive, entries, "2026-01-01", carried).collect():
        found.setdefault(r.question_id, {}).setdefault(r.way, set()).add(r.case_number)
    assert found[1] == {"case": {"FC1001"}} and found[2] == {"exhaustive": {"FC1000"}} and found[3] == {"sampled": {"FC1001", "FC1002"}}
    assert found[4] == {"case": {"FC1002"}} or found[4] == {"chunks": {"FC1002"}}
    assert 5 not in found and 6 not in found and 7 not in found


def test_guards_of_the_published_index(spark):
    from filingscope.operators import published

    good = {"version": 1, "generation": "g", "updatedAt": "t", "complete": True, "shardCount": 4, "cases": 2, "shardKeyPrefix": "term-index/v1"}

    rows = [(json.dumps(good), True), (json.dumps(good | {"cases": 0}), False), (json.dumps(good | {"shardKeyPrefix": "x"}), False), (json.dumps({k: v for k, v in good.items() if k != "generation"}), False), ("{", False), (None, False)]
    for payload, want in rows:
        assert spark.createDataFrame([(payload,)], "p string").select(published.is_term_manifest(F.col("p"))).first()[0] is want
    none = spark.createDataFrame([], "payload string")
    asked = spark.createDataFrame([(1, ["storm"])], "question_id long, terms array<string>")
    assert published.route_published(asked, none, spark.createDataFrame([], "shard int, payload string")).collect() == [(1, False, None, None, None, None)]


def test_stages_are_logged(spark):
    log = operations.StageLog(spark)
    assert log.stage(spark.range(7), "seven", kind="x").count() == 7
    with pytest.raises(Exception, match="oops"):
        log.stage(spark.range(1).select(F.raise_error(F.lit("oops"))), "broken")
    rows = log.table().collect()
    assert [(r.stage, r.rows, r.error is None, r.details) for r in rows] == [("seven", 7, True, {"kind": "x"}), ("broken", None, False, {})] and rows[0].seconds > 0


def test_cached_news_get_old(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:00", "ok", "a"), ("2024-01-01 00:20:00", "failed", "b")], "ts string, status string, payload string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.payload for r in operations.cached_news(log, "2024-01-01 00:30:00").collect()] == ["a"]
    assert operations.cached_news(log, "2024-01-01 00:30:01").isEmpty() and operations.cached_news(log.limit(0), "2024-01-01 00:00:00").isEmpty()


def test_published_texts_have_bounds(spark):
    from filingscope.operators import published

    whole = '{"version":1,"generation":"g","updatedAt":"t","complete":true,"shardCount":1,"cases":1,"shardKeyPrefix":"term-index/"%s}'
    for size, want in ((0, True), (70_000, False)):
        assert spark.range(1).select(published.is_term_manifest(F.lit(whole % f',"x":"{"y" * size}"'))).first()[0] is want


def test_equal_short_questions_meet_hints_once(spark):
    asked = spark.range(30_000).selectExpr("id AS question_id", "'solar rates' AS message")
    hints = spark.range(3_000).selectExpr("id", "'solar ' || id AS title", "'news' AS summary")
    began = time.time()
    found = records.short_query_context(asked, hints)
    assert found.count() == 90_000 and time.time() - began < 25
    assert {(r.id, r.pos, r.hits) for r in found.where("question_id % 1000 = 7").collect()} == {(0, 1, 1), (1, 2, 1), (2, 3, 1)}
