"""Paged records, manifests, published generations and shards on small handmade inputs."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from filingscope.functions import hashing
from filingscope.operators import index, published
from filingscope.sources import generations, manifests, paged
from filingscope.sources.paged import PagedReader, PagedStream, Pages, PageUnavailable, ranges


def landed(spark, path, n=53, size=10):
    rows = spark.range(n).selectExpr("id AS filingId", "concat('2024-01-', lpad(cast(1 + id % 28 AS string), 2, '0')) AS receivedDate", "id % 3 = 0 AS isConfidential", "'x\"' AS attachment")
    paged.land(rows, f"file://{path}", size)
    return sorted((f"2024-01-{1 + i % 28:02d}", i) for i in range(n))


def test_pages_are_read_in_ranges(spark, tmp_path, monkeypatch):
    want = landed(spark, tmp_path)
    monkeypatch.setattr(paged, "PAGES_A_TASK", 2)
    read = lambda **o: spark.read.format("paged_records").options(pageSize=10, **o).load(f"file://{tmp_path}")
    got = sorted((r.position, r.receivedDate, r.filingId) for r in read().collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
    window = lambda **o: sorted(r.position for r in read(**o).collect())
    assert window(skip=7, take=20) == list(range(7, 27)) and window(skip=50, take=20) == [50, 51, 52] and window(skip=99) == []
    assert window(order="desc", skip=1, take=4) == [48, 49, 50, 51]
    assert read().where("receivedDate >= '2024-01-20'").count() == sum(d >= "2024-01-20" for d, _ in want)


def test_a_cutoff_skips_pages(spark, tmp_path):
    want = landed(spark, tmp_path)
    asked = []
    reader = PagedReader({"path": f"file://{tmp_path}", "pagesize": "10", "since": "2024-01-20"})
    get, Pages.get = Pages.get, lambda self, page: (asked.append(page), get(self, page))[1]
    try:
        parts = reader.partitions()
    finally:
        Pages.get = get
    first = next(i for i, (d, _) in enumerate(want) if d >= "2024-01-20")
    assert parts[0].start == first // 10 * 10 and parts[-1].end == 53 and len(asked) <= 5


def test_ranges_cover_everything():
    for start, end in ((0, 1), (5, 6), (0, 10_000), (3199, 3201), (7, 7)):
        parts = ranges(start, end, 100)
        assert [x for p in parts for x in (p.start, p.end)] == ([start, *(y for p in parts[1:] for y in (p.start, p.start)), end] if start < end else [])
        assert all(p.end - p.start <= 3200 for p in parts)


def test_tries_of_a_page(spark, tmp_path, monkeypatch):
    landed(spark, tmp_path)
    waits, answers = [], []
    monkeypatch.setattr(paged.time, "sleep", waits.append)
    monkeypatch.setattr(paged.random, "random", lambda: 0.5)
    pages = Pages({"path": f"file://{tmp_path}", "pagesize": "10"})
    ask = pages.request
    monkeypatch.setattr(pages, "request", lambda page: answers.pop(0) if answers else ask(page))
    answers[:] = [(503, {}, None), (429, {}, "7"), (200, {"resultsSet": None}, None), (500, {}, "900")]
    assert len(pages.get(1)["resultsSet"]) == 10 and waits == [1.5, 7, 4.5, 60]
    waits.clear()
    answers[:] = [(503, {}, None)] * 6
    with pytest.raises(PageUnavailable) as e:
        pages.get(1)
    assert not e.value.permanent and waits == [1.5, 2.5, 4.5, 8.5, 16.5]
    answers[:] = [(403, {}, None)]
    with pytest.raises(PageUnavailable) as e:
        pages.get(1)
    assert e.value.permanent and not answers
    with pytest.raises(PageUnavailable):
        pages.get(99)


def test_a_missing_page_holds_the_stream(spark, tmp_path):
    landed(spark, tmp_path)
    store = paged.Store(f"file://{tmp_path}")
    held = store.read(paged.page_name(3))
    store.delete(paged.page_name(3))
    stream = PagedStream({"path": f"file://{tmp_path}", "pagesize": "10", "tries": "1"})
    assert stream.latestOffset() == {"records": 30} == stream.latestOffset()
    store.write(paged.page_name(3), held)
    assert stream.latestOffset() == {"records": 53}
    again = PagedStream({"path": f"file://{tmp_path}", "pagesize": "10", "tries": "1"})
    again.partitions({"records": 30}, {"records": 53})
    assert again.latestOffset() == {"records": 53} and [(p.start, p.end) for p in again.partitions({"records": 25}, {"records": 53})] == [(25, 53)]
    # A last page that isn't full is taken as it is, and its rest later.
    body = json.loads(store.read(paged.page_name(5)))
    store.write(paged.page_name(5), json.dumps({**body, "resultsSet": [*body["resultsSet"], {"filingId": 999}]}).encode())
    assert again.latestOffset() == {"records": 54}
    rows = [x for b in again.read(again.partitions({"records": 53}, {"records": 54})[0]) for x in b.to_pylist()]
    assert [(r["filingId"], r["position"]) for r in rows] == [(999, 53)]


def test_pages_that_are_not_committed_do_not_show(tmp_path):
    from pyspark.sql import Row

    writer = paged.PageWriter({"path": f"file://{tmp_path}"})
    message = writer.write(iter([Row(page=0, payload="{}")]))
    assert paged.Store(f"file://{tmp_path}").names() == []
    writer.abort([message, None])
    assert paged.Store(f"file://{tmp_path}").names("_staged") == []
    writer.commit([writer.write(iter([Row(page=0, payload="{}")])), None])
    assert paged.Store(f"file://{tmp_path}").names() == ["page-000000000.json"]


def test_manifests_in_parts(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    rows = spark.range(500).selectExpr("id AS filing_id", "if(id % 3 = 0, 'FC100', concat('FC', 200 + id % 5)) AS case_number", "concat('t', id) AS title", "cast(null AS string) AS r2_key")
    read = lambda: sorted((r.filing_id, r.case_number, r.title) for r in manifests.read_manifests(spark, path).collect())
    want = sorted((r.filing_id, r.case_number, r.title) for r in rows.collect())
    manifests.write_manifests(rows, path)
    store = paged.Store(path)
    assert read() == want and store.names("FC100") == ["part-0-of-1.json.gz"]
    manifests.write_manifests(rows.where("case_number IN ('FC100', 'FC201')"), path, 4096)  # dirty cases only
    assert read() == want and len(store.names("FC100")) > 2 and store.names("FC200") == ["part-0-of-1.json.gz"]
    kept = {c: store.names(c) for c in ("FC100", "FC201")}
    with pytest.raises(Exception, match="more than 100"):
        manifests.write_manifests(rows.withColumn("title", F.lit("x" * 300)), path, 100)
    assert read() == want and {c: store.names(c) for c in kept} == kept


def postings_of(spark, cases=10):
    rows = spark.createDataFrame([(i, f"FC{i}", "t", None, f"storm word{i} word{i + 1}") for i in range(cases)], "filing_id long, case_number string, title string, received_date string, text string")
    return index.postings(rows)


def test_a_reader_finds_an_index_between_all_steps(spark, tmp_path, monkeypatch):
    path, postings = f"file://{tmp_path}/i", postings_of(spark).cache()
    generations.publish_index(postings, path, 2)
    whole, steps = generations.read_postings(spark, path).count(), []

    def watched(name):
        step = getattr(generations.Folder, name)

        def run(self, *args):
            steps.append(name)
            assert generations.read_postings(spark, path).count() == whole
            out = step(self, *args)
            assert generations.read_postings(spark, path).count() == whole
            return out

        monkeypatch.setattr(generations.Folder, name, run)

    watched("create")
    watched("delete")
    for _ in range(4):
        generations.publish_index(postings, path, 2)
    assert steps.count("create") == 4 and "delete" in steps
    assert len(generations.Folder(spark, path).names("generations")) == generations.KEPT == len(generations.Folder(spark, path).names("pointers"))


def test_a_publisher_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path, postings = f"file://{tmp_path}/i", postings_of(spark).cache()
    first = generations.publish_index(postings, path, 2)
    with monkeypatch.context() as m:
        m.setattr(generations.Folder, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            generations.publish_index(postings, path, 2)
    assert generations.current_generation(spark, path) == first
    with pytest.raises(ValueError):
        generations.publish_index(postings_of(spark, 2), path, 2)  # the guard still knows the size
    assert generations.current_generation(spark, path) == first
    assert generations.publish_index(postings_of(spark, 2), path, 2, allow_shrink=True)["number"] == 2


def test_held_generations_stay(spark, tmp_path):
    path, postings = f"file://{tmp_path}/i", postings_of(spark).cache()
    generations.publish_index(postings, path, 2)
    with generations.held_generation(spark, path) as meta:
        for _ in range(3):
            generations.publish_index(postings, path, 2)
        assert generations.read_postings(spark, path, ["storm"], meta).count() == 10
    assert generations.retire(spark, path) == [meta["generation"]]
    with pytest.raises(FileNotFoundError), generations.held_generation(spark, f"{path}/none"):
        pass


@pytest.mark.parametrize("most", [700, 2000, 8 << 20])
def test_shards_within_the_bound(spark, most):
    rows = [("common", f"FC{i:04d}", 90, 5) for i in range(90)] + [(f"w{i}\"", "FC1", 1, 7) for i in range(40)] + [("capped", None, 900, None)]
    postings = spark.createDataFrame(rows, "stem string, case_number string, df long, weight int")
    shards = published.shard_payloads(postings, "g", 2, most).cache()
    got = shards.collect()
    assert all(len(r.payload.encode()) <= most for r in got) and (len(got) > 4 if most == 700 else len(got) >= 2)
    assert {(r.shard, r.part) for r in got} == {(s, p) for s in {r.shard for r in got} for p in range(sum(x.shard == s for x in got))}
    found = [(stem, e) for r in got for stem, e in json.loads(r.payload)["terms"].items()]
    pairs = sorted((stem, c, int(w)) for stem, e in found for c, w in zip(e[1::2], e[2::2]))
    assert pairs == sorted((s, c, w) for s, c, _, w in rows if c) and {(s, e[0]) for s, e in found} == {(s, d) for s, _, d, _ in rows}
    manifest = published.manifest_payload(spark.createDataFrame([(f"FC{i}",) for i in range(9999)], "case_number string"), "g", "t", shards=2)
    told = {r.term: r for r in published.verify_terms(spark.createDataFrame([("common",), ("capped",), ("none",)], "term string"), manifest, shards.select("shard", "payload")).collect()}
    assert (told["common"].status, told["common"].frequency, told["common"].cases) == ("ok", 90, [f"FC{i:04d}" for i in range(5)])
    assert (told["capped"].status, told["capped"].cases, told["none"].status) == ("ok", [], "miss")
    routed = lambda s: published.route_published(spark.createDataFrame([(1, ["common"])], "question_id long, terms array<string>"), manifest, s.select("shard", "payload")).orderBy("rank").collect()
    assert [r.case_number for r in routed(shards)] == [f"FC{i:04d}" for i in range(8)]
    own = int(spark.range(1).select(hashing.term_shard(F.lit("common"), 2)).first()[0])
    if sum(r.shard == own for r in got) > 1:  # without one of its parts a shard isn't there
        assert [tuple(r)[:3] for r in routed(shards.where(f"NOT (shard = {own} AND part = 1)"))] == [(1, False, None)]


def test_pages_of_a_service(monkeypatch):
    """The same requests over HTTP, to a service on this machine that fails now and then."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    asked, failures = [], [503, 429, None, 404]

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items() if v[0].isdigit()}
            asked.append((q["skip"], q["take"]))
            status = failures.pop(0) if failures else None
            self.send_response(status or 200)
            if status == 429:
                self.send_header("Retry-After", "3")
            self.end_headers()
            if not status:
                rows = [{"filingId": i, "receivedDate": f"2024-01-{i:02d}"} for i in range(1, 26)]
                self.wfile.write(json.dumps({"resultsSet": rows[q["skip"] : q["skip"] + q["take"]], "total": 25}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    waits = []
    monkeypatch.setattr(paged.time, "sleep", waits.append)
    monkeypatch.setattr(paged.random, "random", lambda: 0.25)
    options = {"path": f"http://127.0.0.1:{server.server_port}/filings", "pagesize": "10"}
    try:
        assert [r["filingId"] for r in Pages(options).get(1)["resultsSet"]] == list(range(11, 21))
        assert waits == [1.25, 3] and asked == [(10, 10)] * 3
        with pytest.raises(PageUnavailable) as e:
            Pages(options).get(2)
        assert e.value.permanent
        reader = PagedReader({**options, "since": "2024-01-12"})
        parts = reader.partitions()
        assert (parts[0].start, parts[-1].end) == (10, 25)
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["filingId"], r["position"]) for r in rows] == [(i + 1, i) for i in range(10, 25)]
        assert PagedStream(options).latestOffset() == {"records": 25}
    finally:
        server.shutdown()
    assert Pages({**options, "path": "http://127.0.0.1:9/none"}).request(0)[0] == 503  # nobody answers


def test_tokens_of_a_large_table_are_verified(spark, tmp_path):
    spark.range(399_998, 400_004).selectExpr("id AS doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    rows = entry.queries()["request_tokens"](spark, str(tmp_path)).collect()
    assert all((r.verified is not None) == (r.doc_id % 2 == 0) for r in rows) and len(rows) == 6


def test_news_titles_keep_references_that_are_text(spark, tmp_path):
    pages = [(1, "https://example.org/a", "<title>x &quot;y&quot; &amp; &lt;z&nbsp;&#39;</title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = entry.queries()["news"](spark, str(tmp_path)).first()
    assert row.title == "x &quot;y&quot; & <z&nbsp;&#39; & more" and row.summary == "x &quot;y&quot; & <z&nbsp;&#39; <1>"


def test_digests_hold_all_feedback(spark, tmp_path):
    spark.range(250).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    rows = entry.queries()["feedback_digest"](spark, str(tmp_path)).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in rows] == [(0, 100), (1, 100), (2, 50)] and sum(r.down for r in rows) == sum(i % 3 != 0 for i in range(250))
    assert all(r.digest.count("### ") == r.down for r in rows)


def test_published_shards_are_parsed_once(spark):
    postings = spark.createDataFrame([(f"stem{i}", f"FC{j}", 3, 100 + i, 9) for i in range(40) for j in range(3)], "stem string, case_number string, df long, weight int, cases long")
    shards = published.shard_payloads(postings, "g1", 4, 1024)
    m, read = published._current(published.manifest_payload(postings, "g1", "2026-01-01T00:00:00Z", shards=4), shards)
    assert "from_json" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.selectExpr("explode(s.terms)").select("key").distinct().count() == 40
