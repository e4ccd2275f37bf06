"""The metadata scan: whatever stops it, it ends with the same manifests and states."""

import pytest
from pyspark.sql import functions as F

from filingscope.operators.ingest import is_public_pdf
from filingscope.sources import manifests, paged
from filingscope.sources.store import Store
from filingscope.streaming import scan

N = 47


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pages')}"
    rows = spark.range(N).selectExpr("id AS filingId", "concat('2024-01-', lpad(cast(1 + id % 28 AS string), 2, '0')) AS receivedDate", "id % 7 = 0 AS isConfidential", "concat('FC', 100 + id % 5, ' - ', id) AS docketNumber", "if(id % 6 = 0, 'a.doc', 'a.pdf') AS attachment", "id AS attachmentId")
    paged.land(rows, path, 10)
    return path


def new(spark, pages, target, **o):
    return scan.MetadataScan(spark, pages, f"file://{target}", shards=2, records=12, now="t", pageSize="10", tries="1", pace="0", **o)


WANT = sorted((i, f"FC{100 + i % 5}") for i in range(N) if i % 7 and i % 6 and i)


def found(one):
    return sorted((r.filing_id, r.case_number) for r in manifests.read_manifests(one.spark, one.manifests).collect())


def test_a_whole_scan(spark, pages, tmp_path):
    one = new(spark, pages, tmp_path)
    assert scan.metadata_coverage(one.states()).collect() == []
    assert one.run() and found(one) == WANT
    assert [tuple(r) for r in scan.metadata_coverage(one.states()).collect()] == [(N, N, len(WANT), True, "t")]
    assert not one.step() and found(one) == WANT  # nothing is left


def test_the_time_budget_ends_a_run(spark, pages, tmp_path):
    times = iter([0, 5, 11])
    one = new(spark, pages, tmp_path)
    assert not one.run(10, lambda: next(times)) and 0 < len(found(one)) < len(WANT)
    assert scan.metadata_coverage(one.states()).first().complete is False
    assert new(spark, pages, tmp_path).run() and found(one) == WANT


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_scan_that_dies_before_its_cursors_move(spark, pages, tmp_path, monkeypatch, at):
    seen = []

    def write(self, name, data, real=Store.write):
        seen.append(name)
        if len(seen) == at:
            raise OSError("gone")
        real(self, name, data)

    one = new(spark, pages, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(Store, "write", write)
        with pytest.raises(OSError):
            one.run()
    assert found(one)  # manifests come first
    assert new(spark, pages, tmp_path).run() and found(one) == WANT
    assert [tuple(r) for r in scan.metadata_coverage(one.states()).collect()] == [(N, N, len(WANT), True, "t")]


def test_a_page_that_cannot_be_had_holds_its_shard(spark, pages, tmp_path):
    store = Store(pages)
    held = store.read(paged.page_name(1))
    store.write(paged.page_name(1), b'{"status": 503}')
    one = new(spark, pages, tmp_path)
    try:
        with pytest.raises(paged.PageUnavailable):
            one.run()
    finally:
        store.write(paged.page_name(1), held)
    assert one.state(0)["nextOffset"] == 10 and one.state(0)["publicPdfRecords"] == sum(1 for i in sorted(range(N), key=lambda i: (i % 28, i))[:10] if i % 7 and i % 6 and i)
    assert new(spark, pages, tmp_path).run() and found(one) == WANT


def test_stored_content_stays_and_recent_records_come_again(spark, pages, tmp_path):
    one = new(spark, pages, tmp_path)
    kept = spark.createDataFrame([(8, "FC103", "old", "k8", False), (900, "FC999", "other", "k900", False)], "filing_id long, case_number string, title string, r2_key string, metadata_only boolean")
    manifests.write_manifests(kept, one.manifests)
    one.recent("2024-01-05")
    rows = {(r.filing_id, r.case_number): (r.title, r.r2_key) for r in manifests.read_manifests(spark, one.manifests).collect()}
    assert rows[8, "FC103"] == ("old", "k8") and rows[900, "FC999"] == ("other", "k900")
    assert set(rows) - {(900, "FC999")} == {(i, c) for i, c in WANT if i % 28 >= 4}


def test_stored_bytes(spark, tmp_path):
    for name, size in (("a/x", 3), ("a/y", 4), ("b/z", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    assert {r.folder: (r.files, r.bytes) for r in scan.stored_bytes(spark, str(tmp_path)).collect()} == {"a": (2, 7), "b": (1, 1), None: (3, 8)}


def test_public_records(spark):
    row = spark.range(1).select(is_public_pdf(F.lit(None), F.lit(False), F.lit(5), F.lit("A.PDF")).alias("a"), is_public_pdf(F.lit(None), F.lit(None), F.lit(0), F.lit("a.pdf")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_json_objects_are_read_with_tries(tmp_path, monkeypatch):
    import gzip

    from filingscope.sources import store as module

    waits, store = [], Store(f"file://{tmp_path}")
    monkeypatch.setattr(module.time, "sleep", waits.append)
    store.write("a.json", b'{"x": 1}')
    store.write("b.json.gz", gzip.compress(b'{"x": 2}'))
    store.write("c.json", b'{"x": ')
    assert store.read_json("a.json") == {"x": 1} and store.read_json("b.json.gz") == {"x": 2} and waits == []
    assert store.read_json("c.json") is None and store.read_json("none.json") is None and waits == pytest.approx([0.2, 0.4] * 2)
    answers = [OSError("x"), b"", b'{"x": 3}']
    monkeypatch.setattr(store, "read", lambda _: (_ for _ in ()).throw(a) if isinstance(a := answers.pop(0), OSError) else a)
    assert store.read_json("a.json") == {"x": 3}


def test_a_broken_state_stops_the_scan(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr("filingscope.sources.store.time.sleep", lambda _: None)
    one = new(spark, pages, tmp_path)
    one.store.write(one._name(0), b"{")
    with pytest.raises(OSError, match="can't be read"):
        one.step()
