"""Golden values of text, hash and scoring functions."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from filingscope.functions import hashing, markdown, scoring, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("term,shard", [("storm", 3990), ("pepco", 2924), ("o&m", 2847), ("uncollectible", 940), ("commission", 1680), ("2025", 3878), ("rate-base", 2723), ("pepco's", 3910), ("a", 2348), ("zzz", 2205)])
def test_shards(spark, term, shard):
    assert one(spark, hashing.term_shard(F.col("t")), t=term) == shard


@pytest.mark.parametrize("word,stem", [("disconnections", "disconnect"), ("reporting", "report"), ("arrearages", "arrearag"), ("rates", "rates"), ("compliance", "compliance"), ("generation", "generat"), ("terminations", "terminat"), ("companies", "compani"), ("pepco's", "pepco's")])
def test_stems(spark, word, stem):
    found = one(spark, text.stem(F.col("w")), w=word)
    assert found == stem and word.startswith(found)


def test_query_terms_put_quoted_words_first_and_drop_stop_words(spark):
    assert one(spark, text.query_terms(F.col("m")), m='What about FC1176 and "storm damage" in the storm reports?') == ["storm", "damage", "reports"]
    assert one(spark, text.query_terms(F.col("m")), m="") == []


def test_case_identifiers(spark):
    for message, case in (("formal case no. 1176 please", "FC1176"), ("see ET2019-01-E", "ET2019-01-E"), ("nothing here", None), ("docket 123456", None)):
        assert one(spark, text.case_identifier(F.col("m")), m=message) == case
    assert one(spark, text.all_case_numbers(F.col("m")), m="FC 1176, caseNumber=1130, docket no. 1176") == ["1176", "1130"]
    assert one(spark, text.is_bare_case_number(F.col("m")), m=" FC-1176 ") is True


def test_years_follow_the_given_day(spark):
    assert one(spark, text.query_years(F.col("m"), "2026-01-01"), m="2023 to 2025, not 1176, 2400 or 1985, 2027 but not 2028") == [2023, 2025, 2027]


def test_follow_ups(spark):
    asked = lambda m, t: one(spark, text.is_follow_up(F.col("m"), F.col("t")), m=m, t=t)
    assert asked("What about 2024?", ["2024"]) and not asked("What about FC1176?", ["x"])


def test_entities_decode_in_order_and_apostrophes_fully(spark):
    assert one(spark, text.strip_html(F.col("h")), h="<p>a &amp;lt; b&#39;s &#x27;c&#x27;&nbsp;&nbsp;d</p>") == "a < b's 'c' d"


def test_dockets(spark):
    assert one(spark, text.docket_cases(F.col("d")), d="FC1176 - 2024-E - 12, ET 2019-01 - 3, x") == ["FC1176-2024-E", "ET2019-01"]
    assert len(one(spark, text.related_cases(F.lit("FC1"), F.col("d")), d=", ".join(f"FC1{i:03} - 1" for i in range(20)))) == 12


def test_titles_and_dates(spark):
    assert one(spark, text.citation_title(F.col("t")), t="[a]\n b " + "x" * 200).endswith("...")
    assert one(spark, text.long_date(F.col("d")), d="2024-01-05") == "January 5, 2024"
    assert one(spark, text.long_date(F.col("d")), d="soon") == "soon"


def test_urls(spark):
    official = lambda u: one(spark, text.is_official_url(F.col("u"), "example.org"), u=u)
    assert official("https://a.example.org/x") and official("https://example.org") and not official("https://badexample.org") and not official("::")
    assert one(spark, text.normal_url(F.col("u"), "example.org"), u="http://edocket.example.org/search/casedetail?casenumber=1") == "https://edocket.example.org/Search/CaseDetail?caseNumber=1"
    assert one(spark, text.is_attachment_url(F.col("u"), "edocket.example.org", "/api/download"), u="https://edocket.example.org/api/download?attachId=12&guidFileName=a.pdf") is True


def test_hmac_matches_the_standard_one(spark):
    want = base64.urlsafe_b64encode(hmac.new(b"k" * 80, b"1.abc", hashlib.sha256).digest()).decode().rstrip("=")
    assert one(spark, hashing.signature("k" * 80, F.col("p")), p="1.abc") == want
    request = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    token = one(spark, hashing.issue_token("s", F.col("r"), F.lit(1000)), r=request)
    assert one(spark, hashing.verified_request("s", F.col("t"), 2000), t=token) == request
    assert one(spark, hashing.verified_request("s", F.col("t"), 2000), t=token + "x") is None
    assert one(spark, hashing.verified_request("s", F.col("t"), 8 * 86_400_000), t=token) is None


def test_scores(spark):
    score = lambda hits, day, years: one(spark, scoring.document_score(F.lit(hits), F.col("d"), F.col("y").cast("array<int>"), "2026-01-01"), d=day, y=years)
    assert score(3, "2025-02-01", []) > score(3, "2019-02-01", []) and score(4, "1999-01-01", []) > score(2, "2025-01-01", [])
    assert score(3, "2024-02-01", [2023]) == pytest.approx(3 + 0.9 + 0.6 * (1 - 2 / 12))
    assert one(spark, scoring.stored_weight(F.col("w")), w=0.025) == 2 and one(spark, scoring.stored_weight(F.col("w")), w=0.0) == 1
    assert one(spark, scoring.adjusted_hits(F.lit(3), F.lit(5), F.col("f")), f=0.0) == 3 and one(spark, scoring.adjusted_hits(F.lit(5), F.lit(5), F.col("f")), f=1.0) == 0
    assert [scoring.shard_bounds(204_191, i, 4) for i in (0, 3)] == [(0, 62_500), (187_500, 204_191)]
    assert scoring.retry_delay(3) == 8 and scoring.retry_delay(9) == 30 and scoring.retry_delay(1, "90") == 60


ROWS = [{"title": "Storm [Report]", "url": "https://x.org/a.pdf", "page_number": 4, "kind": None}]


def test_relinking_repairs_bare_citations_only():
    assert markdown.relink_text("see [Storm Report — p. 2], [Other] and [Storm Report](u)", ROWS) == "see [Storm Report — p. 2](https://x.org/a.pdf#page=2), [Other] and [Storm Report](u)"


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_streamed_repair_equals_whole_repair(size):
    reply = "As [Storm Report — p. 2] says, and [this] too [Storm Report](x). End"
    worker, out = markdown.Relinker(ROWS), ""
    for at in range(0, len(reply), size):
        out += worker.push(reply[at : at + size])
    assert out + worker.push("", True) == markdown.relink_text(reply, ROWS)


def test_streamed_citation_joins_its_sentence():
    worker = markdown.Relinker(ROWS)
    out = worker.push("The filing says so\n") + worker.push("\n[Storm Report — p. 2]\n, and more") + worker.push("", True)
    assert out == "The filing says so [Storm Report — p. 2](https://x.org/a.pdf#page=2), and more"
    assert markdown.Relinker(ROWS).push("[" + "y" * 400) == "[" + "y" * 400


def test_chunks_overlap_and_cover():
    body = "".join(f"Sentence number {i}. " for i in range(400))
    parts = markdown.chunk_text(body)
    assert len(parts) > 3 and all(len(p) <= 1800 for p in parts) and parts[0].endswith(".") and parts[1][:50] in body and markdown.chunk_text("") == [] and markdown.chunk_text("ab") == ["ab"]


def test_labels_and_inline_sources():
    assert markdown.source_labels_text("x [Source 1, p. 3] y Source 1", ROWS).count("](https://x.org/a.pdf#page=4)") == 2
    assert markdown.source_labels_text("Source 12, Source 2", ROWS) == "Source 12, Source 2"
    assert markdown.inline_sources("the Newsroom and [Newsroom](a) newsroom", [("Newsroom", "u")]) == "the [Newsroom](u) and [Newsroom](a) [newsroom](u)"


def test_every_spelling_of_a_verified_target_is_linked():
    base = "https://e.example.org"
    links = [("FC 1017 - Rates", f"{base}/public/search/casenumber/1017"), ("FC1017 - 2020 - 5", f"{base}/public/search/details/FC1017/5"), ("ET2020 - a b.pdf", f"{base}/apis/api/Filing/download?attachId=1")]
    specs = markdown.mentions(links, [("Power news", "https://n")])
    found = markdown.inline_sources("Formal Case No. 1017 (FC 1017), fc 1017, FC1017; Power News; A b.pdf in et2020", specs)
    case, news, file = f"({base}/public/search/casenumber/1017)", "(https://n)", f"({base}/apis/api/Filing/download?attachId=1)"
    assert found == f"[Formal Case No. 1017 (FC 1017)]{case}, [fc 1017]{case}, [FC1017]{case}; [Power News]{news}; [A b.pdf]{file} in [et2020]{file}"


ROW = {"title": "WGL's Monthly Report, pursuant to Order No. 15134.", "url": "https://e.example.org/b.pdf", "page_number": 2, "kind": None}


def streamed(parts, rows=(ROW,)):
    worker = markdown.Relinker(list(rows))
    return "".join(worker.push(p) for p in parts) + worker.push("", True)


def test_citations_side_by_side_keep_their_pages():
    out = markdown.relink_text(f"[{ROW['title']} — p. 2][{ROW['title']} — p. 4].", [ROW])
    assert out.count("](https://e.example.org/b.pdf#page=") == 2 and "#page=4" in out
    assert markdown.relink_text("The order [see paragraph 8] (sic) is unrelated.", [ROW]) == "The order [see paragraph 8] (sic) is unrelated."
    assert markdown.relink_text(f"[{ROW['title']}]  (x)", [ROW]) == f"[{ROW['title']}]  (x)"


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_a_stream_joins_citations_to_their_sentence_however_it_is_cut(size):
    text = f"low-income segments\n[{ROW['title']} — p. 2]\n,\nand further detail. First \n[not a citation]\n, second. \n "
    out = streamed([text[i : i + size] for i in range(0, len(text), size)])
    assert out == f"low-income segments [{ROW['title']} — p. 2](https://e.example.org/b.pdf#page=2),\nand further detail. First \n[not a citation]\n, second. \n "


def test_a_stream_sends_prose_at_once():
    worker = markdown.Relinker([ROW])
    assert worker.push("Plain prose with no brackets.") == "Plain prose with no brackets." and worker.push(" Then [") == " Then "
    worker = markdown.Relinker([ROW], hold=16)
    worker.push("[")
    assert "x" in worker.push("x" * 40)


@pytest.mark.parametrize("seed", range(20))
def test_chunks_end_at_the_last_break_that_is_late_enough(seed):
    import random

    rnd = random.Random(seed)
    body = "".join(rnd.choice(["ab", " ", ". ", "\n", "c"]) for _ in range(rnd.randrange(0, 400)))
    want, at = [], 0
    while len(body) > 40 and at < len(body):  # brute force: all places of a break
        stop = min(at + 40, len(body))
        late = [i for i in range(len(body)) if (body[i] == "\n" or body[i : i + 2] == ". ") and at + 24 < i <= stop]
        if stop < len(body) and late:
            stop = late[-1] + 1
        want.append(body[at:stop].strip())
        if stop >= len(body):
            break
        at = max(stop - 10, at + 1)
    assert markdown.chunk_text(body, 40, 10) == ([w for w in want if w] if len(body) > 40 else [body] if body else [])


def test_chunks_leave_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(markdown, "SLICE_BYTES", 20_000)
    pages = [None, "", "short", *("word. " * (400 * i) for i in range(1, 30))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["key", "page"])
    out = list(markdown.chunk_rows(iter([batch])))
    longest = max(sum(map(len, markdown.chunk_text(p))) for p in pages)
    assert len(out) > 10 and all(sum(map(len, b.column(2).to_pylist())) <= 20_000 + longest for b in out)
    want = [(i, at, piece) for i, p in enumerate(pages) for at, piece in enumerate(markdown.chunk_text(p))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_stems_lower_a_text_once(spark):
    from filingscope.functions import text

    assert str(text.stems(F.col("t"))).count("lower(") == 1
    rows = spark.createDataFrame([("Filings FILED the Agency's regulations",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.stems(F.col("t")) == F.array_distinct(F.transform(text.tokens(F.col("t")), text.stem))).collect()] == [True, True]
