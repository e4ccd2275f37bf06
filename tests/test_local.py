"""Local answers and short questions on small handmade inputs."""

from pyspark.sql import functions as F

from filingscope.operators import local

RESULT = "question_id long, rank int, case_number string, docket_number string, filing_id long, filename string, filing_type string, filer string, received_date string, page int, matched_terms array<string>, phrase boolean, url string, text string"


def results(spark):
    row = (1, "FC1", "FC1 - 2", 7, "A [b]\r\nc.pdf", None, "", None, 0, ["x", "y"], True, "https://x.org/a.pdf#z", "body")
    return spark.createDataFrame([(row[0], 1, *row[1:]), (1, 2, "FC1", None, 7, "A [b]\r\nc.pdf", "Order", "B", "2024-01-02", 0, [], False, "nowhere", None), (1, 3, "FC1", "", 8, "d", None, None, None, 4, None, None, "https://x.org/d", "")], RESULT)


def test_labels_are_replaced_once():
    cited = ["[one](u)", "[Local Source 1](v)"]
    assert local.labels_replaced("[Local Source 1, p. 3](x) local  source 2 [LOCAL SOURCE 1] Local Source 3 Local Source 10", cited) == "[one](u) [Local Source 1](v) [one](u) Local Source 3 Local Source 10"
    assert local.labels_replaced("Nonlocal Source 1", cited) == "Nonlocal Source 1"


def test_replies_list_each_page_once(spark):
    replies = spark.createDataFrame([(1, "See Local Source 1 and Local Source 2."), (2, "Local Source 1"), (3, None)], "question_id long, reply string")
    got = {r.question_id: r.reply for r in local.local_replies(replies, results(spark)).collect()}
    assert got[1] == "See [A b c.pdf — p. 0](https://x.org/a.pdf#page=1) and [A b c.pdf — p. 0](nowhere).\n\n---\n**Retrieved from the local e-Docket index:**\n- [FC1 - 2 — A [b]\r\nc.pdf, p. 0](https://x.org/a.pdf#page=1)\n- [FC1 — d, p. 4](https://x.org/d#page=4)"
    assert got[2] == "Local Source 1" and got[3] is None


def test_context_has_every_result(spark):
    context = local.local_context(results(spark)).first().context
    assert context.count("Internal evidence record") == 3 and "Matched terms: x, y\n" in context and context.count("Matched terms: metadata match") == 2
    assert context.index("record 1 ") < context.index("record 2 ") < context.index("record 3 ") and "Filer: Unknown" in context and "exact phrase: yes" in context


def test_short_questions_without_news(spark):
    asked = spark.createDataFrame([(1, "solar rates?"), (2, "hello"), (3, "solar " * 40), (4, None)], "question_id long, message string")
    none = spark.createDataFrame([], "position int, title string, date string, summary string, url string")
    rows = local.short_query_enrichment(asked, none, "agency", [("u", "t")]).collect()
    assert [r.question_id for r in rows] == [1] and [tuple(x) for x in rows[0].links] == [("u", "t")]
    assert rows[0].context.count("Topic hint") == 2 and 'terms: "solar", "rates".' in rows[0].context and rows[0].context.endswith("available now:\n")
    one = none.unionByName(spark.createDataFrame([(i, "T", "d", "Solar park" if i > 1 else None, f"n{i}") for i in range(1, 9)], none.schema))
    row = local.short_query_enrichment(asked, one.withColumn("title", F.concat("title", F.col("position").cast("string"))), "agency", []).first()
    assert [x.title for x in row.links] == ["T2", "T3", "T4"] and "related to this query" in row.context
