"""Vectors, pages, conversations and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingscope.llm import ann, chat, html_extract

DATA = "/root/testdata/sf0.001"


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("part", F.lit("x"))
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    rows = vectors.collect()
    data, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    place, hits, n = {v: i for i, v in enumerate(ids)}, 0, 0
    by = {}
    for r in found:
        assert r.score == pytest.approx(float(data[place[r.query_id]] @ data[place[r.vec_id]]), abs=1e-12) and r.vec_id != r.query_id
        by.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for q, own in by.items():
        own.sort()
        assert [x[0] for x in own] == list(range(1, 21)) and own == sorted(own, key=lambda x: (-x[1], x[2]))
        near = data @ data[place[q]]
        near[place[q]] = -9
        hits, n = hits + len({x[2] for x in own} & set(ids[np.argsort(-near)[:20]].tolist())), n + 20
    assert len(by) == sum(ids % 20 == 0) and hits / n >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, [0.5, 0.5]), (20, [0.0, 2.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 8, 1.0), (20, 3, 0, 0.0)]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    ask = lambda: sorted(map(tuple, ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()))
    whole = ask()
    monkeypatch.setattr(ann, "BLOCK", 17)
    assert ask() == whole


def test_balance():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(600, 8))
    parts = ann.balanced_parts(ann._neighbours(data, 8), 6, np.arange(600) % 6)
    assert np.bincount(parts, minlength=6).max() <= 111


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies here</p></div>
<nav><ul><li><a href=x>a</a></ul></nav><div id="content"><h1>Title &amp; more</h1><p>First  para with <a href=y>link</a> and<br>break &lt;b&gt;.<p>Second unclosed <b>bold<p>Sh.</p>
<ul><li>one<li>two</ul><div class="ad">Buy now buy now buy now</div><form><p>Your name</p><input></form><script>var x="</p>";</script>
<div class="comments"><p>Nice article, this is a long comment by a reader.</p></div></div><aside><p>Side bar text</p></aside><footer>foot</footer><div cla"""
MAIN = "Title & more\nFirst para with link and break <b>.\nSecond unclosed bold\nSh.\none\ntwo"


def test_pages(spark):
    article = "<body><nav><a>x</a></nav><article><h1>T</h1><p>a</p><p>b &eacute;&#x27;</p><section id='comments'><p>c</p></section></article><article class='comment'><p>no</p></article><footer>f</footer>"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain text", "x"), (5, "u", article, "x"), (5, "u", article, "x"), (None, "u", "<p>" + "w " * 100000, "x"), (7, "u", "<script>var a = 1", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extract.extract_pages(pages)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in found.collect()), key=str)
    want = [(1, MAIN), (2, ""), (3, ""), (4, "plain text"), (5, "T\na\nb é'"), (5, "T\na\nb é'"), (None, ("w " * 100000).strip()), (7, "")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert html_extract.smooth(np.ones(7)) == pytest.approx(np.ones(7)) and len(html_extract.smooth(np.array([1.0]))) == 1
    assert 1 < html_extract.threshold(np.array([0.0, 1.0, 0.5, 9.0, 10.0])) < 9


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><form action=x>{}<label>Name</label><input><select><option>a</select><button>Go</button></form></body>", "{}\nName"),
        ("<body><div><article>{}</article></div><form class=search><p>Your name and address</p><textarea>x</textarea></form></body>", "{}"),
        ("<body><article>{}<form><p>Subscribe by mail</p></form></article></body>", "{}"),
        ("<body><article>{}<p>where <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a=b</annotation></math> holds</p></article></body>", "{}\nwhere a=b holds"),
        ("<body><article>{}<p aria-hidden=true>A note for readers.</p></article></body>", "{}\nA note for readers."),
        ("<body><div hidden><p>Loading, please</p></div><article>{}</article></body>", "{}"),
    ],
)
def test_forms_formulas_and_hidden_text(page, text):
    lines = [f"Paragraph number {i} of the article, which is long enough to be text." for i in range(6)]
    assert html_extract.main_text(page.format("".join(f"<p>{x}</p>" for x in lines))) == text.format("\n".join(lines))


def test_quotes(spark):
    first, answer = "Hello there, this is the first message about budgets.", "Sure, here is my answer to the budget question."
    rows = [(1, 0, "user", first + "\nAnd a second line of it."), (1, 1, "assistant", answer), (1, 2, "user", f"On Mon, Bob wrote:\n> {answer}\n>> {first}\n\nThanks, and next year?"), (1, 3, "user", f"> {first.upper()}\nI reply to the first one."), (1, 3, "user", f"> {first}\nI reply to the first one."), (None, 0, "user", "x"), (2, None, "user", None), (2, 5, None, "alone"), (3, 0, "user", "> words that nobody wrote before"), (3, 1, "user", "")]
    talk = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, thread int, h string")
    out = chat.link_quotes(talk).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert got[1, 2].text == "Thanks, and next year?" and got[1, 2].quote_levels == 2 and (got[1, 2].reply_to, got[1, 2].thread) == (1, 0)
    assert got[1, 3].linked and (got[1, 3].reply_to, got[1, 3].thread) == (0, 3)
    assert not got[3, 0].linked and got[3, 0].text == "> words that nobody wrote before" and got[3, 1].reply_to == 0
    assert sorted(r.position for r in out if r.conv_id == 1) == list(range(5)) and got[None, 0].position == 0
    assert chat.link_quotes(talk.limit(0)).count() == 0


def test_messages_without_quotes_stay(spark):
    talk = spark.read.parquet(f"{DATA}/conversations.parquet")
    out = chat.link_quotes(talk)
    assert out.select("conv_id", "turn", "role", "text").exceptAll(talk).isEmpty() and out.count() == talk.count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    table, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        found = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != "packing":
            assert found.columns == table.columns
        kept.append(found.count())
        table = found
    assert kept[0] == 200 and kept[0] >= kept[1] >= kept[2] > 0 and kept[4] > 0
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_reply_tree_orders_messages(spark):
    def walk(t):
        return [t, *(x for c in sorted(c for c, up in above.items() if up == t) for x in walk(c))]

    rng, rows, want = np.random.default_rng(3), [], {}
    for conv in range(30):
        above = {}
        for turn in range(12):
            up = int(rng.integers(turn)) if turn and rng.random() < 0.6 else None
            rows.append((conv, turn, "user", (f"> This is the text number {conv} {up} of the talk.\n" if up is not None else "") + f"This is the text number {conv} {turn} of the talk."))
            if turn:
                above[turn] = turn - 1 if up is None else up
        want |= {(conv, t): i for i, t in enumerate(walk(0))}
    rows += [(99, 0, "a", "First message of them all."), (99, 1, "b", "Second message, about budgets."), (99, 2, "a", "> First message of them all.\nBranch."), (99, 3, "b", "> Second message, about budgets.\nBack to the second.")]
    want |= {(99, 0): 0, (99, 1): 1, (99, 3): 2, (99, 2): 3}
    out = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.position for r in out} == want
    assert {r.turn: r.thread for r in out if r.conv_id == 99} == {0: 0, 1: 0, 3: 0, 2: 2}


def test_parts_of_messages_are_linked(spark):
    long = "The budget for the coming year was agreed on Monday by everyone. The rest, such as travel and the new office in the north, is still open. Please write to me."
    rows = [(1, 0, "a", long), (1, 1, "b", "Yes, agreed."), (1, 2, "c", "Something that is not quoted by anyone here.")]
    quotes = {3: ("> The rest, such as travel and the new office in the north, is still open.", 0), 4: ("> The rest, such as travel\n> and the new office in\n> the north, is still open. Please write to\n> me.", 0), 5: ("> > The budget for the coming year was agreed on Monday by everyone.\n> A line that nobody wrote in this talk at all.", 0), 6: ("> Yes, agreed", 1), 7: ("> year was agreed on Monday by everyone. The rest, such as travel", 0), 8: ("> This was never said by anybody in here.", None)}
    rows += [(1, t, "d", f"{q}\n\nReply {t}.") for t, (q, _) in quotes.items()] + [(2, 0, "a", "x"), (2, 1, "b", "> Yes, agreed\nOther talk.")]
    got = {(r.conv_id, r.turn): r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: got[1, t].reply_to if got[1, t].linked else None for t in quotes} == {t: origin for t, (_, origin) in quotes.items()}
    assert not got[2, 1].linked and got[1, 8].reply_to == 7


@pytest.mark.parametrize("seed", range(4))
def test_only_found_passages_go(spark, seed):
    """Prompts, code, block quotes of unknown origin and real quotes, mixed: every line is in the text or in a passage of an earlier message."""
    import random

    rnd = random.Random(seed)
    said = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + str(rnd.randrange(1000)) for _ in range(8))
    rows, expected = [], {}
    for c in range(6):
        spoken: list[str] = []
        for t in range(9):
            lines, keep, own = [], [], said()
            for _ in range(rnd.randrange(1, 6)):
                kind = rnd.choice(["own", "prompt", "block", "fence", "quote"])
                if kind == "quote" and spoken:
                    lines += ["On Monday, Ann wrote:", "> " + rnd.choice(spoken)]
                else:
                    more = {"own": [said()], "quote": [said()], "prompt": [">>> import " + said()], "block": ["> " + said(), "> " + said()], "fence": ["```", "> " + (spoken[0] if spoken else said()), "```"]}[kind]
                    lines += more
                    keep += more
                lines.append(said())  # so that no two runs of quotes meet
                keep.append(lines[-1])
            lines.append(own)
            keep.append(own)
            spoken.append(own)
            rows.append((c, t, "x", "\n".join(lines)))
            expected[c, t] = "\n".join(keep)
    out = chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.text for r in out} == expected
    assert any(r.linked for r in out) and any(r.quote_levels == 3 for r in out)


LONG = "A sentence of the article that is long enough to be text and not a menu, with several words more."


@pytest.mark.parametrize("part", ['<h2 id="related-work">Related work in the field</h2>', '<section id="search-results"><p>{0}</p></section>', '<div class="legal-notice"><p>{0}</p></div>', '<blockquote class="review-share"><p>{0}</p></blockquote>', '<h3 class="comments">Comments on the method</h3>'])
@pytest.mark.parametrize("wrapper", ["<article>{0}</article>", "<div>{0}</div>", '<div class="content with-sidebar"><article>{0}</article></div>', '<div id="page" class="no-comments">{0}</div>', '<div class="widget">{0}</div>'])
def test_names_lose_no_content(part, wrapper):
    body = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{part.format(LONG)}<p>{LONG}</p>"
    menus = '<nav><a href="x">Home</a></nav><div class="sidebar"><p><a href="y">Other page</a></p></div><div class="related-posts"><ul><li><a href="z">Some other post</a></li></ul></div>'
    text = html_extract.main_text(f"<html><body>{menus}{wrapper.format(body)}<div class='cookie-notice'><p>We use cookies</p></div></body></html>").split("\n")
    inner = html_extract.main_text(f"<body>{part.format(LONG)}</body>")
    assert text == ["Title", LONG, LONG, inner, LONG]


def test_named_furniture_goes():
    share = '<div class="post-share"><a href="a">Tweet this</a> <a href="b">Share this</a></div>'
    comments = f'<section id="comments"><p>{LONG}</p></section>'
    assert html_extract.main_text(f'<body><article><p>{LONG}</p><p>{LONG}</p>{share}{comments}<p>An <span class="ad">Buy</span> end.</p></article><div class="related"><article>Teaser of another page.</article></div></body>') == f"{LONG}\n{LONG}\nAn end."


def test_repeated_rows_take_no_places(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    ask = lambda table: sorted(map(tuple, ann.nearest(table, vectors.where("vec_id % 20 = 0")).collect()))
    once = ask(vectors)
    copies = vectors.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("vec_id") % 3 == 0, 25).otherwise(2)))).drop("copy")
    found = ask(copies)
    assert len(found) == len(once) == 20 * vectors.where("vec_id % 20 = 0").count()
    by = {}
    for q, rank, v, score in found:
        by.setdefault(q, []).append(v)
    assert all(len(set(x)) == 20 for x in by.values())
    assert len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in once}) >= 0.9 * len(once)


def test_best_row_of_an_id_stays():
    rng = np.random.default_rng(5)
    ids, rows, asked = rng.integers(0, 40, 400), rng.normal(size=(400, 4)), rng.normal(size=(3, 4))
    for i, at, scores in ann.best(np.array([7, 100, 101]), asked, ids, rows, 10):
        top = {}
        for v, s in zip(ids.tolist(), (rows * asked[i]).sum(axis=1).tolist()):
            top[v] = max(s, top.get(v, s))
        want = sorted(((-s, v) for v, s in top.items() if not (i == 0 and v == 7)))[:10]
        assert [(-s, v) for v, s in zip(ids[at].tolist(), scores.tolist())] == want


def test_pipeline_matches_rows_not_ids(spark):
    import corpus_pipeline

    a, b, c = ("One two three four five six seven eight nine ten eleven twelve " * 3 + x for x in ("end", "End now", "end of all"))
    clean, other = "Quite another text that shares nothing with the rest of them at all, at least none of its runs of words.", "Some lines which stand alone here and have no near copy in this table, whatever one looks for."
    rows = [(None, a), (None, a), (None, b), (7, clean), (8, a), (8, b), (8, clean + " x"), (7, other), (7, other), (9, other), (None, None), (None, None), (3, " ")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(out, key=str) == sorted([(7, clean), (8, min(a, b, key=lambda t: (8, t) not in out)), (7, other), (None, None), (None, None), (3, " ")], key=str)
    nameless = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs.where("doc_id IS NULL"), "").collect()]
    assert sorted(x[1] is None for x in nameless) == [False, True, True]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 10 and {r.lang for r in kept.collect()} == {"und"}


def test_short_sibling_articles_stay():
    posts = [LONG * 9, LONG]
    page = "<body>" + "".join(f"<article><p>{x}</p></article>" for x in posts) + "<article><a href='x'>Read this other post</a></article></body>"
    assert html_extract.main_text(page) == "\n".join(posts)


def clustered(spark, n, clusters, width=16, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(clusters, width))[rng.integers(clusters, size=n)] + 0.15 * rng.normal(size=(n, width))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    return data, spark.createDataFrame([(i, x) for i, x in enumerate(data.tolist())], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("rows_a_part,most_parts", [(100, 128), (60, 8)])
def test_few_leaves_answer_where_vectors_cluster(spark, monkeypatch, rows_a_part, most_parts):
    """One router, and two levels of them: recall of 0.9 at under half of the leaves."""
    monkeypatch.setattr(ann, "ROWS_A_PART", rows_a_part)
    monkeypatch.setattr(ann, "MOST_PARTS", most_parts)
    probes, leaves = [], []
    needed = ann.needed_leaves
    monkeypatch.setattr(ann, "needed_leaves", lambda tree, indexed, asked, k: leaves.append(indexed.select("part").distinct().count()) or probes.append(needed(tree, indexed, asked, k)) or probes[-1])
    data, vectors = clustered(spark, 3000, 60)
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    by, hits = {}, 0
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q, own in by.items():
        near = data @ data[q]
        near[q] = -9
        hits += len(own & set(np.argsort(-near)[:20].tolist()))
    assert len(by) == 150 and all(len(x) == 20 for x in by.values())
    assert hits / 3000 >= 0.9 and probes[0] < leaves[0] / 2 and leaves[0] > 20


def test_other_lengths_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_PART", 10)
    monkeypatch.setattr(ann, "needed_leaves", lambda *_: 1)
    data, vectors = clustered(spark, 300, 100)
    short = spark.createDataFrame([(1000 + 20 * i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    found = ann.nearest(vectors.unionByName(short), vectors.unionByName(short).where("vec_id % 20 = 0")).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(by) == 45 and all(len(x) == 20 for x in by.values())
    assert sorted(by[1040])[:2] == [(1, 1580, 59.0), (2, 1560, 57.0)]


def div_page(extra=""):
    """A page without article tags: menus and notes in plain elements around the text."""
    links = "".join(f"<div><a href='{i}'>Link {i}</a></div>" for i in range(12))
    body = "".join(f"<p>{LONG} {LONG}</p>" for _ in range(6))
    notes = "".join(f"<div><span>Note</span> <b>{i}</b></div>" for i in range(60))
    return f"<html><body><div>{links}</div>{extra}<div><h1>Title</h1>{body}<p>End.</p></div><div>{notes}</div></body></html>", f"Title\n{chr(10).join([LONG + ' ' + LONG] * 6)}\nEnd."


def test_the_threshold_chooses_the_region(monkeypatch):
    page, want = div_page()
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "threshold", lambda ratios: -1.0)
    off = html_extract.main_text(page)
    assert off != want and "Note" in off


def test_the_threshold_drops_menus_in_articles(monkeypatch):
    menu = "".join(f"<li><a href='{i}'>Link {i}</a></li>" for i in range(8))
    one = "<p><a href='s'>The source of it</a></p>"
    page = f"<body><article><h1>Title</h1>{one}<p>{LONG} {LONG}</p><p>{LONG} {LONG}</p><ul>{menu}</ul><p>{LONG} {LONG}</p></article></body>"
    text = html_extract.main_text(page)
    assert "Link 3" not in text and "The source of it" in text and text.count(LONG) == 6
    monkeypatch.setattr(html_extract, "threshold", lambda ratios: -1.0)
    assert "Link 3" in html_extract.main_text(page)


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "has-comments", "post-header", "search-results", "tags-page", "footer-light", "related", "widget"])
def test_named_wrappers_keep_the_article(name):
    for tag in ("article", "div"):
        text = html_extract.main_text(f'<body><div class="{name}"><{tag}><h1>T</h1><p>{LONG}</p><p>{LONG}</p></{tag}></div><div class="ad">Buy</div></body>')
        assert text == f"T\n{LONG}\n{LONG}"


@pytest.mark.parametrize("made", [lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<p>a</p><!-- " + "<b>x " * n, lambda n: "<i>" * n + "x</b>" * n, lambda n: '<a href="x' * n, lambda n: "<article>" * n + "x", lambda n: "<div class=ad>" * n + "x" + "</div>" * n, lambda n: "<div class=ad>y</div><p>xx x</p>" * n])
def test_time_grows_with_the_page(made):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.main_text(made(n))
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(5_000), 0.02)


def test_what_the_end_leaves_open_is_no_text():
    assert html_extract.main_text("<p>a</p><!-- b <p>c</p>") == "a" and html_extract.main_text("<p>a < 3 b</p><p>x <b") == "a < 3 b\nx"
    assert html_extract.main_text("<script><!-- x</script><p>a</p>") == "a"


def test_each_stage_equals_brute_force(spark, tmp_path):
    """Every stage against a plain version, on its own input."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from filingscope.llm.langid import fit
    from filingscope.llm.langid import spans as language_spans
    from filingscope.llm.queries import _tokenizer
    from tests.llm.test_documents import brute_components

    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", "z", 0), (90_002, "123 !", None, None, 5), (90_003, "Ends ALIKE here.", "en", "a", 16), (90_004, "ends alike here.", "en", "a", 16), (90_004, "ends alike here.", "en", "a", 16), (90_004, "another text with this id", "en", "b", 25)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*odd.columns).unionByName(odd)
    docs.write.parquet(str(tmp_path / "0"))
    read = lambda i: spark.read.parquet(str(tmp_path / str(i)))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read(i), DATA).write.parquet(str(tmp_path / str(i + 1)))
    tables = [[tuple(r) for r in read(i).collect()] for i in range(6)]
    ordered = lambda rows: sorted(rows, key=str)

    model, want = fit(read(0)), []
    for d, t, lang, src, n in tables[0]:
        letters = {}
        for a, b, label in language_spans(model, t):
            letters[label] = letters.get(label, 0) + sum(c.isalpha() for c in t[a:b])
        if letters:
            want.append((d, t, min(letters, key=lambda x: (-letters[x], x)), src, n))
    assert ordered(tables[1]) == ordered(want)

    last = {}
    for r in tables[1]:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        if key not in last or (r[0] is not None and (last[key][0] is None or r[0] >= last[key][0])):
            last[key] = r
    assert ordered(tables[2]) == ordered(last.values())

    rows = sorted(tables[2], key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    kept = [rows[i] for i, n, c in brute_components([(i, r[1]) for i, r in enumerate(rows)], 5, 80) if i == c]
    assert ordered(tables[3]) == ordered(kept) and len(kept) < len(rows)

    whole = {(r[0], r[3]): r for r in tables[3]}
    assert len(whole) == len(tables[3])
    taken, sizes = {}, {}
    for d, t, lang, src, n in tables[4]:
        own = whole[d, src]
        assert t in own[1] and (lang, src, n) == (own[2], own[3], len(t))
        taken[src] = taken.get(src, 0) + len(t.split())
    for r in tables[3]:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.03)

    encode = Tokenizer.from_file(_tokenizer()).encode
    ids = sum(len(encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in tables[4])
    bins = {}
    for _, _, _, length, _, b, at in tables[5]:
        bins.setdefault(b, []).append((at, length))
    assert sum(n for own in bins.values() for _, n in own) == ids and max(sum(n for _, n in own) for own in bins.values()) <= 2048


@pytest.mark.parametrize("seed", range(8))
def test_pages_of_known_text(seed):
    """Pages made from their main text: furniture of several kinds around it, markup and references inside it."""
    import html as escape
    import random

    rnd = random.Random(seed)
    words = lambda n: " ".join(rnd.choices("alpha beta gamma <delta> & epsilon zeta’s ётa".split(), k=n))
    blocks = ["Title of " + words(3), *(words(rnd.randrange(25, 90)) for _ in range(rnd.randrange(4, 12)))]
    inner = [f"<h1>{escape.escape(blocks[0])}</h1>"]
    for b in blocks[1:]:
        marked = " ".join(f"<em>{escape.escape(w)}</em>" if rnd.random() < 0.1 else escape.escape(w) for w in b.split())
        inner.append(rnd.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(marked))
        inner.append(rnd.choice(["", "<div class='advert'>Buy it now</div>", "<script>x('</p>')</script>", "<form><input><p>Name</p></form>"]))
    around = [f"<nav>{''.join(f'<a href=x>{w}</a> ' for w in 'Home News About'.split())}</nav>", "<header><p>Site name</p></header>", "<div class='cookie-notice'><p>We use cookies.</p></div>", "<aside><p>More of it</p></aside>"]
    wrap = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<div id='text'>{}</div>"])
    page = f"<html><head><title>x</title></head><body>{''.join(rnd.sample(around, 3))}{wrap.format(''.join(inner))}<section class='comments'><p>{words(30).replace('<', '')}</p></section><footer>foot</footer></body></html>"
    assert html_extract.main_text(page) == "\n".join(" ".join(b.split()) for b in blocks)


def test_one_huge_conversation(spark):
    n = 20_000
    text = F.when(F.col("turn") % 1000 == 999, F.concat(F.lit("> This is message number "), (F.col("turn") - 500).cast("string"), F.lit(" of a long talk.\nIndeed."))).when(F.col("turn") == 7, F.repeat(F.lit("word and word again. "), 50_000)).otherwise(F.concat(F.lit("This is message number "), F.col("turn").cast("string"), F.lit(" of a long talk.")))
    talk = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role")).withColumn("text", text)
    out = chat.link_quotes(talk)
    linked = out.where("linked").select("turn", "reply_to").collect()
    assert {(r.turn, r.reply_to) for r in linked} == {(t, t - 500) for t in range(999, n, 1000)}
    assert out.agg(F.count_distinct("position"), F.min("position"), F.max("position")).first() == (n, 0, n - 1)
