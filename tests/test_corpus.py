from pyspark.sql import functions as F

from deskbook.operators import chunking as C
from deskbook.operators import corpus


def test_sentences_are_packed_up_to_the_bound():
    body = "## Tea\n\n" + " ".join(f"Cup {i} is warm!" for i in range(300))
    chunks = C.chunk_text(body, "Kitchen", least=1, most=40)
    assert {tuple(p) for p, _ in chunks} == {("Kitchen", "Tea")} and max(C.tokens(t) for _, t in chunks) <= 40
    assert " ".join(t for _, t in chunks).split("! ") == body.split("\n\n")[1].split("! ")


def test_skipped_heading_levels_nest():
    paths = [p for p, _ in C.split_sections("## A\na\n#### B\nb\n#### C\nc\n## D\nd", "T")]
    assert paths == [["T", "A"], ["T", "A", "B"], ["T", "A", "B", "C"], ["T", "D"]]
    assert C.split_sections("# one\n##### two", "T") == [(["T"], "# one\n##### two")]


def test_small_chunks_join_backwards_across_sections():
    big = "x" * 900
    assert [p for p, _ in C.chunk_text(f"## A\n{big}\n## B\ntiny\n## C\n{big}", "T")] == [["T", "A"], ["T", "C"]]
    assert [t[:1] for _, t in C.chunk_text(f"## A\ntiny\n## B\n{big}", "T")] == ["t", "x"]


def test_code_fences_stay_whole():
    assert C.split_blocks("a\n\n```\nx\n\ny\n```\nb") == ["a", "```\nx\n\ny\n```", "b"]


def test_lists_split_by_item():
    block = "\n".join(f"- item {i} " + "w" * 60 for i in range(10))
    parts = C.split_oversized(block, 40)
    assert all(p.startswith("- item") for p in parts) and all(C.tokens(p) <= 40 for p in parts)


PAGE = """<html><head><title>Site</title><meta content="Turn a lamp on &amp; off" property="og:title"><meta property="article:modified_time" content="2023-05-06T07:08:09">
<meta name="keywords" content="lamp, light,, lamp"><meta name="description" content=" Lamps "></head><body>
<nav aria-label="Breadcrumbs"><ol><li><a href="/">Home</a></li><li><a href="/l">Lamps</a></li></ol></nav>
<article><h2>Switch</h2><p>Press &lt;on&gt;. <a href="files/plan.pdf?download=1">The plan</a> shows <b>more</b>.</p><ul><li>red<li>green</ul><pre>a = 1</pre>
<table><tr><th>Watt</th><td>5</td></tr></table><script>var x = "<p>no</p>";</script><div class="feedback x">Did this help?</div><p>""" + "A long line about lamps. " * 12 + """</p>
<h3>Related lamps</h3><ul><li><a href="/lamps/blue">Blue</a></li></ul><h3>End</h3><p>Bye</p></article></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame(
        [(1, "https://help.example.com/lamps/on?utm_source=x", PAGE), (1, "https://help.example.com/lamps/on?utm_source=x", PAGE), (2, "https://h/b", "<p>none</p>"), (3, "https://h/c", None), (4, None, PAGE), (5, "https://h/d", "<article>" + "word " * 141 + "</article>"), (6, "https://h/e", ""), (7, "https://h/f", "<" * 500 + "<a b='c <p x=\"" * 500)],
        "page_id long, url string, html string",
    )
    found = corpus.extract_articles(pages.repartition(3), least=200).collect()
    rows = {r.page_id: r for r in found}
    none = "No article body found"
    assert len(found) == 8 and {i: r.error for i, r in rows.items()} == {1: None, 2: none, 3: none, 4: None, 5: "Missing or empty title", 6: none, 7: none}
    assert {r.error for r in corpus.extract_articles(pages.where("page_id = 5"), least=900).collect()} == {"Extracted body too short"}
    made = rows[1]
    assert (made.title, made.updated_at, made.published_at, made.summary) == ("Turn a lamp on & off", "2023-05-06T07:08:09", None, "Lamps")
    assert made.tags == ["lamp", "light"] and made.breadcrumbs == ["Lamps"]
    assert [tuple(a) for a in made.attachments] == [("The plan", "https://help.example.com/lamps/files/plan.pdf?download=1")]
    assert [tuple(a) for a in made.related_links] == [("Blue", "https://help.example.com/lamps/blue")]
    assert made.url == "https://help.example.com/lamps/on" and made.source == "help" and made.doc_id.startswith("help-example:")
    body = made.body_markdown
    assert body.startswith("## Switch\n\nPress <on>. [The plan](https://help.example.com/lamps/files/plan.pdf?download=1) shows **more**.\n\n- red\n- green") and "```\na = 1\n```" in body and "- Watt: 5" in body
    assert body.endswith("### End\n\nBye") and not any(x in body for x in ("Blue", "var x", "Did this", "Home"))
    assert corpus.extract_articles(pages.limit(0)).count() == 0


def test_bodies_by_other_selectors_and_unclosed_elements(spark):
    text = "words of a page " * 40
    rows = [
        (1, f"<title>Page</title><main><p>{text}</main>"), (2, f"<title>Page</title></div></p><div><div class='own big'><p>{text}"), (3, f"<title>Page</title><form><article><p>{text}<p style='DISPLAY: NONE'>gone<p>kept</article></form>"),
        (4, f"<title>Page</title><article>{text}<div class='feedback'>gone<div>gone</div></div></div>kept</article>"), (5, f"<title>Page</title><article><h2>Related</h2><ul><li><a href='x'>X</a></li></ul></article><article>{text}</article>"),
        (6, "<title>Page</title>" + "<div>" * 400 + text + "</div>" * 300), (7, f"<title>Page</title><article title='a > b'>{text}<a href=\"q\">go<img alt='i' src='s.png'></a></article>"),
    ]
    df = spark.createDataFrame([(i, "https://h.example.com/a/b", x) for i, x in rows], "page_id long, url string, html string")
    said = {r.page_id: (r.error, r.body_markdown) for r in corpus.extract_articles(df).collect()}
    plain = text.strip()
    assert said[1] == said[2] == said[6] == (None, plain) and said[5] == (None, plain)
    assert said[3] == (None, f"{plain}\n\nkept") and said[4] == (None, f"{plain}\n\nkept") and said[7][1] == f"{plain} [go![i](s.png)](https://h.example.com/a/q)"
    own = {r.page_id: r.error for r in corpus.extract_articles(df, selectors=("main",), classes=("own",), removed=(), removed_classes=()).collect()}
    assert set(own.values()) == {None}


def test_body_scores(spark):
    words = "some words here " * 20
    html = f'<h1>Tea</h1><article><a href="x">{words}</a></article><main><h2>a</h2><ol></ol>{words} tea</main><section class="menu">{words}</section><section>short</section>'
    scores = lambda **other: [r.score for r in corpus.body_candidates(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), **other).orderBy("node").collect()]
    n = len(words.strip())
    assert scores() == [n / 100 - 50]
    assert scores(selectors=("article", "main", "section")) == [n / 100 - 50, (n + 6) / 100 + 5 + 3 + 10, n / 100 - 20, 0.0]
    assert len(scores(selectors=("table",))) == 4  # none on the page: all that could be


def test_merge_is_idempotent(spark):
    scraped = spark.createDataFrame([("d1", "u1", "new", None), ("d2", "u2", None, "auth_required")], "doc_id string, url string, content_hash string, error string")
    cache = spark.createDataFrame([("u1", "old")], "url string, content_hash string")
    empty = spark.createDataFrame([], "doc_id string, url string, content_hash string")
    merged, outcomes = corpus.merge_articles(empty, scraped, cache)
    assert [tuple(r) for r in merged.collect()] == [("d1", "u1", "new")]
    counts = corpus.scrape_manifest(outcomes).first()
    assert (counts.total, counts.success, counts.failed, counts.updated, counts.auth_required) == (2, 1, 1, 1, 1)
    again, second = corpus.merge_articles(merged, scraped, spark.createDataFrame([("u1", "new")], "url string, content_hash string"))
    assert second.where("outcome = 'unchanged'").count() == 1 and again.collect() == merged.collect()


def test_cache_upsert_never_clears(spark):
    cache = spark.createDataFrame([("u", "failed once")], "url string, error string")
    updates = spark.createDataFrame([("u", None), ("v", "x")], "url string, error string")
    assert {tuple(r) for r in corpus.upsert_cache(cache, updates).collect()} == {("u", "failed once"), ("v", "x")}


def test_resume_fetches_when_the_article_is_missing(spark):
    cache = spark.createDataFrame([("u", "d", "success")], "url string, doc_id string, status string")
    urls, none = spark.createDataFrame([("u",)], "url string"), spark.createDataFrame([], "doc_id string")
    assert corpus.plan_fetch(urls, cache, none).first()[1:] == ("fetch", False)
    assert corpus.plan_fetch(urls, cache, cache.select("doc_id")).first()[1:] == ("skip", True)
    assert corpus.plan_fetch(urls, cache, cache.select("doc_id"), resume=False).first()[1:] == ("fetch", True)


def test_blocked(spark):
    rows = [("<p>Access  Denied</p>",), ("<script>captcha</script>I'm not a robot",), ("captcha: I'm not a robot",), ("<style>forbidden</style>ok",)]
    assert [r[0] for r in spark.createDataFrame(rows, "h string").select(corpus.is_blocked(F.col("h"))).collect()] == [True, False, True, False]
