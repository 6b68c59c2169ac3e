from deskbook.operators import discovery
from deskbook.sources import jsonl
from deskbook.sources.schemas import CHUNK, CRAWL_ERROR


def test_jsonl(spark, tmp_path):
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), CRAWL_ERROR).count() == 0
    path = tmp_path / "chunks.jsonl"
    path.write_text('{"chunk_id":"a#0","url":"u","title":"t","text":"é"}\n\nnot json\n{"chunk_id":"b#0","url":"u","title":"","text":"x"}\n', encoding="utf-8")
    assert [r.text for r in jsonl.read_chunks(spark, str(path)).collect()] == ["é"]
    assert jsonl.read_catalogue_chunks(spark, str(path)).count() == 0
    assert jsonl.read_chunks(spark, str(tmp_path / "none")).columns == spark.createDataFrame([], CHUNK).columns


def test_errors_append_on_resume(spark, tmp_path):
    rows = spark.createDataFrame([("u", "auth_required", "now"), ("v", None, "now")], CRAWL_ERROR)
    for resume, n in ((False, 1), (True, 2), (False, 1)):
        jsonl.write_errors(rows, str(tmp_path / "errors"), resume)
        assert jsonl.read_jsonl(spark, str(tmp_path / "errors"), CRAWL_ERROR).count() == n


def test_url_documents(spark, tmp_path):
    (tmp_path / "urls.json").write_text('{\n "count": 2,\n "urls": ["b", "a"]\n}')
    urls = jsonl.read_url_document(spark, str(tmp_path / "urls.json"))
    assert {r.url for r in urls.collect()} == {"a", "b"}
    assert jsonl.url_document(urls).first().asDict() == {"count": 2, "urls": ["a", "b"]}


def test_malformed_sitemaps_have_no_rows(spark):
    maps = spark.createDataFrame([("s", "<urlset><loc>x"), ("t", "<urlset><url><loc> y </loc></url></urlset>"), ("n", None)], "url string, xml string")
    assert [(r.sitemap, r.kind, r["loc"]) for r in discovery.sitemap_entries(maps).collect()] == [("t", "urls", "y")]


def test_crawl_is_bounded(spark):
    pages = spark.createDataFrame([(i, f"https://h/c/{i}", f'<a href="/c/{i + 1}">n</a><a href="/d/{i}?utm_x=1#f">a</a><a href="mailto:x@h">m</a>') for i in range(10)], "page_id long, url string, html string")
    roots = spark.createDataFrame([("https://h/c/0",)], "url string")
    got = {r.url: r.level for r in discovery.crawl(pages, roots, "https://h/", ("/d/",), max_pages=4).collect()}
    assert got == {f"https://h/d/{i}": i for i in range(4)}
    assert {r.url for r in discovery.discover(pages, roots, "https://h/", ("/d/",)).collect()} >= {"https://h/d/9"}
