from pyspark.sql import functions as F

from deskbook.functions import text as T
from deskbook.functions import urls as U
from deskbook.functions.urls import normalize_url_one


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr.alias("o")).first()[0]


def test_token_estimates(spark):
    for value, corpus, service in (("", 0, 0), ("  ", 1, 0), ("abc", 1, 1), ("abcde", 1, 2), ("a" * 8, 2, 2)):
        assert one(spark, T.estimate_tokens("c"), value) == corpus
        assert one(spark, T.estimate_service_tokens("c"), value) == service


def test_tokens_by_compatibility_decomposition(spark):
    import re
    import unicodedata

    texts = ["ő ž ﬁx ａｂｃ １２ ①② ½ ⑩x", "Ｌｏｇｉｎ ﬂow ẛ̣ ℡ Ⅷ", "naïve ŉa Ǆ x² ㎏ K", "日本 ㈱ éé"]
    for text in texts:
        plain = re.sub(r"[^a-z0-9\s]", " ", unicodedata.normalize("NFKD", text.lower()))
        assert one(spark, T.tokenize("c"), text) == [w for w in plain.split() if len(w) > 1 and w not in T.STOPWORDS]


def test_tokens_split_marks_off(spark):
    assert one(spark, T.tokenize("c"), "How étion the Straße™ of LOGIN-page") == ["tion", "stra", "login", "page"]


def test_markdown(spark):
    assert one(spark, T.strip_markdown("c"), "## Head\n\n- a [link](http://x) and `code`\n1. two\n\n\n\n```\nx\n```\n![i](u)") == "Head\na link and code\ntwo"


def test_trailing_sources(spark):
    strip = lambda v: one(spark, T.strip_trailing_sources("c"), v)
    assert strip("Body text.\n\nSources:\n[1] https://a.example.com\n- https://b.example.com\n") == "Body text."
    assert strip("Body\n\nSources\nnot an address") == "Body\n\nSources\nnot an address"
    assert strip("Sources\n\n") == "Sources\n\n"
    assert strip("Sources of power are many.\n[1] https://a.example.com") == "Sources of power are many.\n[1] https://a.example.com"
    assert strip("\n \n") == ""
    assert strip("a\nSources\n\n" + "\n" * 100_000) == "a\nSources\n\n" + "\n" * 100_000
    assert strip("a\nSources:" + "\n[1] https://a.example.com" * 100_000) == "a" and strip("Sources\r\n1. https://a.example.com") == ""
    assert strip("x" + "\n" * 100_000 + "y") == "x" + "\n" * 100_000 + "y"


def test_citation_spacing_and_lists(spark):
    assert one(spark, T.space_citations("c"), "x [1][6] y [2][3][4]") == "x [1] [6] y [2] [3] [4]"
    join = lambda v: one(spark, T.join_list_continuations("c"), v)
    assert join("- one\n   more\n   - nested\ntext\n   kept") == "- one more\n   - nested\ntext\n   kept"
    assert join("```\n- one\n   code\n```") == "```\n- one\n   code\n```"
    assert join("1. a  \n  b\n  c") == "1. a b c" and join("") == ""
    assert join("- a\n  b\n" * 20_000) == "- a b\n" * 20_000


def test_titles_and_masks(spark):
    assert one(spark, T.thread_title("c"), "  a \n b ") == "a b"
    assert one(spark, T.thread_title("c"), " ") == "New thread"
    assert one(spark, T.thread_title("c"), "x" * 80) == "x" * 69 + "..."
    assert one(spark, T.mask_secret("c"), "sk-1234567890") == "********7890"
    assert one(spark, T.mask_secret("c"), "abcd") == "********"


def test_audit_tokens(spark):
    assert one(spark, T.safe_token("c", "redacted"), "sk-live-secret-target") == "redacted"
    assert one(spark, T.safe_token("c", None), "Bearer secret") is None
    assert one(spark, T.safe_token("c", None), " req-1 ") == "req-1"
    assert one(spark, T.safe_reason("c"), "sk-live-should-be-redacted") == "redacted_reason"
    assert one(spark, T.safe_reason("c"), None) is None


def test_urls(spark):
    cases = {"https://A.example.com/x/?utm_source=a&b=1&c#top": "https://A.example.com/x?b=1&c=", "HTTP://h/": "http://h/", "h.example.com": "https://h.example.com/", "https://h/p//": "https://h/p/", "https://h?gclid=1": "https://h/"}
    for url, want in cases.items():
        assert one(spark, U.normalize_url("c"), url) == want
        assert normalize_url_one(url) == want
    assert normalize_url_one("../b?q=a%20b", "https://h/x/y/") == "https://h/x/b?q=a+b"
    assert one(spark, U.host_of("c"), "https://user@H.example.com:80/x") == "h.example.com"
    assert one(spark, U.same_domain("c", F.lit("https://h:1/")), "https://H:1/x") is True
