"""Pages -> articles -> incremental merge, with the crawl's bookkeeping."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..sources.schemas import CACHE
from ..sources.scratch import cut
from . import pages as P

# What pages say that keep a crawler out.
BLOCKED = ("access denied", "forbidden", "blocked", "verify you are human")


def visible_text(html: Column) -> Column:
    c = F.lower(html)
    for pattern in (r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", r"(?is)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    return F.regexp_replace(c, r"\s+", " ")


def is_blocked(html: Column) -> Column:
    text = visible_text(html)
    out = text.contains("captcha") & text.contains("i'm not a robot")
    for phrase in BLOCKED:
        out = out | text.contains(phrase)
    return out


def known_id(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"\bka[0-9A-Za-z]{13,18}\b", 0), F.lit(""))


def doc_prefix(host: Column) -> Column:
    short = F.translate(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.com$", ""), ".", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(short, "[^a-z0-9-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("source"))


def stable_doc_id(host: Column, html: Column, url: Column) -> Column:
    """``prefix:id`` with the id that the page carries, else the digest of its address."""
    return F.concat_ws(":", doc_prefix(host), F.coalesce(known_id(html), F.sha2(url, 256)))


def source_key(host: Column, own_suffix: str, sources: dict[str, str] | None = None) -> Column:
    out = F.when(host.endswith(own_suffix), F.substring_index(host, ".", 1)).when(host == "", "unknown").otherwise(host)
    for known, key in (sources or {}).items():
        out = F.when(host == known, key).otherwise(out)
    return out


def content_hash(title: Column, updated_at: Column, markdown: Column) -> Column:
    return F.sha2(F.concat_ws("|", title, F.coalesce(updated_at, F.lit("")), markdown), 256)


def _seen(pages: DataFrame) -> DataFrame:
    """Pages with their final address and title, keyed and dealt for ``operators.pages``."""
    html = F.translate(F.coalesce("html", F.lit("")), "".join(P.MARKS), "")
    own = P.keyed(pages.select("page_id", F.coalesce("url", F.lit("")).alias("base"), html.alias("html")))
    canonical = H.some(f"regexp_extract(html, {H.lit('(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"')}, 1)")
    own = P.having(own, canonical=canonical, title=H.title("html"))
    own = P.having(own, url=f"if(canonical is null, base, {H.resolved('canonical', 'base')})")
    return own.withColumn("url", U.normalize_url("url")).drop("canonical")


def body_candidates(pages: DataFrame, selectors=P.BODIES, classes=P.BODY_CLASSES) -> DataFrame:
    """``page_id, node, score`` of each element that could be the body, numbered in order from 0; repeated rows count once."""
    found = P.scored(P.matched(P.tag_events(_seen(pages).dropDuplicates(["r"]), classes), selectors, classes)).where("score is not null")
    return found.selectExpr("page_id", "row_number() over (partition by r order by i) - 1 as node", "score")


def extract_articles(
    pages: DataFrame, least: int = 500, own_suffix: str = ".example.com", sources: dict[str, str] | None = None, selectors=P.BODIES, classes=P.BODY_CLASSES, removed=P.REMOVED, removed_classes=P.REMOVED_CLASSES
) -> DataFrame:
    """A full article or an ``error`` for each page (``page_id, url, html``).

    The body is the best-scored element; related links leave it, and so do boilerplate and hidden elements. Pages without
    any body, with fewer than ``least`` characters of plain text in it or with a title below three are errors, in this
    order. Null pages are empty; repeated rows are read apart; an empty table gives no rows. Pages are shuffled once.
    """
    seen = _seen(pages)
    fields = P.having(seen, dates=H.dates("html"), breadcrumbs=H.breadcrumbs("html"), tags=H.tags("html"), summary=H.meta("html", "name", "description")).withColumn("source_host", U.netloc_of("url"))
    fields = fields.withColumns({"doc_id": stable_doc_id(F.col("source_host"), F.col("html"), F.col("url")), "source": source_key(F.col("source_host"), own_suffix, sources)}).drop("html")
    found = P.bodies(seen.select("r", "page_id", "url", "title", "html"), selectors, classes, removed, removed_classes).withColumnRenamed("markdown", "body_markdown").withColumn("body_text", T.strip_markdown("body_markdown"))
    error = f"case when body_markdown is null then 'No article body found' when length(body_text) < {least} then 'Extracted body too short' when length(title) < 3 then 'Missing or empty title' end"
    attached = " or ".join(f"contains(x.href, {H.lit(t)})" for t in H.ATTACHMENT)
    linked = lambda fine, name, other: f"transform(filter(links, x -> {fine}), x -> struct(if(x.label = '', {other}, x.label) as {name}, {H.resolved('x.href', 'base')} as url))"
    made = P.having(
        fields.join(found, "r", "left"), error=error, updated_at="dates[0]", published_at="dates[1]", attachments=linked(f"x.mark = 'K' and ({attached})", "name", "substring_index(x.href, '/', -1)"), related_links=linked("x.mark = 'R'", "label", "x.href"),
    )
    made = made.withColumn("content_hash", content_hash(F.col("title"), F.col("updated_at"), F.col("body_markdown")))
    names = ("doc_id", "title", "updated_at", "published_at", "breadcrumbs", "tags", "summary", "body_markdown", "body_text", "attachments", "related_links", "source", "source_host", "content_hash")
    return made.selectExpr("page_id", "url", *(f"if(error is null, {n}, null) as {n}" for n in names), "error")


def merge_articles(existing: DataFrame, scraped: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(articles, outcomes)``: the corpus after a crawl, and what became of each scraped row.

    A row whose hash the cache knows for its address is unchanged and keeps the stored article (or goes in if there is
    none); others replace the article of their document, ``updated`` if the address had another hash, else ``new``; failed
    rows change nothing. Of several rows for a document the last address in order wins. Hashes alone are joined; bodies
    come along once, from the winning side. Articles carry the columns that both sides have.
    """
    known = cache.select("url", F.col("content_hash").alias("old_hash"))
    stored = existing.select("doc_id").distinct().withColumn("stored", F.lit(True))
    rows = scraped.join(known, "url", "left").join(stored, "doc_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("old_hash") == F.col("content_hash"), "unchanged").when(F.col("old_hash").isNotNull(), "updated").otherwise("new")
    outcomes = rows.withColumn("outcome", outcome).withColumn("written", (F.col("outcome").isin("updated", "new")) | ((F.col("outcome") == "unchanged") & ~F.col("stored")))
    winner = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("url").desc()))
    shared = [c for c in existing.columns if c in scraped.columns]
    fresh = outcomes.where("written").withColumn("r_", winner).where("r_ = 1").select(shared)
    return existing.select(shared).join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh), outcomes


#: Buckets of a stored corpus; part of its layout, so the same for all that write to one path.
BUCKETS = 64


def stored_articles(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """The articles stored at ``path`` with their ``bucket``, in ``columns``' schema; none where nothing is stored yet."""
    schema = StructType([*columns.drop("bucket").schema.fields, StructField("bucket", IntegerType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_into(path: str, scraped: DataFrame, cache: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``merge_articles`` into the corpus stored at ``path``; the outcomes, with ``bucket``.

    Articles lie in buckets by hashed document id, a folder each. Only the buckets of scraped documents are read, and only
    those in which something changes are written, each replaced as a whole, so a crawl of a hundredth of the documents
    leaves most of a corpus of enough buckets alone, and one that finds nothing new writes nothing. The merged rows are
    written to the shared folder first; a run that failed while replacing buckets is simply run again with the same cache.
    """
    spark = scraped.sparkSession
    rows = cut(scraped.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "scraped")
    among = lambda df, of: df.where(F.col("bucket").isin(*of)) if of else df.limit(0)
    numbers = lambda df: sorted(r.bucket for r in df.select("bucket").distinct().collect())  # noqa: E731  BUCKETS at most
    existing = among(stored_articles(spark, path, rows.drop("error")), numbers(rows.where("error is null")))
    merged, outcomes = merge_articles(existing, rows, cache)
    outcomes = cut(outcomes.select("url", "doc_id", "content_hash", "error", "bucket", "outcome", "written"), "outcomes")
    changed = numbers(outcomes.where("written"))
    if changed:
        fresh = cut(among(merged, changed).repartition("bucket"), "merged")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return outcomes


def scrape_manifest(outcomes: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row of counters over a merge's outcomes; ``unchanged`` rows count as skipped as well, never as success."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.agg(
        F.count("*").alias("total"), is_("new", "updated").alias("success"), is_("failed").alias("failed"), is_("unchanged").alias("skipped"), is_("updated").alias("updated"), is_("unchanged").alias("unchanged"),
        F.count_if(F.col("error") == "auth_required").alias("auth_required"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.lit(seconds).cast("double").alias("duration_seconds"),
    )


def chunk_manifest(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Articles, chunks, and mean and largest tokens (0 without chunks); missing estimates are made from the text."""
    tokens = F.coalesce("tokens_estimate", T.estimate_tokens("text"))
    own = chunks.agg(F.count("*").alias("chunks_written"), F.round(F.coalesce(F.avg(tokens), F.lit(0.0)), 6).alias("avg_tokens"), F.coalesce(F.max(tokens), F.lit(0)).alias("max_tokens"))
    return articles.agg(F.count("*").alias("articles_written")).crossJoin(F.broadcast(own)).select("articles_written", "chunks_written", F.struct(F.col("avg_tokens").alias("avg"), F.col("max_tokens").alias("max")).alias("chunk_tokens"))


def upsert_cache(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """New values where there are any, else the old ones, by address: a null never clears."""
    names = [c.split()[0] for c in CACHE.split(", ") if c.split()[0] in cache.columns and c.split()[0] != "url"]
    new = updates.select("url", *[(F.col(c) if c in updates.columns else F.lit(None)).alias(f"{c}_new") for c in names])
    return cache.select("url", *names).join(new, "url", "full_outer").select("url", *[F.coalesce(f"{c}_new", c).alias(c) for c in names])


def plan_fetch(urls: DataFrame, cache: DataFrame, articles: DataFrame, resume: bool = True) -> DataFrame:
    """``url, action, conditional``: resuming skips what succeeded and still has its article; conditional requests need one too."""
    stored = articles.select("doc_id").distinct().withColumn("stored", F.lit(True))
    rows = urls.select("url").distinct().join(cache.select("url", "doc_id", "status"), "url", "left").join(stored, "doc_id", "left")
    there = F.coalesce("stored", F.lit(False))
    skip = F.lit(resume) & (F.col("status") == "success") & there
    return rows.select("url", F.when(skip, "skip").otherwise("fetch").alias("action"), (there & F.col("status").isNotNull()).alias("conditional"))


def error_breakdown(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome", "error").agg(F.count("*").alias("n"))


def validate_articles(articles: DataFrame) -> DataFrame:
    """``doc_id, level, message`` for missing fields (errors) and bodies under ten characters (warnings)."""
    missing = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.struct(F.lit("error").alias("level"), F.lit(f"missing {c}").alias("message"))) for c in ("doc_id", "url", "title", "body_markdown")]
    short = F.when((F.length("body_markdown") > 0) & (F.length("body_markdown") < 10), F.struct(F.lit("warning").alias("level"), F.lit("body is very short").alias("message")))
    found = articles.select("doc_id", F.explode(F.filter(F.array(*missing, short), lambda m: m.isNotNull())).alias("m"))
    return found.select("doc_id", "m.level", "m.message")


def spot_check(articles: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """``k`` articles in the order of their ids' digests, with chunk counts and 300 characters."""
    picked = articles.orderBy(F.sha2("doc_id", 256)).limit(k)
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return picked.join(counts, "doc_id", "left").select("doc_id", "title", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.substring("body_markdown", 1, 300).alias("preview"))


def coverage_warning(urls: DataFrame, least: int = 350) -> DataFrame:
    return urls.agg(F.count("*").alias("n_urls")).withColumn("low_coverage", F.col("n_urls") < least)
