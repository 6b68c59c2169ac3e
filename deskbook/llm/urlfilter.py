"""URL filters by a temporal list join, in DataFrame operations only.

Dated list edits (an entry added to or removed from a list on a day) become validity intervals. A capture is looked up
under every key that could name it (its exact address, its first path segment, its host and the host's parent domains)
and an as-of condition keeps the entries that were active when it was fetched. The most specific active entry decides;
between equally specific ones a blocking entry beats an allowing one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*(\?[^#]+)"
#: Hosts that are addresses of machines and so have no parents.
NUMERIC = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"
QUERY_RANK, EXACT_RANK, SEGMENT_RANK = 1001, 1000, 900


def url_host(url):
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url):
    """Array of ``{rank, key}`` of an address, the most specific first.

    The address with its query string, where it has one; the address without it (the root as ``host/``, others without a
    slash at their end); the host with the first path segment, where that is not the address; the host and its parent domains of two labels or more,
    ranked by labels. Hosts of one label and numeric addresses have no parents. Fragments, ports and users don't count.
    """
    host, path, query = url_host(url), F.regexp_extract(url, PATH, 1), F.regexp_extract(url, QUERY, 1)
    page, segment, labels = F.concat(host, F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))), F.regexp_extract(path, "^(/[^/]+)", 1), F.split(url_host(url), r"\.")
    key = lambda rank, k: F.struct((F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"), k.alias("key"))
    some = lambda condition, *keys: F.when(condition, F.array(*keys)).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: key(F.size(labels) - i + 1, F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    hosts = F.when(host.rlike(NUMERIC), F.array(key(4, host))).otherwise(parents)
    keys = F.concat(some(query != "", key(QUERY_RANK, F.concat(page, query))), F.array(key(EXACT_RANK, page)), some((segment != "") & (F.concat(host, segment) != page), key(SEGMENT_RANK, F.concat(host, segment))), hosts)
    return F.when(host != "", keys).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))


def validity_intervals(edits: DataFrame) -> DataFrame:
    """``list, effect, key, action, day`` -> ``list, effect, key, valid_from, valid_to`` (null: still valid).

    An ``add`` holds until the key's next edit on the same list; of edits on one day a removal comes last, so an entry
    added and removed on a day is never valid. Repeated edits count once, edits with a null key, list or day are ignored,
    and a removal without an addition has no effect. Per key and list the window sees a row a day and action at most.
    """
    own = edits.select("list", "effect", "key", "action", "day").where("list is not null and key is not null and day is not null and action in ('add', 'remove')").distinct()
    following = F.lead("day").over(Window.partitionBy("list", "effect", "key").orderBy("day", "action"))
    spans = own.withColumn("valid_to", following).where("action = 'add' and (valid_to is null or valid_to > day)")
    return spans.select("list", "effect", "key", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, edits: DataFrame) -> DataFrame:
    """``page_id, url, fetched`` x list edits -> one row a capture with the verdict as of its fetch.

    ``page_id, fetched, host, n_active`` (entries active for it), ``verdict`` (``block``, ``allow`` or ``none``),
    ``matched_key`` and ``matched_lists`` (of the entries that decided, sorted). Only addresses and days travel, never pages'
    bodies. The join is an equi-join on the key with the as-of condition beside it; a host with a third of all captures is
    one skewed key of a plain shuffle join, which adaptive execution splits, and a capture gathers a few entries at most (its
    keys times the lists). Null or unparsable addresses and null fetch days match nothing; repeated captures are judged once
    and keep a row each, captures of one id with other addresses or days are captures of their own; empty lists leave every
    capture ``none``; no captures give no rows; other columns are not looked at.
    """
    spans = validity_intervals(edits)
    once = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").cast("int").alias("copies"))
    keyed = once.select("*", url_host(F.col("url")).alias("host"), F.explode_outer(url_keys(F.col("url"))).alias("k")).select("page_id", "url", "fetched", "copies", "host", "k.rank", "k.key")
    active = keyed.join(spans, (keyed.key == spans.key) & (spans.valid_from <= keyed.fetched) & (spans.valid_to.isNull() | (spans.valid_to > keyed.fetched)), "left").drop(spans.key)
    entry = F.when(F.col("list").isNotNull(), F.struct("rank", "key", "list", "effect"))
    judged = active.groupBy("page_id", "url", "fetched", "copies", "host").agg(F.count("list").alias("n_active"), F.collect_set(entry).alias("entries"))
    top = F.array_max(F.transform("entries", lambda e: e["rank"]))
    deciding = judged.withColumn("top", top).withColumn("entries", F.filter("entries", lambda e: e["rank"] == F.col("top")))
    verdict = F.when(F.size("entries") == 0, "none").when(F.exists("entries", lambda e: e["effect"] == "block"), "block").otherwise("allow")
    lists = F.when(F.size("entries") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["list"]))), ","))
    found = deciding.select("page_id", "fetched", "host", "n_active", verdict.alias("verdict"), F.get("entries", F.lit(0))["key"].alias("matched_key"), lists.alias("matched_lists"), "copies")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def edits_of(captures: DataFrame) -> DataFrame:
    """Dated list edits that the pages themselves imply, so that lists grow with the captures.

    Hosts whose first page is divisible by 3 go on and off the spam list, path segments whose first page is divisible by
    4 are allowed for a while, parent domains are on a review list for a short time, and every 20th address is listed as
    malware from five days before its fetch.
    """
    keyed = captures.select("page_id", F.explode(url_keys(F.col("url"))).alias("k")).groupBy("k.rank", "k.key").agg(F.min("page_id").alias("first"))
    edit = lambda name, effect, action, day: F.struct(F.lit(name).alias("list"), F.lit(effect).alias("effect"), F.lit(action).alias("action"), day.cast("long").alias("day"))
    f = F.col("first")
    spam = F.array(edit("spam", "block", "add", f % 200), edit("spam", "block", "remove", f % 200 + 90), edit("spam", "block", "add", f % 200 + 300))
    allowed = F.array(edit("partners", "allow", "add", f % 100), edit("partners", "allow", "remove", f % 100 + 250))
    review = F.array(edit("review", "block", "add", F.lit(500)), edit("review", "block", "remove", F.lit(520)))
    malware = F.array(edit("malware", "block", "add", f % 730 - 5), edit("malware", "block", "remove", f % 730 + 5))
    edits = F.when((F.col("rank") >= EXACT_RANK) & (f % 20 == 0), malware).when((F.col("rank") == SEGMENT_RANK) & (f % 4 == 0), allowed).when((F.col("rank") == 2), review).when(F.col("rank").between(3, 800) & (f % 3 == 0), spam)
    return keyed.select("key", F.explode(edits).alias("e")).select("e.list", "e.effect", "key", "e.action", "e.day")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` as captures, fetched on day ``page_id % 730``, against lists made from them (see ``edits_of``)."""
    captures = table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 730).alias("fetched"))
    return filter_captures(captures, edits_of(captures))


OP2_SQL = r"""
with p as (
  select page_id, url, page_id % 730 as fetched, coalesce(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '') as host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) as query
  from pages),
q as (
  select *, host || case when path in ('', '/') then '/' else regexp_replace(path, '/$', '') end as page, regexp_extract(path, '^(/[^/]+)', 1) as segment, string_split(host, '.') as labels,
    regexp_matches(host, '^(\[.*|[0-9]+(\.[0-9]+){3})$') as numeric
  from p where host <> ''),
keyed as (
  select page_id, url, fetched, host, 1001 as rank, page || query as key from q where query <> ''
  union all select page_id, url, fetched, host, 1000, page from q
  union all select page_id, url, fetched, host, 900, host || segment from q where segment <> '' and host || segment <> page
  union all select page_id, url, fetched, host, 4, host from q where numeric
  union all select page_id, url, fetched, host, len(labels) - i + 1, array_to_string(labels[i:], '.') from (select *, unnest(range(1, greatest(len(labels), 2))) as i from q where not numeric)),
firsts as (select rank, key, min(page_id) as first from keyed group by rank, key),
edits as (
  select 'malware' as list, 'block' as effect, key, 'add' as action, first % 730 - 5 as day from firsts where rank >= 1000 and first % 20 = 0
  union all select 'malware', 'block', key, 'remove', first % 730 + 5 from firsts where rank >= 1000 and first % 20 = 0
  union all select 'partners', 'allow', key, 'add', first % 100 from firsts where rank = 900 and first % 4 = 0
  union all select 'partners', 'allow', key, 'remove', first % 100 + 250 from firsts where rank = 900 and first % 4 = 0
  union all select 'review', 'block', key, 'add', 500 from firsts where rank = 2
  union all select 'review', 'block', key, 'remove', 520 from firsts where rank = 2
  union all select 'spam', 'block', key, 'add', first % 200 from firsts where rank between 3 and 800 and first % 3 = 0
  union all select 'spam', 'block', key, 'remove', first % 200 + 90 from firsts where rank between 3 and 800 and first % 3 = 0
  union all select 'spam', 'block', key, 'add', first % 200 + 300 from firsts where rank between 3 and 800 and first % 3 = 0),
spans as (
  select list, effect, key, day as valid_from, valid_to
  from (select *, lead(day) over (partition by list, effect, key order by day, action) as valid_to from (select distinct * from edits))
  where action = 'add' and (valid_to is null or valid_to > day)),
active as (
  select k.*, s.list, s.effect
  from (select distinct * from keyed) k join spans s on k.key = s.key and s.valid_from <= k.fetched and (s.valid_to is null or s.valid_to > k.fetched)),
per_key as (
  select page_id, url, fetched, rank, key, count(*) as n, max(case when effect = 'block' then 1 else 0 end) as blocks, string_agg(distinct list, ',' order by list) as lists
  from active group by all),
ranked as (select *, row_number() over (partition by page_id, url, fetched order by rank desc) as r, sum(n) over (partition by page_id, url, fetched) as total from per_key)
select p.page_id, p.fetched, p.host, cast(coalesce(total, 0) as bigint) as n_active, case when r.key is null then 'none' when blocks = 1 then 'block' else 'allow' end as verdict,
  r.key as matched_key, r.lists as matched_lists
from p left join ranked r on r.r = 1 and r.page_id is not distinct from p.page_id and r.url = p.url and r.fetched is not distinct from p.fetched
"""
