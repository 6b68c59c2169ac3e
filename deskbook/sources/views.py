"""Views that give the test tables the shapes of the library's jobs, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_articles": "select concat(source, '-example:', cast(doc_id as string)) as doc_id, concat('https://', source, '.example.com/docs/', cast(doc_id as string)) as url, trim(substring(split_part(text, chr(10), 1), 1, 72)) as title, text as body_markdown, source, concat(source, '.example.com') as source_host, lang, doc_id as ord from {documents}",
    "v_chunks1": "select concat(doc_id, '#0') as chunk_id, doc_id, url, title, title as section, body_markdown as text, source, ord from {v_articles}",
    "v_queries": "select item_id as query_id, text as query from {benchmark}",
    "v_scraped": "select doc_id, url, case when ord % 5 = 4 then null else sha256(body_markdown) end as content_hash, case when ord % 5 = 4 then 'Extracted body too short' end as error, ord from {v_articles}",
    "v_cache": "select url, doc_id, case when ord % 3 = 0 then sha256(body_markdown) else sha256(concat('old:', body_markdown)) end as content_hash, 'success' as status, cast(null as string) as error, ord from {v_articles} where ord % 3 <> 2",
    "v_existing": "select doc_id, url, content_hash, ord from {v_cache} where ord % 7 <> 0",
    "v_threads": "select conv_id as thread_id, conv_id % 25 as created_by, case when conv_id % 4 = 0 then 'private' else 'org' end as visibility, 'New thread' as title, 1704067200 + (conv_id * 37) % 1009 as updated_ts from {conversations} group by conv_id",
    "v_participants": "select t.thread_id, (t.thread_id * 3 + j.j) % 25 as user_id from {v_threads} t cross join (select 0 as j union all select 1 as j) j",
    "v_messages": "select concat(cast(conv_id as string), '#', cast(turn as string)) as message_id, conv_id as thread_id, turn, role, text as content, 1704067200 + conv_id * 1000 + turn as created_ts, case when role = 'assistant' then case conv_id % 5 when 0 then 'openai:gpt-5-mini' when 1 then 'anthropic:claude-sonnet-4-5-20250929' when 2 then 'gemini:gemini-2.5-pro' when 3 then 'openai:gpt-5.2-2026-01-01' else 'gemini:gemini-exp-1206' end end as model_id, case when role = 'assistant' then concat('{{\"inputTokens\":', cast(length(text) * 400 as string), ',\"outputTokens\":', cast(cast(floor(length(text) / 4.0) as bigint) as string), '}}') end as usage from {conversations}",
    "v_citations": "select m.message_id, m.thread_id, a.chunk_id, a.doc_id, m.created_ts from {v_messages} m cross join (select 0 as k union all select 1 as k union all select 1 as k) k join {v_chunks1} a on a.ord = (m.thread_id * 7 + m.turn * 3 + k.k * 11) % (select count(*) from {documents}) where m.role = 'assistant'",
    "v_message_feedback": "select e.event_id, concat(cast(e.event_id % (select count(distinct conv_id) from {conversations}) as string), '#1') as message_id, e.user_id, case e.event_type when 'purchase' then 5 when 'signup' then 4 when 'view' then 3 when 'click' then 2 else 1 end as rating, case when e.event_id % 3 = 0 then '  ' when e.event_id % 3 = 1 then e.props end as comment, e.ts from {events} e where e.event_id % 2 = 0",
    "v_thread_feedback": "select e.event_id, e.event_id % (select count(distinct conv_id) from {conversations}) as thread_id, e.user_id, case e.event_type when 'purchase' then 5 when 'signup' then 4 when 'view' then 3 when 'click' then 2 else 1 end as rating, e.ts from {events} e where e.event_id % 2 = 1",
    "v_requests": "select o.o_orderkey as request_id, o.o_custkey as user_id, o.o_orderdate as ts, cast(round(o.o_totalprice * 100) as bigint) as reserved_cents, l.actual_cents from {orders} o left join (select l_orderkey, sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) as actual_cents from {lineitem} group by l_orderkey) l on o.o_orderkey = l.l_orderkey",
    "v_grants": "select c_custkey as user_id, cast(round(greatest(c_acctbal, 0) * 100) as bigint) as amount_cents from {customer}",
    "v_invites": "select o_orderkey as invite_id, concat(' User', cast(o_custkey as string), '@Example.com ') as email, case o_orderstatus when 'P' then 'pending' when 'O' then 'pending' else 'accepted' end as status, o_orderdate as created_at, o_orderdate + interval '14' day as expires_at, 200 + o_orderkey % 300 as initial_credit_cents from {orders}",
    "v_api_keys": "select c_custkey as id, concat('v', cast(1 + c_custkey % 2 as string), ':key-', cast(c_nationkey % 3 as string), ':payload') as encrypted_key from {customer}",
    "v_rate_events": "select event_type as scope, user_id as k, ts, event_id from {events}",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where ``name`` is none."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"\(select (count\([^{]*\)) from \{(\w+)\}\)", lambda m: str(view(spark, sf_dir, m[2]).selectExpr(m[1]).first()[0]), VIEWS[name])
    sql = re.sub(r"sha256\((\w+|concat\([^()]*\))\)", r"sha2(\1, 256)", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names, and those that these name, before it."""
    order: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in order:
                add(VIEWS[name])
                order.append(name)

    add(sql)
    ctes = [f"{n} as ({VIEWS[n].format_map({x: x for x in _needs(VIEWS[n])})})" for n in order]
    head, recursive, body = re.match(r"\s*(with\s+(recursive\s+)?)?(.*)", sql, re.S | re.I).groups()
    return f"with {recursive or ''}" + ", ".join(ctes) + (", " if head else " ") + body if ctes else sql
