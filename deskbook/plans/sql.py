"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..functions.text import MARKED, SEVERAL, SINGLE, STOPWORDS
from ..operators.billing import MODELS, exact_ids, provider_of

WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def compact(x: str) -> str:
    return trimmed(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def cleaned(x: str) -> str:
    for pattern, to in (("(?m)^>\\s?", "''"), (" ", "' '"), ("\\r", "''"), ("[ \\t]+", "' '"), ("\\n{3,}", "chr(10) || chr(10)")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return trimmed(x)


def tidy(x: str) -> str:
    return trimmed(f"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def tokens(x: str) -> str:
    x = f"lower({x})"
    rare = x
    for character, to in SEVERAL.items():
        rare = f"replace({rare}, '{character}', '{to}')" if len(character.encode()) < 3 else rare
    x = f"translate(regexp_replace({rare}, '([{MARKED}])', '\\1 ', 'g'), '{''.join(SINGLE)}', '{''.join(to[0] for to in SINGLE.values())}')"
    return f"list_filter(string_split_regex(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 and w not in ({WORDS}))"


def estimate(x: str) -> str:
    return f"cast(case when length({x}) > 0 then greatest(1, floor(length({x}) / 4.0)) else 0 end as integer)"


def service_estimate(x: str) -> str:
    return f"cast(case when length({trimmed(x)}) > 0 then greatest(1, ceil(length({trimmed(x)}) / 4.0)) else 0 end as integer)"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def price_ctes() -> str:
    """``prices``, ``keys`` and ``patterns`` as values, and ``resolved(model_id, ...)`` of the table ``ids(model_id)``."""
    number = lambda v: "null" if v is None else f"{v}::double"
    prices = ", ".join(f"('{f}', {', '.join(number(v) for v in (*r, *[None] * (5 - len(r))))})" for f, _, _, *r in MODELS)
    keys = ", ".join(f"('{k}', {'null' if f is None else repr(f)})" for k, f in exact_ids().items())
    patterns = ", ".join(f"({i}, '{provider_of(f)}', '{p}', '{f}')" for i, (f, _, p, *_) in enumerate(MODELS) if p)
    return rf"""prices(family, input_rate, output_rate, threshold, long_input_rate, long_output_rate) as (values {prices}),
keys(key, family) as (values {keys}), patterns(n, provider, pattern, family) as (values {patterns}),
parts as (select model_id, split_part(model_id, ':', 1) as provider, trim(substring(model_id, instr(model_id, ':') + 1)) as api_model from ids where model_id is not null),
tries as (
  select *, provider || ':' || api_model as key, 1 as n from parts union all select *, provider || ':' || regexp_replace(api_model, '-\d{{4}}-\d{{2}}-\d{{2}}$', ''), 2 from parts
  union all select *, provider || ':' || regexp_replace(api_model, '-\d{{8}}$', ''), 3 from parts union all select *, provider || ':' || regexp_replace(api_model, '-latest$', ''), 4 from parts),
exact as (select t.model_id, k.family, row_number() over (partition by t.model_id order by t.n) as r from tries t join keys k using (key)),
by_pattern as (select t.model_id, p.family, row_number() over (partition by t.model_id order by p.n) as r from parts t join patterns p on t.provider = p.provider and regexp_matches(t.api_model, p.pattern)),
resolved as (
  select t.model_id, t.provider, t.api_model, f.family, p.input_rate, p.output_rate, cast(p.threshold as bigint) as threshold, p.long_input_rate, p.long_output_rate
  from parts t left join exact e on e.model_id = t.model_id and e.r = 1 left join by_pattern b on b.model_id = t.model_id and b.r = 1
  left join lateral (select case when e.model_id is not null then e.family else b.family end as family) f on true left join prices p on p.family = f.family)"""


def plain_pages() -> str:
    """``plain``: ``page_id, url, html, title, body, markdown, said`` of the pages table, each with one article of paragraphs.

    Written for the markup of these pages alone: what lies between the article's tags, paragraphs and breaks.
    """
    text = "replace(replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&amp;', '&')"
    marked = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\\s+', ' ', 'g'), '<h1>', chr(10) || chr(10) || '## ', 'g'), '</?p>|</h1>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'), '</?b>', '', 'g')"
    tidied = "regexp_replace(regexp_replace(regexp_replace(" + text.replace("x,", f"{marked},", 1) + ", ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
    return f"""plain as (
  select *, trim({tidied}, ' ' || chr(10)) as markdown, {compact(text.replace("x,", "regexp_replace(body, '<[^>]*>', ' ', 'g'),", 1))} as said
  from (select page_id, url, html, {compact(text.replace("x,", "regexp_extract(html, '<h1>([^<]*)</h1>', 1),", 1))} as title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as body from pages))"""
