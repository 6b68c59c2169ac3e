"""SQL of the operators whose results SQL can say on small tables."""

OP1_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as shingle from (select *, unnest(range(1, greatest(2, len(ws) - 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by all),
links as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * m >= 85 * (x.n + y.n - m)),
reach as (select a as id, a as seen from links union select r.id, l.b from reach r join links l on l.a = r.seen)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component, w.doc_id) as component_id
from w left join n using (doc_id) left join (select id as doc_id, min(seen) as component from reach group by id) c using (doc_id)
"""

OP5_SQL = r"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
fine as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from fine x join fine y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.95),
reach as (select a as id, a as seen from links union select r.id, l.b from reach r join links l on l.a = r.seen),
c as (select id as vec_id, min(seen) as component from reach group by id), d as (select a as vec_id, count(*) as n from links group by a)
select v.vec_id, coalesce(d.n, 0) as n_links, coalesce(c.component, v.vec_id) as component_id, coalesce(c.component, v.vec_id) = v.vec_id as kept from v left join c using (vec_id) left join d using (vec_id)
"""

OP8_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, least(13, len(ws)) as n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as words from (select *, unnest(range(1, greatest(2, len(ws) - 11))) as i from b where len(ws) > 0)),
sizes as (select distinct n from win),
places as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as words from (select w.doc_id, w.ws, s.n, unnest(range(1, len(w.ws) - s.n + 2)) as i from w, sizes s)),
hits as (select x.doc_id, x.i, x.n, win.item_id from places x join win on win.n = x.n and win.words = x.words),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join covered using (doc_id) left join items using (doc_id)
"""

OP7_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
cut as (
  select r, text, 1 as k, 'email' as kind, regexp_extract_all(text, 'EMAIL') as h, string_split_regex(text, 'EMAIL') as g from d
  union all select r, text, 2, 'ip', regexp_extract_all(text, 'IP'), string_split_regex(text, 'IP') from d
  union all select r, text, 3, 'card', regexp_extract_all(text, 'CARD'), string_split_regex(text, 'CARD') from d
  union all select r, text, 4, 'phone', regexp_extract_all(text, 'PHONE'), string_split_regex(text, 'PHONE') from d
  union all select r, text, 5, 'secret', regexp_extract_all(text, 'SECRET'), string_split_regex(text, 'SECRET') from d),
each_ as (select *, unnest(range(1, len(h) + 1)) as i from cut where len(h) > 0),
placed as (
  select r, k, kind, h[i] as v, regexp_replace(h[i], '[^0-9]', '', 'g') as digits,
    cast(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0) as bigint) as a from each_),
valid as (
  select r, k, kind, v, digits, a, a + length(v) as b, kind || ':' || case when kind in ('card', 'phone') then digits when kind = 'secret' then v else lower(v) end as entity from placed
  where case kind when 'ip' then len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(nullif(ltrim(x, '0'), '') as integer), 0) > 255)) = 0
    when 'card' then length(digits) between 16 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then cast(reverse(digits)[i] as integer) when cast(reverse(digits)[i] as integer) > 4 then 2 * cast(reverse(digits)[i] as integer) - 9 else 2 * cast(reverse(digits)[i] as integer) end)) % 10 = 0
    when 'phone' then length(digits) between 8 and 15 when 'secret' then regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') else true end),
private as (select * from valid x where k < 5 or not exists (select 1 from valid y where y.r = x.r and y.k < 5 and y.a < x.b and x.a < y.b)),
entities as (
  select r, entity from private union select r, 'any ' || kind from private
  union select r, case kind when 'email' then 'domain:' || lower(split_part(v, '@', 2)) when 'ip' then 'network:' || regexp_extract(v, '^[0-9]+\.[0-9]+\.[0-9]+')
    when 'card' then 'issuer:' || digits[:6] when 'phone' then 'prefix:' || digits[:5] else 'begins:' || v[:4] end from private),
gaps as (select *, coalesce(max(b) over (partition by r order by a, b, kind rows between unbounded preceding and 1 preceding), 0) as before from private),
outside as (select d.r, string_agg(case when a >= before then substring(text, before + 1, a - before) || ' ' else '' end, '' order by a, b, kind) || substring(any_value(text), max(b) + 1) as t from gaps join d using (r) group by d.r),
near as (select r, unnest(list_distinct(regexp_extract_all(lower(t), '\p{L}{3,}'))) as term from outside),
spread as (select term, count(*) as n_term from (select unnest(list_distinct(regexp_extract_all(lower(coalesce(o.t, d.text)), '\p{L}{3,}'))) as term from d left join outside o using (r)) group by term),
size_ as (select count(*)::double as n from d),
counts as (select entity, count(*) as n_entity from entities group by entity having count(*) >= 3),
pairs as (select entity, n_entity, term, count(*) as n_both from entities join counts using (entity) join near using (r) group by all having count(*) >= 3),
judged as (
  select entity, term, n_both, log2(n / n_entity) as information, log2(n * n_both / (n_entity * n_term)) as shared from pairs join spread using (term) cross join size_),
flagged as (
  select entity, term, case when shared >= 0.95 * information then 'remove' else 'generalise' end as action from judged
  where information > 0 and shared >= 0.85 * information and n_both * shared >= log2(greatest(1, (select count(*) from pairs))) + 10),
actions as (select r, term, max(action) as action from entities join flagged using (entity) group by all),
words as (select d.r, regexp_extract_all(text, '\p{L}+') as h, string_split_regex(text, '\p{L}+') as g from d where r in (select r from actions)),
word_ as (select *, unnest(range(1, len(h) + 1)) as i from words),
found as (
  select w.r, x.action as kind, cast(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i - 1], lambda x: length(x))), 0) as bigint) as a, length(h[i]) as n
  from word_ w join actions x on x.r = w.r and x.term = lower(h[i])),
terms as (
  select r, kind, a, a + n as b from found f where not exists (select 1 from private p where p.r = f.r and p.a < f.a + f.n and f.a < p.b)
  union all select r, kind, a, b from private where k = 5),
base as (select r, count_if(k = 1) as e, count_if(k = 2) as i, count_if(k = 3) as c, count_if(k = 4) as p, count(*) as n, string_agg(kind || ':' || a || ':' || b, ',' order by k, a) as listed from private where k < 5 group by r),
more as (select r, count(*) as n, string_agg(kind || ':' || a || ':' || b, ',' order by a) as listed from terms group by r)
select doc_id, coalesce(e, 0)::bigint as n_email, coalesce(i, 0)::bigint as n_ip, coalesce(c, 0)::bigint as n_card, coalesce(p, 0)::bigint as n_phone, sha256(coalesce(base.listed, '')) as base_sha256,
  concat_ws(',', base.listed, more.listed) as spans, (coalesce(base.n, 0) + coalesce(more.n, 0))::bigint as n_spans
from d left join base using (r) left join more using (r)
"""
for _name, _pattern in (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("CARD", r"[0-9]([\x20-]?[0-9])+"), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]"), ("SECRET", "[A-Za-z0-9+/_-]{20,}")):
    OP7_SQL = OP7_SQL.replace(f"'{_name}'", f"'{_pattern}'")
