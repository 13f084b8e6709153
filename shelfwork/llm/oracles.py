"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
with t as (select cast(doc_id as bigint) as doc_id, {LOWER} as low from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(low) as text_sha256
from t window w as (partition by low)
"""

MIX_BASE = """
sized as (select cast(doc_id as bigint) as doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
base as (select *, length(bin(size)) as m from sized),
src as (select source, sum(size) as source_size, sum(size * m) as weighed from base group by source),
w as (select source, source_size, weighed, source_size * 2.0::double as most, list_value(5.0::double, 2.0::double, 1.0::double)[1 + (row_number() over (order by source is null, source) - 1) % 3] as weight from src),
lev as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(most) over (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))
   / sum(weight) over (order by most / weight, source is null, source rows between current row and unbounded following) as level, row_number() over (order by most / weight, source is null, source) as turn from w),
free as (select arg_min(level, turn) as free from lev where level * weight <= most),
goal as (select source, cast(source_size as bigint) as source_size, cast(weighed as double) as weighed, coalesce(least(most, (select free from free) * weight), most) as target from lev)
"""

PARETO_MIX = f"""
with {MIX_BASE},
r as (select b.doc_id, b.size, b.m, g.source_size, g.weighed, g.target, b.source, case when g.source_size > 0 then cast(floor(g.target / g.source_size) as bigint) else 0 end as whole
  from base b join goal g on b.source is not distinct from g.source),
p as (select *, target - whole * source_size as rest, case when weighed > 0 then m::double * ((target - whole * source_size) / weighed) else 0 end as p,
  (cast('0x' || substr(md5('mix:' || cast(doc_id as varchar)), 1, 13) as bigint)::double + 0.5::double) / 4503599627370496.0::double as u from r),
q as (select *, case when size = 0 then null when p >= 1 then 0 when p > 0 then u / (1 - u) * (1 - p) / p end as odds from p),
k as (select *, odds / (1 + odds) as rank_key from q),
c as (select *, sum(case when rank_key is not null then size end) over (partition by source order by rank_key nulls last, doc_id rows between unbounded preceding and current row) as upto from k)
select doc_id, size, source_size, target, cast(case when size = 0 then 0 else size * (whole + case when rank_key is null or rest <= 0 then 0 when upto <= rest then 1
  when upto - size < rest and upto - rest <= rest - (upto - size) then 1 else 0 end) end as bigint) as taken from c
"""

# base 32 of the 20 bytes of a SHA-1: 32 groups of 5 bits, taken from the hexadecimal digits
WARC = """
with p as (select cast(page_id as bigint) as page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
w as (select *, max(page_id) over (partition by html) as keep from p),
b as (select *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((((strpos('0123456789abcdef', substr(h, 1 + (i * 5) // 4, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(h || '0', 2 + (i * 5) // 4, 1)) - 1, 0)) >> (3 - (i * 5) % 4)) & 31), 1)), 'string_agg', '') as digest from w)
select page_id, cast(strlen(html) as bigint) as payload_bytes, digest as payload_digest, case when page_id = keep then 'response' else 'revisit' end as record_type,
  case when page_id <> keep then keep end as refers_to from b
"""

NGRAM_JOIN = f"""
with recursive t as (select cast(doc_id as bigint) as doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
u as (select dense_rank() over (order by w) as uid, w, doc_id from t),
k as (select distinct uid, w from u where len(w) > 0),
s as (select distinct uid, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from k),
n as (select uid, count(*) as n from s group by uid),
c as (select a.uid as a, b.uid as b, count(*) as common from s a join s b on a.g = b.g and a.uid < b.uid group by 1, 2),
e as (select c.a, c.b from c join n x on x.uid = c.a join n y on y.uid = c.b where common * 5 >= (x.n + y.n - common) * 4),
sym as (select a, b from e union all select b, a from e),
reach as (select uid, uid as root from k union select sym.b, reach.root from reach join sym on sym.a = reach.uid),
cls as (select uid, min(root) as root from reach group by uid),
l as (select a as uid, count(*) as n_links from sym group by a),
r as (select u.doc_id, case when len(u.w) = 0 then -1 - u.doc_id else cls.root end as class, coalesce(l.n_links, 0) as n_links from u left join cls on cls.uid = u.uid left join l on l.uid = u.uid)
select doc_id, min(doc_id) over (partition by class) as class_id, cast(n_links as bigint) as n_links, count(*) over (partition by class) as class_size, doc_id = min(doc_id) over (partition by class) as kept from r
"""

ALNUM = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

WINNOWING = f"""
with d as (select row_number() over () as rid, cast(doc_id as bigint) as doc_id, {ALNUM} as w from documents),
b as (select cast(item_id as varchar) as item, {ALNUM} as w from benchmark),
i as (select distinct item, least(10, len(w)) as m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) as g from b where len(w) > 0),
t as (select rid, m, unnest(range(1, len(w) - m + 2)) as k, w from d, (select distinct m from i) where len(w) >= m),
h as (select rid, k, m, item from (select rid, k, m, array_to_string(w[k:k + m - 1], ' ') as g from t) join i using (m, g)),
n as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(k, k + m)) as p from (select distinct rid, k, m from h)) group by rid),
l as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from h where item is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (rid) left join l using (rid)
"""

LEXICAL = f"""
with d as (select row_number() over () as rid, cast(doc_id as bigint) as doc_id, {ALNUM} as w from documents where len({ALNUM}) > 0),
c as (select count(*) as n, cast(sum(len(w)) as bigint) as l from d),
i as (select distinct item_id, unnest({ALNUM}) as t from benchmark),
tf as (select rid, t, count(*) as tf from (select rid, unnest(w) as t from d) where t in (select t from i) group by rid, t),
df as (select t, count(*) as df from tf group by t),
wt as (select t, cast(floor(1000 * ln((2 * n + 2)::double / (2 * df + 1))) as bigint) as weight from df, c),
m as (select rid, doc_id, 50 + ((50 * len(w) * n) // l) as m from d, c),
s as (select item_id, rid, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from tf join wt using (t) join m using (rid) join i using (t) group by all),
r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id, rid) as int) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50
"""

ORACLES = {"op11_winnowing": WINNOWING, "op13_lexical_search": LEXICAL, "op3_ngram_join": NGRAM_JOIN, "op4_warc": WARC, "op2_exact_dedup": EXACT_DEDUP, "op8_pareto_mix": PARETO_MIX}
