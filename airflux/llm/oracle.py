"""SQL with the same rows, for the queries over documents that SQL can express."""

NEAR_DUPLICATES = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, len(s)::bigint as n from s),
e as (select doc_id, unnest(s) as g from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
ends as (select a, b from links union select b, a from links),
reach(doc_id, seen) as (select doc_id, doc_id from n union select r.doc_id, ends.b from reach r join ends on ends.a = r.seen)
select n.doc_id, n.n as n_shingles, min(seen) as component_id, n.doc_id = min(seen) as kept
from n join reach using (doc_id) group by n.doc_id, n.n
"""

REPEATED_STRINGS = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, len(h) // 2 as n from d),
win as (select doc_id, i, substr(h, 2 * i + 1, 100) as g from p, unnest(range(0, n - 49)) as r(i) where n >= 50),
low as (select g, min(doc_id) as first from win group by g),
hit as (select doc_id, i from win join low using (g) where first < doc_id),
runs as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from hit),
marked as (select doc_id, i, sum(case when gap is null or gap > 50 then 1 else 0 end) over (partition by doc_id order by i) as run from runs),
spans as (select doc_id, run, min(i) as a, max(i) + 50 as b from marked group by 1, 2),
cuts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before, row_number() over (partition by doc_id order by a desc) as last from spans),
kept as (select c.doc_id, string_agg(substr(p.h, 2 * before + 1, 2 * (a - before)) || case when last = 1 then substr(p.h, 2 * b + 1) else '' end, '' order by a) as h,
    sum(b - a)::bigint as n_removed, count(*) as n_spans from cuts c join p using (doc_id) group by 1)
select p.doc_id, p.n as n_bytes, coalesce(k.n_removed, 0) as n_removed, coalesce(k.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.h, p.h))) as kept_sha256
from p left join kept k using (doc_id)
"""
