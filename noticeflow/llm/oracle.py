"""SQL for DuckDB of the corpus queries that SQL can express."""

from __future__ import annotations

#: The table of the reflected crc32, by its rule.
_CRC_TABLE = "select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from range(256) r(i)"


def _crc(codes: str) -> str:
    """crc32 of a list of byte values; t is the table."""
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295)"


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"


MERKLE = f"""
with recursive crc as ({_CRC_TABLE}),
doc as (
  select doc_id, lang, sha256(concat({", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))})) as leaf,
    sha256(concat({", ".join(map(_field, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))})) as other,
    {_crc("list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)")} % 7 = 0 as tampered
  from documents, crc),
leaf as (
  select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos, count(*) over (partition by lang) as total from doc),
tree as (
  select lang, 0 as level, pos, leaf as h, total from leaf
  union all
  select lang, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (total + 1) // 2 from tree where total > 1 group by lang, level, pos // 2, total),
sub as (
  select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as total from tree where total = 1),
crown as (
  select 0 as level, pos, h, total from sub
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (total + 1) // 2 from crown where total > 1 group by level, pos // 2, total),
climb as (
  select doc_id, leaf, lang, 0 as level, pos, total, case when tampered then other else leaf end as own, '' as proof from leaf
  union all
  select c.doc_id, c.leaf, c.lang, c.level + 1, c.pos // 2, (c.total + 1) // 2,
    sha256(case when c.pos % 2 = 1 then t.h || c.own else c.own || coalesce(t.h, '') end), c.proof || coalesce(t.h, '')
  from climb c left join tree t on t.lang is not distinct from c.lang and t.level = c.level and t.pos = xor(c.pos, 1)
  where c.total > 1),
ascent as (
  select c.doc_id, c.leaf, s.h as subroot, 0 as level, s.pos, s.total, c.own, c.proof
  from climb c join sub s on s.lang is not distinct from c.lang where c.total = 1
  union all
  select a.doc_id, a.leaf, a.subroot, a.level + 1, a.pos // 2, (a.total + 1) // 2,
    sha256(case when a.pos % 2 = 1 then t.h || a.own else a.own || coalesce(t.h, '') end), a.proof || coalesce(t.h, '')
  from ascent a left join crown t on t.level = a.level and t.pos = xor(a.pos, 1)
  where a.total > 1)
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, own as folded_root, own = r.h as verified
from ascent, (select h from crown where total = 1) r where ascent.total = 1
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = f"""
  (select key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
   from (select *, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from %s))"""

RESAMPLE = f"""
with crc as ({_CRC_TABLE}),
doc as (select row_number() over () as key, doc_id, coalesce(text, '') as text from documents),
aim as (select 0 as key, coalesce(text, '') as text from benchmark),
own as (select key, f, count(*) as n from {_FEATURES % "doc"} group by all),
their as (select f, count(*) as n from {_FEATURES % "aim"} group by all),
code as (
  select f, {_crc("list_transform(range(strlen(f)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)")} % 10000 as bucket
  from (select f, hex(encode(f)) as x from (select f from own union select f from their)), crc),
s as (select bucket, sum(n)::bigint as n from own join code using (f) group by 1),
t as (select bucket, sum(n)::bigint as n from their join code using (f) group by 1),
gain as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0)::bigint from s) + 10000)::double / ((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0)::bigint from t) + 10000))))::bigint as g
  from range(10000) b(bucket) left join s using (bucket) left join t using (bucket)),
weighed as (select key, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from own join code using (f) join gain using (bucket) group by 1),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from doc left join weighed using (key)),
able as (select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from scored where n_features >= 57)
select s.doc_id, s.n_features, s.weight, s.score, case when place <= 5 * total // 100 then place end as rank
from scored s left join able a on a.doc_id = s.doc_id
"""

JACCARD = f"""
with recursive doc as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (
  select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as r from doc),
size as (select doc_id, count(*) as n from runs group by 1),
often as (
  -- a similar pair shares one of the rarest 15 % of each one's runs, and one more
  select doc_id, r from (
    select doc_id, r, n, row_number() over (partition by doc_id order by df, r) as place
    from (select *, count(*) over (partition by r) as df from runs) join size using (doc_id))
  where place <= n - ceil(0.85 * n) + 1),
pair as (select distinct a.doc_id as a, b.doc_id as b from often a join often b on a.r = b.r and a.doc_id < b.doc_id),
link as (
  select p.a, p.b
  from (select a, b, count(*) as i from pair join runs x on x.doc_id = a join runs y on y.doc_id = b and y.r = x.r group by 1, 2) p
    join size s on s.doc_id = p.a join size t on t.doc_id = p.b
  where 100 * i >= 85 * (s.n + t.n - i)),
step as (select a, b from link union all select b, a from link),
reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, s.b from reach r join step s on s.a = r.other)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select doc_id, min(other) as component_id from reach group by 1) left join size using (doc_id)
"""

ORACLE_SQL = {"op11_resample": RESAMPLE, "op12_jaccard": JACCARD, "op13_merkle": MERKLE}
