"""DuckDB text for the queries of this subpackage that SQL can express."""

from __future__ import annotations

SQL = {
    "op7_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) as points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
  first_value(doc_id) over w as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from n window w as (partition by text_sha256 order by points desc, doc_id nulls last)
""",
    "op9_quotes": r"""
with recursive m as (
  select row_number() over () as id, conv_id, turn, role, coalesce(cast(conv_id as varchar), '') as conv,
    coalesce(turn, -4611686018427387904) as pt, string_split_regex(coalesce(text, ''), '\r?\n') as lines from conversations),
l as (
  select id, conv, pt, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as level,
    regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') as line
  from (select id, conv, pt, unnest(lines) as line, generate_subscripts(lines, 1) as i from m)),
k as (
  select *, level = 0 and regexp_matches(line, '(?i)(wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$')
      and coalesce(lead(level) over w > 0, false) as introduces,
    trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')) = '' as blank from l window w as (partition by id order by i)),
s as (
  select *, sum(case when i = 1 or level <> last_level or blank or last_blank or introduces then 1 else 0 end) over (partition by id order by i) as part
  from (select *, lag(level) over w as last_level, lag(blank) over w as last_blank from k window w as (partition by id order by i))),
p as (
  select id, conv, pt, level, trim(regexp_replace(lower(string_agg(line, ' ' order by i)), '[\x09-\x0D\x20]+', ' ', 'g')) as passage, bool_or(introduces) as introduces
  from s group by id, conv, pt, level, part),
o as (select conv, passage, min(pt) as original from p where level = 0 and passage <> '' and not introduces group by conv, passage),
r as (
  select p.conv, p.pt, max_by(o.original, struct_pack(a := -p.level, b := o.original)) as reply_to
  from p join o on o.conv = p.conv and o.passage = p.passage and o.original < p.pt where p.level > 0 group by p.conv, p.pt),
t(conv, pt, up, depth) as (
  select conv, pt, reply_to, cast(1 as bigint) from r union all
  select t.conv, t.pt, r.reply_to, t.depth + 1 from t join r on r.conv = t.conv and r.pt = t.up),
d as (select conv, pt, max(depth) as depth, max_by(up, depth) as root from t group by conv, pt),
b as (
  select id, regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (where level = 0 and not introduces), ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') as body
  from k group by id),
q as (select id, max(level) as quote_levels from p where passage <> '' group by id)
select m.conv_id, row_number() over (partition by m.conv order by coalesce(d.root, m.pt), coalesce(d.depth, 0), m.pt, m.role, b.body) - 1 as position,
  m.turn, m.role, b.body, nullif(r.reply_to, -4611686018427387904) as reply_to, nullif(coalesce(d.root, m.pt), -4611686018427387904) as thread_root,
  coalesce(d.depth, 0) as depth, cast(coalesce(q.quote_levels, 0) as int) as quote_levels
from m join b using (id) left join q using (id) left join r on r.conv = m.conv and r.pt = m.pt left join d on d.conv = m.conv and d.pt = m.pt
""",
    "op11_prefix_trie": r"""
with recursive t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
k as (
  -- one bit of the checksum at a time
  select conv_id, cast(conv_id as varchar) as s, 0 as bit, cast(4294967295 as bigint) as crc from t group by conv_id union all
  select conv_id, s, bit + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end
  from (select *, case when bit % 8 = 0 then xor(crc, cast(ascii(substr(s, bit // 8 + 1, 1)) as bigint)) else crc end as x from k where bit < 8 * length(s))),
h as (select conv_id, xor(max_by(crc, bit), 4294967295) % 6 as h from k group by conv_id),
r as (
  select h.conv_id, 0 as part, t.i, t.role, t.text from h join t on t.conv_id = h.conv_id - h.conv_id % 100 and t.i <= h.h union all
  select h.conv_id, 1, t.i, t.role, t.text from h join t on t.conv_id = h.conv_id and t.i > h.h),
l as (
  select h.conv_id, coalesce(list(struct_pack(role := r.role, text := r.text) order by part, i) filter (where r.conv_id is not null), []) as turns
  from h left join r using (conv_id) group by h.conv_id),
p as (select conv_id, turns, unnest(range(len(turns) + 1)) as depth from l),
m as (select conv_id, depth, depth = len(turns) as ends, turns[:depth] as prefix from p),
n as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(case when ends then cast(conv_id as varchar) end, ',' order by conv_id) as ids,
    (count(*) - 1) * coalesce(length(prefix[depth].text), 0) as own
  from m group by prefix, depth),
c as (select u.*, o.conv_id as parent_conv_id from n u left join n o on o.depth = u.depth - 1 and o.prefix = u.prefix[:u.depth - 1]),
f as (select prefix[:depth - 1] as up, depth - 1 as up_depth, count(*) as n_children from n where depth > 0 group by all),
g as (select c.*, coalesce(f.n_children, 0) as n_children from c left join f on f.up_depth = c.depth and f.up = c.prefix),
a as (
  select prefix[:d] as prefix, d as depth, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(own) as saved_tokens
  from (select *, unnest(range(depth + 1)) as d from g) group by all)
select g.conv_id, g.depth, g.parent_conv_id, g.n_convs, g.n_children, cast(a.n_leaves as bigint) as n_leaves, cast(a.saved_tokens as bigint) as saved_tokens,
  sha256(coalesce(g.ids, '')) as ends_sha256
from g join a on a.depth = g.depth and a.prefix = g.prefix
""",
}
