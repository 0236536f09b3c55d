"""SQL that computes the queries in another way, for checking (DuckDB)."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UP}', '{_LOW}')"


_DIGIT = "substr('{0}', (({1} >> {2}) & 31) + 1, 1)"
_B32 = " || ".join(_DIGIT.format(_BASE32, f"('0x' || substr(h, {5 * g + 1}, 5))::int", s) for g in range(8) for s in (15, 10, 5, 0))

OP6 = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h from p),
l as (select h, max(page_id) as last from d group by h)
select page_id, payload_bytes, {_B32} as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id != last then last end as refers_to
from d join l using (h)
"""

OP7 = f"""
with recursive w as (select doc_id, regexp_extract_all({_lower('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
edges as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
links as (select a, b from edges union select b, a from edges),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select c.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, c.doc_id = component_id as kept from c left join n using (doc_id)
"""

_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
OP8 = f"""
with d as (select doc_id, regexp_extract_all({_lower('text')}, '{_WORDS}') as w from documents),
b as (select item_id, regexp_extract_all({_lower('text')}, '{_WORDS}') as w from benchmark),
bw as (select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) < 13 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) end) as g, least(len(w), 13) as k from b),
sizes as (select distinct k from bw),
dw as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from d, sizes where len(w) >= k),
hits as (select doc_id, i, bw.k, item_id from (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from dw) x join bw using (k, g)),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (doc_id) left join items using (doc_id)
"""

_MARKS = r"\\|\[/?INST\]|\[/?ROLE\]|<a>|</?s>"
OP9 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f as (select *, length(text) + len(regexp_extract_all(text, '{_MARKS}')) + case role when 'user' then 15 when 'assistant' then 8
  else 20 + length(role) + len(regexp_extract_all(role, '{_MARKS}')) end as chars from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from f group by conv_id
"""

_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, (c & 1) * 3988292384)))"


def _crc(text: str, table: str) -> str:
    """crc32 of a string's UTF-8 bytes; ``table`` is a column with _CRC_TABLE."""
    digits = f"hex(encode({text}))"
    data = f"list_transform(range(strlen({text})), lambda j: ('0x' || substr({digits}, 2 * j + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13 = f"""
with recursive tab as (select {_CRC_TABLE} as tab),
t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
c as (select t.*, {_crc('key', 'tab')} % 20 as how from t, tab),
d as (select conv_id, turn, case when how = 4 then 'user' else role end as role,
  case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case how when 3 then 2 else 1 end)) as copy from c where how != 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as k, left(role, 1) as x, rtrim(text, {_WS}) as bare from d),
f as (select *, case when bare = '' then 'blank' when k > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  lag(x) over (partition by conv_id order by i) as before from o),
pre(s, s1, ins) as (values (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (2, 2, 'II'), (3, 3, ''), (3, 2, 'I'), (3, 3, 'II')),
keeps(s1, x, s2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves as (select s, ins || 'D' as letters, 5 * length(ins) + 2 as cost, null::varchar as x, s1 as s2, true as any_row from pre
  union all select s, ins || 'R', 5 * length(ins) + 1, null::varchar, case s1 when 2 then 3 else 2 end, false from pre
  union all select s, ins || 'K', 5 * length(ins), x, s2, false from pre join keeps using (s1)),
dp as (select distinct conv_id, 0::bigint as i, 0 as s, {{'cost': 0, 'audit': ''}} as best from f
  union all select conv_id, i, s2, min(best) from (
    select f.conv_id, f.i, m.s2, {{'cost': dp.best.cost + m.cost + case when f.fault = 'truncated' and not m.any_row then 5 else 0 end, 'audit': dp.best.audit || m.letters}} as best
    from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1 join moves m on m.s = dp.s
    where (m.any_row or f.fault not in ('blank', 'duplicate')) and (m.x is null or m.x = f.x)) group by all),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (before is not null and before || x not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
e as (select dp.conv_id, min({{'cost': best.cost + case s when 1 then 10 when 2 then 5 else 0 end, 'audit': best.audit || case s when 1 then 'II' when 2 then 'I' else '' end}}) as best
  from dp join n on dp.conv_id is not distinct from n.conv_id and dp.i = n.n group by dp.conv_id),
l as (select conv_id, unnest(range(1, length(best.audit) + 1)) as p, substr(best.audit, p, 1) as letter from e),
r as (select *, count(*) filter (letter != 'I') over w as i, count(*) filter (letter != 'D') over w as j from l window w as (partition by conv_id order by p)),
g as (select r.*, f.role, f.text, max(case when j = 1 and letter = 'K' and f.x = 's' then 1 else 0 end) over (partition by r.conv_id) as led
  from r left join f on f.conv_id is not distinct from r.conv_id and f.i = r.i and letter != 'I' where letter != 'D'),
h as (select conv_id, string_agg(case letter when 'K' then role else case (j - led) % 2 when 1 then 'user' else 'assistant' end end || ':' || coalesce(text, ''), chr(10) order by p) as whole from g group by conv_id)
select q.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(e.best.cost, 0)::bigint as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) q left join n on q.conv_id is not distinct from n.conv_id
left join e on q.conv_id is not distinct from e.conv_id left join h on q.conv_id is not distinct from h.conv_id
"""

_LETTERS = "[A-Za-z\\x{{C0}}-\\x{{FF}}]{{7,}}"
OP11 = f"""
with recursive tab as (select {_CRC_TABLE} as tab),
r as (select doc_id, {_lower('unnest(regexp_extract_all(text, ' + "'" + _LETTERS.format() + "'" + '))')} as run from documents),
g as (select doc_id, run, count(*) as c from r group by all),
h as (select g.*, {_crc("coalesce(doc_id::varchar, '') || ':' || run", 'tab')} as h from g, tab),
w as (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
v as (select word, sum(c)::bigint as n from w where length(word) >= 7 group by word having sum(c) >= 2),
p as (select word, n, unnest(range(length(word))) as i from v),
subs as (select word, n, left(word, i) || '*' || substr(word, i + 2) as k from p),
dels as (select distinct word, n, left(word, i) || substr(word, i + 2) as k from p),
pairs as (select a.word, b.word as other, b.n as m from subs a join subs b on a.k = b.k and a.word != b.word
  union select d.word, v.word, v.n from dels d join v on v.word = d.k
  union select v.word, d.word, d.n from dels d join v on v.word = d.k),
best as (select word, count(*) as n_near, min({{'m': -m, 'other': other}}) as b from pairs group by word),
f as (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when -b.m >= 10 * v.n then b.other end as form, case when -b.m >= 10 * v.n then -b.m end as form_n from v left join best using (word)),
chain as (select word, word as root, 0 as step from f union all select c.word, f.form, step + 1 from chain c join f on f.word = c.root where f.form is not null)
select word, n, n_near, form, form_n, arg_max(chain.root, step) as root from f join chain using (word) group by all
"""
