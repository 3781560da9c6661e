"""DuckDB SQL for the queries that SQL can express."""

#: Fixed value: the separators of words, as an RE2 pattern.
_SPACE = r"[\x20\x09-\x0D]"

_OP2 = rf"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents
), w as (
  select r, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') as w from d
), spans as (
  select r, i, array_to_string(w[i:i+4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
), twice as (
  select r, i from spans qualify count(*) over (partition by r, g) > 1
), covered as (
  select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2, 3, 4]) as k) group by r
), raw_lines as (
  select r, unnest(string_split(text, chr(10))) as l from d
), dup as (
  select r, count(*) - count(distinct l) as n from raw_lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by r
), norm as (
  select distinct r, lower(trim(regexp_replace(l, '{_SPACE}+', ' ', 'g'), ' ')) as l from raw_lines
), lines as (
  select r, source, l, len(string_split(l, ' ')) as n from norm join d using (r) where l <> ''
), common as (
  select source, l from lines group by source, l having count(*) > 10
), totals as (
  select a.r, sum(a.n) as line_words, coalesce(sum(case when c.l is not null then a.n end), 0) as removed
  from lines a left join common c on a.source is not distinct from c.source and a.l = c.l group by a.r
), base as (
  select d.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
    (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(t.line_words, 0)::bigint as line_words, coalesce(t.removed, 0)::bigint as removed_words
  from d join w using (r) left join dup using (r) left join covered using (r) left join totals t using (r)
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words, removed_words,
  not base_failed and 2 * (line_words - removed_words) >= line_words as kept
from judged
"""

#: SHA-1 in base32: five hex digits give four characters of five bits.
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {k + 1}, 5))::int >> {s}) & 31), 1)" for k in range(0, 40, 5) for s in (15, 10, 5, 0)
)
_OP3 = f"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages
), f as (
  select h, min(page_id) as first_id from p group by h
)
select page_id, strlen(html)::bigint as payload_bytes, {_B32} as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from p join f using (h)
"""

_OP4 = rf"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), l as (
  select doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line from d
), k as (
  select *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), often as (
  select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (
  select k.*, o.keeper is not null and o.keeper <> k.doc_id as gone from k left join often o using (key)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


def _escape(x: str) -> str:
    entity = "(amp;|lt;|#91;|#10;)"
    x = f"regexp_replace({x}, '&{entity}', '&amp;\\1', 'g')"
    x = f"regexp_replace({x}, '<(\\|turn\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|<SYS>>|</SYS>>)', '&lt;\\1', 'g')"
    return f"regexp_replace({x}, '\\[(INST\\]|/INST\\])', '&#91;\\1', 'g')"


_OP6 = f"""
with t as (
  select conv_id, turn, role, text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), o as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i,
    count(*) over (partition by conv_id) as n, coalesce(role, '') as role, coalesce(text, '') as text from t
), f as (
  select *, length('<|turn|>' || replace({_escape("role")}, chr(10), '&#10;') || chr(10) || {_escape("text")} || '<|end|>' || chr(10)) as size from o
), p as (
  select *, sum(size) over (partition by conv_id order by i) as upto from f
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant' or i = n), 0)::bigint as formatted_chars
from p group by conv_id
"""

_OP12 = """
with d as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents
), h as (
  select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u,
    ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4
  from d
), c as (
  select doc_id, t, u, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when t = '' or regexp_matches(t, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from h
), p as (
  select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""

#: CRC-32 of the ASCII text k, a bit at a time.
_CRC = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda x: unicode(x)::bigint),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

_OP13 = rf"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    crc32_code as code from (
      select *, {_CRC} % 20 as crc32_code from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations))
), hurt as (
  select conv_id, turn, case code when 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from raw, (values (1), (2)) as copies(k) where code <> 0 and (k = 1 or code = 3)
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hurt
), f as (
  select *, left(role, 1) as l, lag(left(role, 1)) over (partition by conv_id order by i) as before,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when regexp_extract(text, '([^\x20\x09-\x0D]){_SPACE}*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from o
), inserts(st, k, mid, told) as (
  values ('0', 0, '0', ''), ('0', 1, 'u', 'user:|'), ('0', 2, 'a', 'user:|assistant:|'), ('s', 0, 's', ''), ('s', 1, 'u', 'user:|'), ('s', 2, 'a', 'user:|assistant:|'),
    ('u', 0, 'u', ''), ('u', 1, 'a', 'assistant:|'), ('u', 2, 'u', 'assistant:|user:|'), ('a', 0, 'a', ''), ('a', 1, 'u', 'user:|'), ('a', 2, 'a', 'user:|assistant:|')
), edits(mid, e, l, nxt, gives) as (
  values ('0', 'K', 's', 's', ''), ('0', 'K', 'u', 'u', ''), ('s', 'K', 'u', 'u', ''), ('u', 'K', 'a', 'a', ''), ('a', 'K', 'u', 'u', ''),
    ('0', 'R', '', 'u', 'user'), ('s', 'R', '', 'u', 'user'), ('u', 'R', '', 'a', 'assistant'), ('a', 'R', '', 'u', 'user'),
    ('0', 'D', '', '0', ''), ('s', 'D', '', 's', ''), ('u', 'D', '', 'u', ''), ('a', 'D', '', 'a', '')
), walk as (
  select conv_id, 0::bigint as i, '0' as st, {{'cost': 0::bigint, 'audit': '', 'told': ''}} as best from (select distinct conv_id from conversations)
  union all
  select w.conv_id, f.i, e.nxt as st, min({{
      'cost': (w.best.cost + 3 * n.k + case e.e when 'D' then 4 when 'R' then 3 else 0 end + case when e.e <> 'D' and f.fault = 'truncated' then 3 else 0 end)::bigint,
      'audit': w.best.audit || repeat('I', n.k) || e.e,
      'told': w.best.told || replace(n.told, '|', chr(10)) || case e.e when 'K' then f.role || ':' || f.text || chr(10) when 'R' then e.gives || ':' || f.text || chr(10) else '' end}}) as best
  from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join inserts n on n.st = w.st
    join edits e on e.mid = n.mid and (e.e = 'D' or (f.fault not in ('blank', 'duplicate') and (e.e = 'R' or e.l = f.l)))
  group by w.conv_id, f.i, e.nxt
), sizes as (
  select conv_id, max(i) as n from walk group by conv_id
), done as (
  select w.conv_id, min({{'cost': w.best.cost + 3 * n.k, 'audit': w.best.audit || repeat('I', n.k), 'told': w.best.told || replace(n.told, '|', chr(10))}}) as best
  from walk w join sizes s on s.conv_id is not distinct from w.conv_id and s.n = w.i join inserts n on n.st = w.st and n.mid in ('0', 'a') group by w.conv_id
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || l not in ('su', 'ua', 'au')) as illegal from f group by conv_id
)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, d.best.cost::bigint as cost, d.best.audit as audit, sha256(regexp_replace(d.best.told, chr(10) || '$', '')) as repaired_sha256
from done d left join counts c on c.conv_id is not distinct from d.conv_id
"""

ORACLES: dict[str, str] = {"op2_line_frequency": _OP2, "op3_warc_transactions": _OP3, "op4_line_runs": _OP4, "op6_prefix_targets": _OP6, "op12_distinct_index": _OP12, "op13_rank_dp": _OP13}
