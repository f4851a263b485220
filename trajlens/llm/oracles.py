"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "[w for w in string_split_regex(" + _LOWER.format("coalesce(text, '')") + r", '[\x20\x09-\x0D]+') if w <> '']"

OP2 = f"""
with recursive words as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
sets as (
  select r, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) as s from words
),
items as (select r, unnest(s) as item from sets),
shared as (
  select a.r as x, b.r as y, count(*) as i from items a join items b on a.item = b.item and a.r < b.r group by 1, 2
),
links as (
  select x, y from shared join sets a on a.r = x join sets b on b.r = y where 100 * i >= 90 * (len(a.s) + len(b.s) - i)
),
ways as (select x, y from links union all select y, x from links),
reach as (select r as a, r as b from sets union select reach.a, ways.y from reach join ways on ways.x = reach.b)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, min(other.doc_id) as component_id
from sets join reach on reach.a = sets.r join sets other on other.r = reach.b group by sets.r, sets.doc_id, len(sets.s)
"""

_HOST = _LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")
_PATH = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"


def _parts(text: str, sign: str, kind: str) -> str:
    return f"['{kind}' || regexp_replace(x, '[0-9]+', '#', 'g') for x in string_split({text}, '{sign}') if x <> '']"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


OP1 = f"""
with recursive urls as (
  select row_number() over () as r, page_id, {_HOST} as host, {_PATH} as path, case when contains(url, '://') then
    list_sort(list_distinct({_parts(_HOST, '.', 'h:')} || {_parts(_PATH, '/', 'p:')}
      || {_parts("coalesce(regexp_extract(url, '[?]([^#]*)', 1), '')", '&', 'q:')}
      || {_parts("coalesce(regexp_extract(url, '#((?s:.*))', 1), '')", '#', 'f:')})) else [] end as tokens from pages
),
bad as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end) as bad
  from labels where doc_id is not null group by 1
),
taught as (select r, case when bad = 1 then 'block' else 'allow' end as class from urls join bad on page_id = doc_id where bad is not null),
total as (select count(*) as n from taught),
one as (select r, unnest(tokens) as t from urls),
lists as (
  select r, class, needs from (
    select r, class, [t] as needs, count(*) filter (class = 'block') over w as n_block, count(*) filter (class = 'allow') over w as n_allow
    from one join taught using (r) window w as (partition by t)
  ) where greatest(n_block, n_allow) >= (select ceil(0.005 * n) from total)
  union all
  select r, class, needs from (
    select l.r, l.class, list_append(l.needs, o.t) as needs, count(*) filter (l.class = 'block') over w as n_block,
      count(*) filter (l.class = 'allow') over w as n_allow
    from lists l join one o on o.r = l.r and o.t > l.needs[len(l.needs)] window w as (partition by list_append(l.needs, o.t))
  ) where greatest(n_block, n_allow) >= (select ceil(0.005 * n) from total)
),
counted as (
  select needs, count(*) as n_needs, count(*) filter (class = 'block') as n_block, count(*) filter (class = 'allow') as n_allow
  from lists group by 1
),
classes as (select class, count(*) as n_class from taught group by 1),
ruled as (
  select needs, class, case class when 'block' then n_block else n_allow end as n_both, n_needs, n_class, n
  from counted cross join classes cross join total
),
rules as (
  select needs, class, cast(n_both as double) / n_needs as confidence, cast(n_both as double) / n as support from ruled
  where n_both >= ceil(0.005 * n) and cast(n_both as double) / n_needs >= 0.4
    and (cast(n_both as double) / n_needs) / (cast(n_class as double) / n) >= 1.1
),
best as (
  select r, first(struct_pack(rule_id := array_to_string(needs, ' '), class := class, confidence := confidence)
    order by confidence desc, support desc, len(needs) desc, array_to_string(needs, ' '), class) as best
  from urls join rules on list_has_all(tokens, needs) group by 1
),
housed as (
  select *, case when {_fits('www.example.com', '/en/')} then 'www.example.com/en/' when {_fits('example.com', '/en/')} then 'example.com/en/'
    when {_fits('net', '/es/')} then 'net/es/' when {_fits('net', '/fr/')} then 'net/fr/' when {_fits('com', '/')} then 'com/' end as rule
  from urls
)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' else coalesce(best.class, 'allow') end as verdict,
  best.rule_id as learned_rule, best.confidence as confidence
from housed left join best using (r)
"""


def _level(name: str, parent: str, keys: str, weight: str, source: str) -> str:
    """Common table expressions of one level of water-filling."""
    return f"""
{name}_0 as (
  select {keys}, sum(tokens) * 2 as cap, sum(tokens) as tokens, any_value(given) as given, any_value(cast({weight} as double)) as weight
  from {source} group by {keys}
),
{name}_1 as (
  select *, cast(given - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as double)
      / sum(weight) over (o rows between current row and unbounded following) as rate
  from {name}_0 window o as (partition by {parent} order by cast(cap as double) / weight, {keys.split(', ')[-1]})
),
{name} as (
  select {keys}, tokens, case when rate >= cast(cap as double) / weight then cap
    else cast(floor(greatest(max(case when rate < cast(cap as double) / weight then rate end) over (partition by {parent}), 0.0) * weight) as bigint)
    end as budget
  from {name}_1
)"""


OP8 = f"""
with rows as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t,
    case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
      else 'd' || (cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint) % 3) end as domain,
    len([w for w in string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') if w <> '']) as tokens
  from documents
),
drawn as (select * from rows where tokens > 0),
leaf as (select domain, lang, source, cast(sum(tokens) as bigint) as tokens from drawn group by all),
top as (select leaf.*, cast((select sum(tokens) from leaf) as bigint) as given from leaf),
{_level('by_domain', '1', 'domain', "case domain when 'd0' then 5 when 'd1' then 3 when 'd2' then 2 else 1 end", 'top')},
under_domain as (select leaf.*, budget as given from leaf join by_domain using (domain)),
{_level('by_lang', 'domain', 'domain, lang', "case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end", 'under_domain')},
under_lang as (select leaf.*, budget as given from leaf join by_lang using (domain, lang)),
{_level('by_source', 'domain, lang', 'domain, lang, source', '1', 'under_lang')},
shares as (select *, cast(budget // tokens as bigint) as whole, cast(budget % tokens as bigint) as part from by_source),
placed as (
  select d.*, whole, part,
    sum(d.tokens) over (partition by domain, lang, source order by md5('7:' || whole || ':' || coalesce(cast(doc_id as varchar), 'null')),
      doc_id, d.tokens, md5(t) rows between unbounded preceding and current row) - d.tokens as start
  from drawn d join shares s using (domain, lang, source)
),
taken as (
  select domain, lang, source, doc_id, tokens, unnest(range(whole)) as epoch, tokens as tokens_taken from placed
  union all
  select domain, lang, source, doc_id, tokens, whole, least(tokens, part - start) from placed where start < part
)
select domain, lang, source, doc_id, cast(tokens as bigint) as tokens, cast(epoch as bigint) as epoch, cast(tokens_taken as bigint) as tokens_taken
from taken
"""

def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    step = "case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end"
    bits = f"list_reduce(list_prepend(xor(c, b), [cast(0 as ubigint) for z in range(8)]), lambda a, z: {step})"
    codes = f"[cast(ascii(x) as ubigint) for x in string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as ubigint), {codes}), lambda c, b: {bits}), 4294967295)"


OP12 = rf"""
with recursive base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fate
  from conversations
),
turns as (
  select conv_id, turn, case fate when 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case fate when 3 then [1, 2] else [1] end) as copy
  from base where fate <> 0
),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from turns),
seen as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as repeated,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') as seen_text
  from placed
),
faults as (
  select conv_id, turn, role, text, i, left(role, 1) as sign, lag(left(role, 1)) over (partition by conv_id order by i) as before,
    case when seen_text = '' then 'blank' when repeated then 'duplicate' when right(seen_text, 1) not in ('.', '!', '?') then
    'truncated' end as fault
  from seen
),
figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || sign not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faults group by conv_id
),
inserts(q, letters, q_mid, added, lines) as (
  select q, '', q, 0, cast([] as varchar[]) from (values (0), (1), (2), (3)) t(q) union all values
  (0, 'I', 2, 5, ['user:']), (1, 'I', 2, 5, ['user:']), (2, 'I', 3, 5, ['assistant:']), (3, 'I', 2, 5, ['user:']),
  (0, 'II', 3, 10, ['user:', 'assistant:']), (1, 'II', 3, 10, ['user:', 'assistant:']), (2, 'II', 2, 10, ['assistant:', 'user:']),
  (3, 'II', 3, 10, ['user:', 'assistant:'])
),
signs(q_mid, sign, q_next, role) as (values
  (0, 's', 1, null), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')
),
edits as (
  select conv_id, i, q_mid, q_next, 'K' as letter, case when fault = 'truncated' then 5 else 0 end as cost, [f.role || ':' || text] as line
  from faults f join signs using (sign) where fault is null or fault = 'truncated' union all
  select conv_id, i, q_mid, q_next, 'R', case when fault = 'truncated' then 6 else 1 end, [s.role || ':' || text]
  from faults f join signs s on s.role is not null where fault is null or fault = 'truncated' union all
  select conv_id, i, q, q, 'D', 2, cast([] as varchar[]) from faults, (values (0), (1), (2), (3)) t(q)
),
paths as (
  select conv_id, cast(0 as bigint) as i, 0 as q, 0 as cost, '' as audit, cast([] as varchar[]) as lines from figures union all
  select conv_id, i, q, cost, audit, lines from (
    select p.conv_id, e.i, e.q_next as q, p.cost + n.added + e.cost as cost, p.audit || n.letters || e.letter as audit,
      p.lines || n.lines || e.line as lines,
      row_number() over (partition by p.conv_id, e.q_next order by p.cost + n.added + e.cost, p.audit || n.letters || e.letter) as k
    from paths p join inserts n on n.q = p.q
    join edits e on e.conv_id is not distinct from p.conv_id and e.i = p.i + 1 and e.q_mid = n.q_mid
  ) where k = 1
),
ends as (
  select p.conv_id, p.cost + n.added as cost, p.audit || n.letters as audit, p.lines || n.lines as lines, f.gaps, f.blank, f.duplicate,
    f.truncated, f.illegal,
    row_number() over (partition by p.conv_id order by p.cost + n.added, p.audit || n.letters) as k
  from paths p join figures f on f.conv_id is not distinct from p.conv_id and f.n = p.i join inserts n on n.q = p.q
  where n.q_mid in (0, 3)
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost,
  coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join (select * from ends where k = 1) e on e.conv_id is not distinct from c.conv_id
"""

OP13 = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t
  from conversations where conv_id is not null
),
own as (
  select conv_id, list(t order by place) as turns, cast({_crc32("cast(conv_id as varchar)")} % 6 as bigint) as h from turns group by conv_id
),
members as (
  select o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:len(o.turns)]) as path
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100
),
nodes as (
  select path[1:d] as path, d, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(m.path) = d), '') as ids,
    (count(*) - 1) * coalesce(any_value(length(m.path[d].text)) filter (d > 0), 0) as saved
  from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from members) m group by path[1:d], d
),
kids as (select path[1:d - 1] as up, d - 1 as up_d, count(*) as n from nodes where d > 0 group by all),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids on up = path and up_d = d),
under as (
  select path[1:e] as up, e, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens
  from (select *, unnest(range(0, d + 1)) as e from full_nodes) group by all
)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, u.n_leaves,
  cast(u.saved_tokens as bigint) as saved_tokens, sha256(n.ids) as ends_sha256
from full_nodes n join under u on u.up = n.path and u.e = n.d left join nodes p on n.d > 0 and p.path = n.path[1:n.d - 1] and p.d = n.d - 1
"""

ORACLES = {
    "op1_url_rules": OP1, "op2_ngram_jaccard": OP2, "op8_source_mixing": OP8, "op12_conversation_repair": OP12,
    "op13_conversation_trie": OP13,
}
