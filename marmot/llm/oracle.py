"""DuckDB SQL for the queries of this subpackage whose result SQL can express."""

from __future__ import annotations

OP7 = r"""
with words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from documents),
item_words as (
    select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from benchmark where item_id is not null),
sized as (select item_id, w, least(10, len(w)) as k from item_words where len(w) > 0),
windows as (
    select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as win
    from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from sized)),
ks as (select distinct k from windows),
places as (
    select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as win
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, ks where len(w) >= k)),
found as (select doc_id, i, p.k, item_id from places p join windows v on p.k = v.k and p.win = v.win),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from found) group by doc_id),
items as (
    select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
    from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join items using (doc_id)
"""

OP1 = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents),
sh as (
    select distinct doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') as s
    from (select doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
inter as (
    select a.doc_id as a, b.doc_id as b, count(*) as i
    from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
    select a, b from inter join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * i >= 80 * (x.n + y.n - i)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
    select doc_id, doc_id from words
    union
    select r.doc_id, e.b from reach r join edges e on r.other = e.a),
comp as (select doc_id, min(other) as component_id from reach group by doc_id)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, w.doc_id = component_id as kept
from words w join comp using (doc_id) left join sizes using (doc_id)
"""

OP2 = r"""
with words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from documents),
stats as (select cast(count(*) as double) as n, greatest(1.0, cast(sum(len(w)) as double) / count(*)) as mean from words),
tfs as (select doc_id, len, word, cast(count(*) as double) as tf from (select doc_id, len(w) as len, unnest(w) as word from words) group by all),
dfs as (select word, cast(count(*) as double) as df from tfs group by word),
query as (select doc_id as query_id, word, df from tfs join dfs using (word) where doc_id % 50 = 0),
scores as (
    select query_id, doc_id,
           cast(sum(cast(floor(1000000 * (ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) + 0.5) as bigint)) as bigint) as score
    from query join tfs using (word), stats group by all)
select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scores
qualify row_number() over (partition by query_id order by score desc, doc_id) <= 10
"""

OP4 = r"""
with parts as (
    select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as pos
    from documents where text is not null),
lines as (
    select doc_id, pos, x, row_number() over (partition by doc_id order by pos) as idx,
           least(20, 1 + length(trim(x)) - length(replace(trim(x), ' ', ''))) as w
    from parts where trim(x) <> ''),
summed as (select *, sum(w) over (partition by doc_id order by idx) as upto from lines),
runs as (
    select a.doc_id, a.idx as s, min(b.idx) as e
    from summed a join summed b on a.doc_id = b.doc_id and b.idx between a.idx and a.idx + 20 and b.upto - a.upto + a.w >= 20 group by a.doc_id, a.idx
    union
    select a.doc_id, max(a.idx) as s, b.idx as e
    from summed a join summed b on a.doc_id = b.doc_id and b.idx between a.idx and a.idx + 20 and b.upto - a.upto + a.w >= 20 group by a.doc_id, b.idx),
spelled as (
    select r.doc_id, s, e, string_agg(x, chr(10) order by idx) as run
    from runs r join lines l on l.doc_id = r.doc_id and l.idx between s and e group by all),
later as (select * from spelled qualify row_number() over (partition by run order by doc_id, s) > 1),
gone as (select distinct l.doc_id, l.pos from later r join lines l on l.doc_id = r.doc_id and l.idx between s and e),
kept as (
    select p.doc_id, string_agg(p.x, chr(10) order by p.pos) filter (where g.pos is null) as text,
           count(*) filter (where trim(p.x) <> '') as n_lines, count(g.pos) as n_deleted
    from parts p left join gone g on g.doc_id = p.doc_id and g.pos = p.pos group by p.doc_id)
select d.doc_id, case when d.text is not null then coalesce(k.text, '') end as text,
       cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_deleted, 0) as bigint) as n_deleted
from documents d left join kept k using (doc_id)
"""

# control strings and escaping of the chat template: one backslash more between < and |
OP11 = r"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p,
           count(*) over (partition by conv_id) as n,
           length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as chars
    from said),
prefixes as (select *, sum(chars) over (partition by conv_id order by p) as upto from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by p)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by p) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(upto) filter (where role = 'assistant' or p = n) as bigint) as formatted_chars
from prefixes group by conv_id
"""

# the repair as a recursion over rows: per role state (nothing, s, u, a) the least of cost and audit, written so that text order is their order
OP13 = r"""
with recursive fates as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
    from conversations),
crcs as (
    select *, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda c: ascii(c)::bigint),
        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 20 as fate
    from fates),
damaged as (
    select conv_id, turn, case when fate = 4 then 'user' else role end as role,
           case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from crcs, range(2) t(copy) where fate <> 0 and (copy = 0 or fate = 3)),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as p,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ended, left(role, 1) as initial from damaged),
faults as (
    select *, case when ended = '' then 'blank' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'duplicate'
                   when right(ended, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
           lag(initial) over (partition by conv_id order by p) || initial as pair
    from placed),
-- a prefix: cost in ten digits, then the edits; 'X' sorts behind all digits
entry as (
    select conv_id, 0::bigint as p, '0000000000' as c0, 'X' as cs, '0000000005I' as cu, '0000000010II' as ca
    from (select distinct conv_id from damaged)),
steps as (
    select * from entry
    union all
    select conv_id, p, c0, cs, u1 as cu, least(ca, pay(u1, 5, 'I')) as ca
    from (
        select conv_id, p, c0, cs, least(cu, pay(c0, 5, 'I'), pay(cs, 5, 'I'), pay(ca, 5, 'I')) as u1, ca
        from (
            select s.conv_id, f.p,
                   pay(c0, 2, 'D') as c0,
                   least(pay(cs, 2, 'D'), case when kept and initial = 's' then pay(c0, more, 'K') else 'X' end) as cs,
                   least(pay(cu, 2, 'D'), case when kept and initial = 'u' then least(pay(c0, more, 'K'), pay(cs, more, 'K'), pay(ca, more, 'K')) else 'X' end,
                         case when kept then least(pay(c0, 1 + more, 'R'), pay(cs, 1 + more, 'R'), pay(ca, 1 + more, 'R')) else 'X' end) as cu,
                   least(pay(ca, 2, 'D'), case when kept and initial = 'a' then pay(cu, more, 'K') else 'X' end,
                         case when kept then pay(cu, 1 + more, 'R') else 'X' end) as ca
            from steps s join (select *, fault not in ('blank', 'duplicate') as kept, case when fault = 'truncated' then 5 else 0 end as more from faults) f
              on s.conv_id is not distinct from f.conv_id and f.p = s.p + 1))),
ends as (
    select conv_id, least(c0, ca) as best from steps qualify row_number() over (partition by conv_id order by p desc) = 1),
plans as (select conv_id, cast(left(best, 10) as bigint) as cost, substr(best, 11) as audit from ends),
letters as (
    select conv_id, i, substr(audit, i, 1) as e, i - length(replace(left(audit, i), 'I', '')) as inserted
    from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as i from plans)),
walked as (
    select l.conv_id, i, e, f.role, coalesce(f.text, '') as text,
           coalesce(sum(case when e <> 'D' and not (e = 'K' and f.initial = 's') then 1 else 0 end)
                    over (partition by l.conv_id order by i rows between unbounded preceding and 1 preceding), 0) as spoken
    from letters l left join faults f on l.conv_id is not distinct from f.conv_id and e <> 'I' and f.p = l.i - l.inserted),
fixed as (
    select conv_id, string_agg(case when e = 'K' then role when spoken % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) as said
    from walked where e <> 'D' group by conv_id),
counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
           count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
           count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
    from faults group by conv_id)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
       sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join counted c on i.conv_id is not distinct from c.conv_id
left join plans p on i.conv_id is not distinct from p.conv_id
left join fixed x on i.conv_id is not distinct from x.conv_id
"""


def _paid(sql: str) -> str:
    """``pay(prefix, cost, edit)`` spelled out: the cost added to the ten digits, the edit to the audit."""
    import re
    one = re.compile(r"pay\((\w+), ([^,()]+), ('\w')\)")
    return one.sub(r"(case when \1 = 'X' then 'X' else lpad(cast(cast(left(\1, 10) as bigint) + \2 as varchar), 10, '0') || substr(\1, 11) || \3 end)", sql)


SQL = {
    "op1_minhash_near_dedup": OP1,
    "op2_exact_search": OP2,
    "op4_line_dedup": OP4,
    "op7_decontamination": OP7,
    "op11_chat_formatting": OP11,
    "op13_structure_repair": _paid(OP13),
}
