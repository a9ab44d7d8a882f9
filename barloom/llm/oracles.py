"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

MIX = f"""
with d0 as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size, coalesce(doc_id::varchar, '-' || md5(coalesce(text, ''))) as name from documents),
d as (select *, ('0x' || md5('shard 0 ' || name)[1:15])::bigint as sh, ('0x' || md5('order 0 ' || name)[1:15])::bigint as place from d0),
d2 as (select *, sh % greatest(1, cast(ceil((select count(*) from documents) / 1000.0) as bigint)) as shard from d),
m as (select shard, source, sum(size)::bigint as words from d2 group by all),
s0 as (select source, sum(words)::bigint as source_size from m group by all),
s1 as (select *, row_number() over (order by source nulls last) as rank from s0),
s2 as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as weight, source_size * 3 as room from s1),
s3 as (select *, row_number() over (order by room::double / weight, rank) as pl,
    cast((sum(source_size) over ())::bigint - coalesce(sum(room) over (order by room::double / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as double)
    / ((sum(weight) over ())::bigint - coalesce(sum(weight) over (order by room::double / weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint)::double as level from s2),
s4 as (select *, coalesce(min(case when room > level * weight then pl end) over (), 1 << 30) as stop from s3),
s5 as (select *, max(case when pl = stop then level end) over () as final from s4),
s as (select source, source_size, rank, case when pl < stop then room::double else weight * final end as target from s5),
q0 as (select m.shard, m.source, words, source_size, rank, target, case when source_size > 0 then target * words / source_size else 0.0::double end as share, cast(ceil(words / 16.0::double) as bigint) as blocks
    from m join s on m.source is not distinct from s.source),
q1 as (select *, sum(share) over (partition by shard order by rank rows between unbounded preceding and unbounded following) as total, count(*) over (partition by shard) as n from q0),
q2 as (select *, cast(round(total / 16) as bigint) as seats, case when total > 0 then share / total else 0.0::double end as part from q1),
q3 as (select *, cast(least(blocks * 3, greatest(0, floor(part * (seats - n / 2.0::double)) - 1)) as bigint) as low, cast(least(blocks * 3, ceil(part * (seats + n / 2.0::double)) + 1) as bigint) as high from q2),
q4 as (select *, seats - (sum(low) over (partition by shard))::bigint as open from q3),
b as (select *, unnest(case when high > low then range(low, high) else [-1] end) as k from q4),
w as (select *, row_number() over (partition by shard order by case when k >= 0 then share / (2 * k + 1) else -1 end desc, rank, k) <= open and k >= 0 as won from b),
q as (select shard, source, source_size, target, rank, greatest(blocks, 1) as blocks, low + count(*) filter (won) as quota from w group by shard, source, source_size, target, rank, blocks, low),
e as (select *, (sum(size) over (partition by shard, source order by place, doc_id, size rows between unbounded preceding and current row))::bigint as "end" from d2),
u as (select *, quota // blocks as repeats, quota % blocks as extra, case when quota % blocks > 0
    then list_sort(list_transform(range(blocks), lambda x: ('0x' || md5('block 0 ' || shard || ' ' || rank || ' ' || x)[1:15])::bigint))[quota % blocks] end as upto from q),
t as (select e.doc_id, e.size, q.source_size, q.target, e.shard, "end" - size as start, "end", rank, repeats, extra, upto
    from e join u q on e.shard = q.shard and e.source is not distinct from q.source),
c as (select *, list_filter(range(start // 16, case when size > 0 and extra > 0 then ("end" - 1) // 16 + 1 else start // 16 end), lambda x: ('0x' || md5('block 0 ' || shard || ' ' || rank || ' ' || x)[1:15])::bigint <= upto) as got from t)
select doc_id, size::bigint as size, source_size, target, (size * repeats + coalesce(list_sum(list_transform(got, lambda x: least("end", (x + 1) * 16) - greatest(start, x * 16))), 0))::bigint as taken, shard, len(got)::int as n_spans from c
"""

LINES = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as no from documents),
b as (select *, regexp_matches(line, '[^ \t\n\f\r\x0B]') as solid from l),
f as (select line, min((doc_id, no)) as pos, length(line) as n from b where solid group by line),
near as (select distinct x.line from f x join f y on y.n between x.n - 1 and x.n + 1 and y.pos < x.pos
    and (left(x.line, (greatest(x.n, y.n) - 1) // 2) = left(y.line, (greatest(x.n, y.n) - 1) // 2)
      or right(x.line, greatest(x.n, y.n) - 1 - (greatest(x.n, y.n) - 1) // 2) = right(y.line, greatest(x.n, y.n) - 1 - (greatest(x.n, y.n) - 1) // 2))
    where len(list_filter(range(1, greatest(x.n, y.n) + 1), lambda i: left(x.line, i - 1) = left(y.line, i - 1)
      and substring(x.line, i + (case when x.n >= y.n then 1 else 0 end)) = substring(y.line, i + (case when y.n >= x.n then 1 else 0 end)))) > 0),
k as (select b.* from b left join f on b.line = f.line left join near on b.line = near.line where not solid or ((b.doc_id, b.no) = f.pos and near.line is null)),
g as (select doc_id, string_agg(line, chr(10) order by no) as text, count(*) as n from k group by 1)
select d.doc_id, length(coalesce(g.text, ''))::bigint as kept_chars, sha256(coalesce(g.text, '')) as kept_sha256, greatest(1, coalesce(g.n, 1))::int as kept_lines
from documents d left join g using (doc_id)
"""

CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
    length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 14 as chars from t),
c as (select *, (sum(chars) over (partition by conv_id order by i))::bigint as upto from n)
select conv_id, max(n)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
    (sum(upto) filter (role = 'assistant' or i = n))::bigint as formatted_chars, count(*) filter (role = 'assistant' or i = n) as n_examples
from c group by conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
with d as (select doc_id, row_number() over () as r, {_TERMS} as terms from documents),
n as (select doc_id, r, len(terms)::bigint as n from d where len(terms) > 0),
g as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
q as (select item_id, term, count(*)::bigint as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*)::bigint as df from tf group by term), g),
s as (select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
    from tf join q using (term) join w using (term) join n using (r), g group by all),
k as (select *, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 20
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = rf"""
with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
i as (select coalesce(item_id::varchar, '') as id, {_WORDS} as w from benchmark),
u as (select distinct id, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) as span from i where len(w) > 0),
p as (select r, n, w, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from u)),
o as (select r, n, s, id from (select r, n, s, array_to_string(w[s:s + n - 1], ' ') as span from p) join u using (n, span)),
h as (select r, count(distinct x)::bigint as n_hit from (select distinct r, unnest(range(s, s + n)) as x from o) group by r),
t as (select r, count(*)::bigint as n_items, sha256(string_agg(id, ',' order by id)) as sha from (select distinct r, id from o) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join t using (r)
"""

TRIE = r"""
with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from conversations where conv_id is not null),
n as (select conv_id, count(*)::bigint as n, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when (a & 1) = 1 then 3988292384::bigint else 0::bigint end) end), 4294967295::bigint) % 9 as h from o group by conv_id),
b as (select n.*, coalesce(m.n, 0) as n_base from n left join n m on m.conv_id = n.base),
r as (select b.conv_id, i as d, role, text from b join o on o.conv_id = base where i <= h
    union all select conv_id, least(h, n_base) + i - h, role, text from b join o using (conv_id) where i > h),
p as (select conv_id, d, sha256(string_agg(concat(length(role), ' ', role, length(text), ' ', text), '' order by d) over (partition by conv_id order by d)) as k,
    coalesce(lag(d) over (partition by conv_id order by d), 0) as before, octet_length(encode(text))::bigint as bytes, d = max(d) over (partition by conv_id) as last from r
    union all select conv_id, 0, '', null, 0, conv_id not in (select conv_id from r) from n),
v as (select k, d, min(conv_id) as conv_id, count(*)::bigint as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256 from p group by k, d),
e as (select v.k, v.d, q.k as parent from v join p q on q.conv_id = v.conv_id and q.d = v.d - 1),
c as (select parent as k, count(*)::bigint as n_children from e group by parent),
w as (select v.*, coalesce(n_children, 0) as n_children from v left join c using (k)),
s as (select p.k, (count(*) filter (n_children = 0))::bigint as n_leaves, sum((n_convs - 1) * w.bytes)::bigint as saved_tokens from w join p on p.conv_id = w.conv_id and p.d <= w.d group by p.k)
select w.conv_id, w.d::bigint as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
from w join s using (k) left join e on e.k = w.k left join v u on u.k = e.parent
"""

AUDIO = None

ORACLES = {"op4_source_mix": MIX, "op7_line_dedup": LINES, "op10_chat_prefixes": CHAT, "op11_lexical_search": SEARCH, "op12_winnowing": LEAKS, "op13_prefix_trie": TRIE}
