"""DuckDB counterparts of the conversation trie and of the vector codes."""

from __future__ import annotations

from perchero.llm.codebooks import ENTRIES, PARTS, ROUNDS, SCALE


def _nearest(name: str, books: str) -> str:
    return f"""
{name} as materialized (
  select vec_id, p, min(struct_pack(d := list_sum(list_transform(
    range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))), e := e)) as m
  from (select vec_id, p, v from x) x join (select p, e, v from {books}) b using (p) group by vec_id, p),"""


def _moved(name: str, nearest: str, books: str) -> str:
    return f"""
{name} as materialized (
  select b.p as p, b.e as e, coalesce(n.v, b.v) as v
  from {books} b left join (
    select p, e, list(y order by j) as v from (
      select p, e, j, cast(floor(cast(sum(y) as double) / count(*)) as bigint) as y from (
        select p, a.m.e as e, unnest(range(1, len(x.v) + 1)) as j, unnest(x.v) as y
        from {nearest} a join x using (vec_id, p)) group by p, e, j) group by p, e) n
  on n.p = b.p and n.e = b.e),"""


def codes() -> str:
    steps = "".join(
        _nearest(f"a{k}", f"b{k}") + _moved(f"b{k + 1}", f"a{k}", f"b{k}") for k in range(ROUNDS))
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda c: cast(floor(cast(c as double) * {SCALE}) as bigint)) as w
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (
  select vec_id, p, w[p * len(w) // {PARTS} + 1:(p + 1) * len(w) // {PARTS}] as v
  from (select vec_id, w, unnest(range({PARTS})) as p from kept)),
b0 as materialized (
  select p, e, v from x join (
    select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit {ENTRIES})
    using (vec_id)),{steps}{_nearest("last", f"b{ROUNDS}")}
book as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as sha from b{ROUNDS}),
rows as (
  select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error
  from last join kept using (vec_id) group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  sha as codebooks_sha256
from rows cross join book
"""


def trie() -> str:
    words = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    return f"""
with recursive ids as (
  select conv_id, cast(conv_id as varchar) as s from conversations where conv_id is not null group by conv_id),
crc as (
  select conv_id, s, 0 as i, cast(4294967295 as bigint) as v from ids
  union all
  select conv_id, s, i + 1, xor(w >> 1, case when w & 1 = 1 then 3988292384 else 0 end)
  from (select conv_id, s, i, case when i % 8 = 0 then xor(v, ascii(s[i // 8 + 1])) else v end as w
        from crc where i < 8 * len(s))),
heads as (
  select conv_id, xor(v, 4294967295) % 4 as h, conv_id - ((conv_id % 20) + 20) % 20 as head
  from crc where i = 8 * len(s)),
own as (
  select conv_id, role, text, row_number() over (
    partition by conv_id order by turn nulls first, role, text) as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
        from conversations where conv_id is not null)),
turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by pos) as d from (
    select o.conv_id as conv_id, pos, role, text from own o join heads h on o.conv_id = h.conv_id and pos > h
    union all
    select h.conv_id as conv_id, pos, role, text from heads h join own o on o.conv_id = h.head and pos <= h)),
prefix as materialized (
  select conv_id, d, {words} as words,
    list(struct_pack(r := role, t := text)) over (partition by conv_id order by d) as k from turns),
node as materialized (
  select min(conv_id) as conv_id, d, k, count(*) as n_convs, max(words) as words from prefix group by d, k),
member as materialized (
  select p.conv_id as conv_id, p.d as d, n.conv_id as node from prefix p join node n on p.d = n.d and p.k = n.k
  union all
  select conv_id, 0, (select min(conv_id) from ids) from ids),
every as (
  select conv_id, d, n_convs, words from node
  union all select min(conv_id), 0, count(*), 0 from ids having count(*) > 0),
parents as (
  select e.conv_id as conv_id, e.d as d, m.node as parent
  from every e left join member m on m.conv_id = e.conv_id and m.d = e.d - 1),
kids as (select parent, d - 1 as d, count(*) as n from parents where d > 0 group by parent, d),
sums as (
  select m.node as node, m.d as d, sum(case when k.n is null then 1 else 0 end) as n_leaves,
    sum((e.n_convs - 1) * e.words) as saved
  from every e join member m on m.conv_id = e.conv_id and m.d <= e.d
  left join kids k on k.parent = e.conv_id and k.d = e.d group by m.node, m.d),
last as (select conv_id, max(d) as d from member group by conv_id),
ends as (
  select node, m.d as d, string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id) as ids
  from member m join last l on l.conv_id = m.conv_id and l.d = m.d group by node, m.d)
select e.conv_id as conv_id, e.d as depth, p.parent as parent_conv_id, e.n_convs as n_convs,
  coalesce(k.n, 0) as n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens,
  sha256(coalesce(x.ids, '')) as ends_sha256
from every e join parents p on p.conv_id = e.conv_id and p.d = e.d
join sums s on s.node = e.conv_id and s.d = e.d
left join kids k on k.parent = e.conv_id and k.d = e.d left join ends x on x.node = e.conv_id and x.d = e.d
"""
