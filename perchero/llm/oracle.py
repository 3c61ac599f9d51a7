"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from perchero.llm.oracle_more import codes, trie

WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

DECONTAMINATION = f"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select cast(item_id as varchar) as item_id, {WORDS} as w from benchmark),
i as (select item_id, w, least(len(w), 13) as size from b where len(w) > 0),
win as (
  select distinct item_id, size, array_to_string(w[s:s + size - 1], ' ') as win
  from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as s from i)),
sizes as (select distinct size from win),
runs as (
  select doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s
        from d cross join sizes where len(w) >= size)),
found as (select doc_id, s, runs.size as size, item_id from runs join win using (win)),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + size)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from found) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


JACCARD = f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[s:s + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as s from d where len(w) > 0)),
size as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
linked as (
  select a, b, p.n = x.n and p.n = y.n as same
  from pairs p join size x on x.doc_id = a join size y on y.doc_id = b where 9 * p.n >= 4 * (x.n + y.n)),
reach as (
  select a, b from linked union select r.a, l.b from reach r join linked l on r.b = l.a),
class as (select a as doc_id, min(b) as low from reach group by a),
same as (select a as doc_id, min(b) as low from linked where same group by a),
n as (select a as doc_id, count(*) as n_links from linked group by a)
select d.doc_id, least(d.doc_id, coalesce(class.low, d.doc_id)) as class_id,
  coalesce(n_links, 0) as n_links, least(d.doc_id, coalesce(same.low, d.doc_id)) as copy_of,
  coalesce(size.n, 0) as n_shingles
from d left join class using (doc_id) left join same using (doc_id) left join n using (doc_id)
left join size using (doc_id)
"""


def oracle() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": JACCARD,
        "op10_benchmark_decontamination": DECONTAMINATION,
        "op11_conversation_trie": trie(),
        "op12_vector_codes": codes(),
    }
