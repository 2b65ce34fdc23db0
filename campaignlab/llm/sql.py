"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from campaignlab.llm.chat import ESCAPE
from campaignlab.llm.mixing import OTHER, STEP, TERMS


def mix(weights: dict[str, float], epochs: float = 1.0, seed: str = "mix") -> str:
    named = ", ".join(f"'{k}'" for k in weights if k != OTHER)
    shares = ", ".join(f"('{k}', {v!r}::double)" for k, v in weights.items())
    return f"""
with docs as (
  select doc_id, source, text, coalesce(cast(doc_id as varchar), 'null') uid,
         case when source in ({named}) then source else '{OTHER}' end grp from documents),
sizes as (select grp, coalesce(sum(length(text)), 0)::double size from docs group by grp),
shares(grp, share) as (values {shares}),
wanted as (select z.grp, size, case when size > 0 then coalesce(share, 0) else 0 end want
           from sizes z left join shares s on z.grp = s.grp),
rates as (select grp, case when size = 0 then 1.0
                 else coalesce(want / nullif(sum(want) over (), 0) * sum(size) over () * {epochs} / size, {epochs}) end rate
          from wanted),
drawn as (select grp, rate, greatest(1, ceil(rate / {STEP}))::bigint draws from rates),
terms as (select grp, rate / draws mean, unnest(range(0, {TERMS + 1})) k from drawn),
mass as (select grp, k, case when k = 0 then exp(-mean) when mean = 0 then 0
                else exp(-mean + k * ln(mean) - lgamma(k + 1.0)) end p from terms),
cdf as (select grp, sum(p) over (partition by grp order by k) c from mass),
lists as (select grp, list(c) cdf from cdf group by grp),
draws as (select d.*, cdf, unnest(range(1, draws + 1)) j from docs d join drawn using (grp) join lists using (grp)),
counted as (
  select doc_id, source, text, j,
         len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{seed}:' || uid || ':' || j), 1, 13))::bigint / 4503599627370496.0)) n
  from draws),
total as (select doc_id, source, text, sum(n)::bigint n from counted group by all)
select doc_id, source, unnest(range(1, n + 1))::int as copy, strlen(text)::bigint as n_bytes from total where n > 0
"""


ROLE = "coalesce(role, '')"
TEXT = "coalesce(text, '')"
CHAT = f"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg({ROLE} || chr(10) || {TEXT} || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length({TEXT})) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg({TEXT}, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(24 + length({ROLE}) + length({TEXT}) + len(regexp_extract_all({TEXT}, '{ESCAPE}')))::bigint as formatted_chars
from rows group by conv_id
"""

DECONTAMINATE = r"""
with lowered as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
doc_words as (select doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from lowered),
items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
parts as (select item_id, w, least(10, len(w)) m, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items where len(w) > 0),
strings as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') s from parts),
sizes as (select distinct m from strings),
places as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from doc_words, sizes where len(w) >= m),
found as (select doc_id, i, p.m, item_id from (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') s from places) p
          join strings using (m, s)),
hits as (select doc_id, count(distinct place) n from (select doc_id, unnest(range(i, i + m)) place from found) group by doc_id),
ids as (select doc_id, count(distinct item_id) n, array_to_string(list_sort(list(distinct item_id::varchar)), ',') ids
        from found group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from doc_words d left join hits h using (doc_id) left join ids i using (doc_id)
"""

WHOLE = """select row_number() over () as uid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)"""

TOP_K = f"""
with rows as ({WHOLE}),
scored as (
  select q.uid, q.vec_id as query_id, c.vec_id, c.uid as other, list_dot_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.uid <> c.uid where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by uid order by score desc, vec_id nulls last, other)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

HARD_NEGATIVES = f"""
with whole as ({WHOLE}),
rows as (select uid, vec_id, v, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label
         from whole where label is not null),
scored as (
  select a.uid, a.vec_id as anchor_id, a.label = c.label as same, c.uid as other, c.vec_id as id,
         list_dot_product(a.v, c.v)::bigint as score
  from rows a join rows c on a.uid <> c.uid where a.vec_id % 100 = 0),
positives as (
  select * from (select *, row_number() over (partition by uid order by score desc, id nulls last, other) as n
                 from scored where same) where n <= 5),
ranked as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.uid, p.other order by s.score desc, s.id nulls last, s.other)::int as rank
  from positives p join scored s on p.uid = s.uid and not s.same
    and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
