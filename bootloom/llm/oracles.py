"""SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from bootloom.llm import filter_audit, fingerprints, licenses, mixing
from bootloom.llm.common import LOWER, PLAIN_WORD, SPACED_WORD, UPPER
from bootloom.llm.decontamination import WINDOW


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}')"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


DECONTAMINATION = f"""
with docs as (select doc_id, {words("text")} as w from documents),
items as (select item_id, {words("text")} as w from benchmark),
sized as (select item_id, w, least({WINDOW}, len(w)) as m from items where len(w) > 0),
windows as (
  select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as x
  from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i from sized)),
places as (
  select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as x
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i
        from docs, (select distinct m from windows) where len(w) >= m)),
found as (select doc_id, i, p.m, item_id from places p join windows v on p.m = v.m and p.x = v.x),
hit as (select doc_id, count(distinct k) as n
        from (select doc_id, unnest(range(i, i + m)) as k from found) group by doc_id),
listed as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(l.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs d left join hit h on d.doc_id = h.doc_id left join listed l on d.doc_id = l.doc_id
"""


def _licenses() -> str:
    templates = ", ".join(
        f"({i}, '{label}', {quoted(sorted(licenses.template_words(text)))}, {len(licenses.words_of(text))})"
        for i, (label, text) in enumerate(licenses.TEMPLATES)
    )
    phrases = " union all ".join(
        f"select doc_id, i - 1 as start, '{label}' as label from spots "
        f"where i + {len(p) - 1} <= len(w) and w[i : i + {len(p) - 1}] = {quoted(p)}"
        for p, label in ((phrase.split(" "), label) for phrase, label in licenses.PHRASES.items())
    )
    enough = f">= {licenses.THRESHOLD} * len(t) - 1e-9"
    return f"""
with docs as (select doc_id, {words("text")} as w from documents),
spots as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from docs),
base as ({phrases}),
placed as (select doc_id, count(*) as n, min(start) as a, max(start) as b,
             string_agg(distinct label, ',' order by label) as labels from base group by doc_id),
templates(id, label, t, size) as (values {templates}),
likely as (select doc_id, w, label, t, size from docs, templates where len(list_intersect(w, t)) {enough}),
starts as (select doc_id, w, label, t, size, unnest(range(1, len(w) + 1)) as i from likely),
blocks as (select doc_id, label, t, i, w[i : i + size - 1] as block from starts where list_contains(t, w[i])),
met as (
  select doc_id, label, i as first, len(list_intersect(block, t)) as shared, len(list_intersect(block, t)) / len(t) as share,
    i - 1 + list_max(list_filter(range(1, len(block) + 1), lambda k: list_contains(t, block[k]))) as last
  from blocks where len(list_intersect(block, t)) {enough}),
near as (
  select doc_id, label, share from met x where not exists (
    select 1 from met y where y.doc_id = x.doc_id and y.label <> x.label and y.first <= x.last and x.first <= y.last
      and (y.share > x.share or (y.share = x.share and y.shared > x.shared)))),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels
          from (select doc_id, label from base union select doc_id, label from near) group by doc_id),
best as (select doc_id, max(share) as share from near group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(p.n, 0)::bigint as n_base, a::bigint as first_word,
  b::bigint as last_word, coalesce(p.labels, '') as base_labels, coalesce(e.labels, '') as labels,
  case when p.n > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from docs d left join placed p on d.doc_id = p.doc_id left join every e on d.doc_id = e.doc_id
  left join best s on d.doc_id = s.doc_id
"""


def _fingerprints() -> str:
    shares = [share for share in fingerprints.SHARES for _ in range(fingerprints.SUBSETS)]
    subsets = ", ".join(f"({i}, {i // 8}, {4 * (i % 8) + 1}, {int(share * 65536)})" for i, share in enumerate(shares))
    n = len(shares)

    def like(a: str, b: str) -> str:
        asked = f"len(list_filter(range(1, {n + 2}), lambda i: {a}[i] <> '' or {b}[i] <> ''))"
        same = f"len(list_filter(range(1, {n + 2}), lambda i: {a}[i] <> '' and {a}[i] = {b}[i]))"
        return f"case when {a} = {b} then 1.0::double when {asked} = 0 then 0.0::double else {same} / {asked} end"

    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
near as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first(text) over (order by doc_id)) as after,
           coalesce(lead(doc_id) over (order by doc_id), first(doc_id) over (order by doc_id)) as next_id from docs),
edits as (select doc_id, next_id, text, text[1 : length(text) - length(text) // 4] || after[1 : length(text) // 4] as edited
          from near),
versions as (select doc_id, 'own' as kind, list_distinct({words("text")}) as w from edits
         union all select doc_id, 'new', list_distinct({words("edited")}) from edits),
terms as (select doc_id, kind, unnest(w) as term from versions),
known as (select term from terms where kind = 'own' group by term
          having ln((select count(*) from docs)::double / count(*)) between {fingerprints.LEAST_IDF} and {fingerprints.MOST_IDF}),
subsets(i, word, start, below) as (values {subsets}),
drawn as (select term, i from known, subsets where ('0x' || md5(term || ' ' || word)[start : start + 3])::int < below),
hashes as (select doc_id, kind, i, md5(string_agg(term, ' ' order by term))[1 : 16] as h
           from terms join drawn using (term) group by doc_id, kind, i),
rest as (select b.doc_id, b.kind, md5(array_to_string(list_sort(b.w), ' ')) as h from versions b
         where not exists (select 1 from hashes x where x.doc_id = b.doc_id and x.kind = b.kind)),
slots as (select doc_id, kind, i from versions, range({n + 1}) r(i)),
prints as (select s.doc_id, s.kind, list(coalesce(h.h, case when s.i = {n} then r.h end, '') order by s.i) as f
           from slots s left join hashes h on s.doc_id = h.doc_id and s.kind = h.kind and s.i = h.i
           left join rest r on s.doc_id = r.doc_id and s.kind = r.kind group by s.doc_id, s.kind)
select e.doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256,
  array_to_string(o.f, '-') as fingerprint, array_to_string(n.f, '-') as edited_fingerprint,
  {like("o.f", "n.f")} as near_edited, {like("o.f", "x.f")} as near_next
from edits e join prints o on o.doc_id = e.doc_id and o.kind = 'own'
  join prints n on n.doc_id = e.doc_id and n.kind = 'new' join prints x on x.doc_id = e.next_id and x.kind = 'own'
"""


def _filter_audit() -> str:
    letters = filter_audit.FILTERS
    n = len(letters)
    apart = " and ".join(f"l{i}.x <> l{j}.x" for i in range(n) for j in range(i))
    order = " || ".join(f"l{i}.x" for i in range(n))
    tables = ", ".join(f"letters l{i}" for i in range(n))
    bit = lambda at: f"(1 << (ascii(substr(o, {at}, 1)) - {ord(letters[0])}))"
    steps = " union all ".join(
        f"select o, {s} as step, {bit(s)} as own, {' + '.join(bit(k) for k in range(1, s)) or '0'} as earlier from orders"
        for s in range(1, n + 1)
    )
    return f"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
firsts as (select t, min(doc_id) as least from docs group by t),
worded as (select doc_id, part, d.t, regexp_extract_all(d.t, '{SPACED_WORD}') as w, least
           from docs d join firsts f on d.t = f.t),
masked as (
  select doc_id, part,
    case when len(w) < {filter_audit.FEWEST_WORDS} then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < {filter_audit.DISTINCT_PERCENT} * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.CAPITAL_PERCENT} * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > least or (doc_id is null and least is not null) then 16 else 0 end as mask
  from worded),
flags as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
counts as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from masked m left join flags f on m.doc_id = f.doc_id group by part, mask),
letters as (select unnest({quoted(list(letters))}) as x),
orders as (select {order} as o from {tables} where {apart}),
steps as ({steps}),
found as (
  select part, o as filter_order, step, own,
    coalesce(sum(n) filter (where mask & (own | earlier) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where mask & own <> 0 and mask & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & own <> 0 and mask & earlier <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & own <> 0 and mask & earlier = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & own <> 0 and mask & earlier = 0), 0)::bigint as toxic_lost
  from counts, steps group by part, o, step, own)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley
from found
"""


def _mixing() -> str:
    weights = "[" + ", ".join(str(w) for w in mixing.WEIGHTS) + "]"
    unit = 1 << mixing.RATE_BITS
    return f"""
with docs as (
  select doc_id, case when source is null then 't' else 's' || source end as s,
    len(regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}'))::bigint as size
  from documents),
sources as (
  select s, sum(size)::bigint as source_size, count(*) as n,
    {weights}[1 + (row_number() over (order by s) - 1) % {len(mixing.WEIGHTS)}] as w
  from docs group by s),
stops as (select *, {float(mixing.MOST)} * source_size as stop, row_number() over (order by {float(mixing.MOST)} * source_size / w, s) as k from sources),
levels as (
  select max(({mixing.SHARE} * (select sum(source_size) from sources) - coalesce((select sum(stop) from stops b where b.k < a.k), 0))
    / (select sum(w) from stops b where b.k >= a.k)) as level
  from stops a),
wanted as (select s, source_size, n, least(stop, w * level) as target,
    ('0x' || substr(md5('0:' || s), 1, 6))::bigint * {unit >> 24} as start
  from stops, levels),
rated as (select *, case when source_size > 0 then round(target / source_size * {unit})::bigint else 0 end as rate from wanted),
ranked as (
  select doc_id, size, source_size, target, rate, start, n,
    row_number() over (partition by d.s order by size, doc_id nulls first) - 1 as r
  from docs d join rated on d.s = rated.s),
placed as (select *, case when r % 2 = 0 then r // 2 else n - 1 - r // 2 end as p from ranked)
select doc_id, size, source_size, target,
  ((((p + 1) * rate + start) // {unit} - (p * rate + start) // {unit}) * size)::bigint as taken
from placed
"""


ORACLES = {
    "op3_decontamination": DECONTAMINATION,
    "op4_fingerprints": _fingerprints(),
    "op8_licenses": _licenses(),
    "op12_filter_audit": _filter_audit(),
    "op13_mixing": _mixing(),
}
