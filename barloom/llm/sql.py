"""Plain SQL (DuckDB) for the rows of those queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
with rows as (
  select doc_id, source, len({WORDS})::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, 'null')) as k
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         1 + (row_number() over (order by encode(source) nulls last) - 1) % 3 as weight
  from rows group by source
), filled as (
  select *, 3 * source_size as cap, 3 * source_size / weight as ratio from sources
), left_over as (
  select *,
    sum(source_size) over () - coalesce(sum(cap) over w, 0) as room,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as shares
  from filled
  window w as (order by ratio, encode(source) nulls last rows between unbounded preceding and 1 preceding)
), stopped as (
  select *, weight * room >= cap * shares as stops from left_over
), free as (
  select sum(source_size) - coalesce(sum(cap) filter (where stops), 0) as room,
         coalesce(sum(weight) filter (where not stops), 0) as shares
  from stopped
), targets as (
  select s.source, s.source_size,
    case when s.stops then s.cap::double
         else s.weight::double * f.room::double / (case when f.shares > 0 then f.shares else 1 end)::double end as target
  from stopped s, free f
), placed as (
  select r.doc_id, r.size, t.source_size, t.target,
    floor(t.target + 0.5)::bigint as budget,
    coalesce(sum(r.size) over (partition by r.source order by r.k, r.size
      rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from rows r join targets t on r.source is not distinct from t.source
), cut as (
  select *, case when source_size > 0 then budget // source_size else 0 end as epochs from placed
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from cut
"""

LINES = r"""
with split_lines as (
  select doc_id, text, coalesce(doc_id::hugeint, (hash(text) % 4611686018427387904)::hugeint - 9223372036854775808) as doc,
         unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from split_lines
), repeated as (
  select k, max(doc) as owner from keyed where length(k) >= 20
  group by k having count(distinct doc) >= 3
), judged as (
  select a.doc_id, a.doc, a.line, a.i, r.k is not null and a.doc <> r.owner as gone
  from keyed a left join repeated r using (k)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by doc_id, doc
"""

JACCARD = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), commons as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from commons join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 90 * (x.n + y.n - c)
), both_ways as (
  select a, b from links union all select b, a from links
), reached as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reached r join both_ways l on r.b = l.a
)
select d.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.b) as component_id
from documents d join reached r on r.a = d.doc_id left join sizes z on z.doc_id = d.doc_id
group by d.doc_id
"""

SUBSTRINGS = rf"""
with words as (
  select doc_id, {WORDS} as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h
  from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from words where len(w) >= 50)
), low as (
  select h, min(doc_id) as first from windows group by h
), gone as (
  select distinct doc_id, i + k as p
  from (select doc_id, i, unnest(range(50)) as k from windows join low using (h) where first < doc_id)
), placed as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from words
), kept as (
  select p.doc_id, count(*) filter (where g.p is not null) as n_removed,
    string_agg(word, ' ' order by p.p) filter (where g.p is null) as text
  from placed p left join gone g on g.doc_id = p.doc_id and g.p = p.p
  group by p.doc_id
)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed,
  sha256(coalesce(k.text, '')) as kept_sha256
from words w left join kept k using (doc_id)
"""

URLS = r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), split_urls as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), rules(rule, h, p, verdict) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fits as (
  select u.*, r.rule, r.verdict,
    row_number() over (partition by u.page_id order by length(r.rule) desc) as place
  from split_urls u left join rules r
    on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where place = 1
"""

NEGATIVES = """
with taken as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as vec
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_dot_product(a.vec, b.vec)::bigint as score
  from taken a join taken b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), ranked as (
  select p.anchor_id, p.positive_id, s.other_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank
  from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""

SQL: dict[str, str] = {
    "op3_substring_dedup": SUBSTRINGS,
    "op4_mixing": MIXING,
    "op6_line_dedup": LINES,
    "op8_jaccard_join": JACCARD,
    "op9_url_filter": URLS,
    "op12_hard_negatives": NEGATIVES,
}
