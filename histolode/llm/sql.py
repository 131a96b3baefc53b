"""DuckDB SQL for the queries that SQL can express."""

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (select *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') as key from lines),
often as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select k.*, o.key is not null as dropped from keyed k left join often o on k.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

OP9 = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix:' || doc_id) as shuffle from documents),
sums as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2 as cap from sums),
levels as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::double)
      / sum(weight) over (o rows between current row and unbounded following) as level
  from weighed window o as (order by cap / weight, source nulls last)),
targets as (select source, source_size, least(cap::double, (max(level) over ()) * weight) as target from levels),
queued as (
  select s.*, t.source_size, t.target, sum(size) over (partition by s.source order by shuffle, doc_id rows unbounded preceding)::bigint as done
  from sizes s join targets t on s.source is not distinct from t.source),
copies as (select q.*, copy, (done + copy * source_size)::double / target as finish from queued q, (values (0), (1)) c(copy) where size > 0 and target > 0),
ranked as (select *, sum(size) over (order by finish, source nulls first rows unbounded preceding) as upto from copies),
taken as (select doc_id, count(*) as copies from ranked where upto <= 1.5 * (select sum(size) from sizes) group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, q.size * coalesce(t.copies, 0) as taken
from queued q left join taken t using (doc_id)
"""

OP6 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, md5_number_lower(array_to_string(w[i : i + 4], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
-- of equal similarity chances, a pair must share one of the first n - ceil(0.75 n) + 1 shingles of either, in order of the hash
firsts as (
  select s.doc_id, s.s from (select *, row_number() over (partition by doc_id order by s) as r from shingles) s join sizes z using (doc_id)
  where r <= n - ceil(0.75 * n) + 1),
pairs as (select distinct a.doc_id as a, b.doc_id as b from firsts a join firsts b on a.s = b.s and a.doc_id < b.doc_id),
both_ as (select p.a, p.b, count(*) as c from pairs p join shingles x on x.doc_id = p.a join shingles y on y.doc_id = p.b and y.s = x.s group by p.a, p.b),
links as (select a, b from both_ join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
either as (select a, b from links union all select b, a from links),
reach(id, other) as (select a, b from either union select r.id, e.b from reach r join either e on e.a = r.other),
labels as (select id, least(id, min(other)) as component_id from reach group by id)
select d.doc_id, coalesce(z.n, 0) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id, coalesce(l.component_id, d.doc_id) = d.doc_id as kept
from documents d left join sizes z using (doc_id) left join labels l on l.id = d.doc_id
"""

ORACLES = {"op6_near_dup": OP6, "op5_line_dedup": OP5, "op9_mix_sources": OP9}
