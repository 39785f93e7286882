"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from syllabrook.llm.codes_sql import OP11

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1 = """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages
), parts as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from cut
), addr as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from parts
), rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
  select host, path, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict
  from (select distinct host, path from addr) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1, 2
)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from addr left join best using (host, path)
"""

OP2 = rf"""
with sized as (
  select doc_id, source, coalesce(len({WORDS}), 0)::bigint size, md5(coalesce(doc_id::varchar, '')) as key from documents
), src as (
  select source, sum(size)::bigint source_size, row_number() over (order by source asc nulls last) source_rank from sized group by source
), w as (
  select *, [5, 2, 1][(source_rank - 1) % 3 + 1]::bigint weight, 3 * source_size as most, sum(source_size) over () total, sum([5, 2, 1][(source_rank - 1) % 3 + 1]) over () shares from src
), lv as (
  select *, ((total - coalesce(sum(most) over (order by most::double / weight, source_rank rows between unbounded preceding and 1 preceding), 0))::double
    / (shares - coalesce(sum(weight) over (order by most::double / weight, source_rank rows between unbounded preceding and 1 preceding), 0))::double) as level from w
), goal as (
  select source, source_size, source_rank, case when most::double < level * weight then most::double else
    (min_by(level, most::double / weight + source_rank * 1e-12) filter (not (most::double < level * weight)) over ()) * weight end target, total from lv
), placed as (
  select doc_id, size, g.source_size, g.source_rank, g.target, total, key,
    sum(size) over (partition by s.source order by key, doc_id, size rows unbounded preceding)::bigint upto
  from sized s join goal g on s.source is not distinct from g.source
), copies as (
  select *, (e * source_size + upto) place, case when target > 0 then (e * source_size + upto)::double / target end finish from placed, (values (0), (1), (2)) t(e)
), queue as (
  select *, sum(case when target > 0 then size else 0 end) over (order by finish asc nulls last, source_rank, place, doc_id rows unbounded preceding) reached from copies
)
select doc_id, size, source_size, target, sum(case when target > 0 then greatest(0, least(size, total - (reached - size))) else 0 end)::bigint taken
from queue group by doc_id, size, source_size, target, key, source_rank
"""


OP12 = r"""
with lines as materialized (
  select d, doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select d, doc_id, unnest(lines) line, generate_subscripts(lines, 1) i from (
    select row_number() over () d, doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents))
), repeated as (
  select key, max(doc_id) largest from lines where length(key) >= 20 group by key having count(distinct d) >= 3
), marked as (
  select l.*, largest is not null and (largest > doc_id or doc_id is null) gone from lines l left join repeated using (key)
)
select doc_id, count(*) n_lines, count_if(gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from marked group by d, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_mix_sources": OP2, "op11_vector_codes": OP11, "op12_line_dedup": OP12}
