"""DuckDB SQL of the vector codes: six rounds of assignment and means, one after the other."""

from __future__ import annotations

START = """
with recursive kept as materialized (
  select row_number() over (order by vec_id nulls last, v) r, vec_id, label, v from (
    select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) v, embedding from embeddings
  ) where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), wide as (select max(len(v)) // 8 w from kept
), parts as materialized (
  select r, p, v[p * w + 1 : (p + 1) * w] x from kept, wide, range(8) t(p)
), book0 as materialized (select p, r - 1 e, x c from parts where r <= 16)"""

ROUND = """
, near{i} as materialized (
  select r, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 16 + e) best
  from parts join book{i} using (p) group by r, p
)"""

MEANS = """
, book{j} as materialized (
  select p, e, coalesce(m.c, b.c) c from book{i} b left join (
    select p, e, list(mean order by pos) c from (
      select p, (best % 16)::bigint e, pos, floor(sum(x[pos])::double / count(*))::bigint mean
      from near{i} join parts using (r, p), wide, range(1, w + 1) t(pos) group by 1, 2, 3
    ) group by 1, 2
  ) m using (p, e)
)"""

END = """
, coded as (
  select r, string_agg(printf('%02x', (best % 16)::int), '' order by p) code, sum(best // 16)::bigint error from near6 group by r
), books as (
  select sha256(string_agg(text, ',' order by p, e)) codebooks_sha256 from (select p, e, array_to_string(c, ',') as text from book6)
)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256
from kept join coded using (r), books
"""

OP11 = START + "".join(ROUND.format(i=i) + MEANS.format(i=i, j=i + 1) for i in range(6)) + ROUND.format(i=6) + END
