"""What a lesson is grounded on: the nearest chunks of each content type, from the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.operators import semantic
from syllabrook.plans.registry import query
from syllabrook.session import shared_folder, table

#: How many chunks of each type a lesson is grounded on (fixed values).
QUOTAS = {"notes": 15, "mark_scheme": 5, "past_paper": 5}


@query("""
with e as (select vec_id id, embedding vec, case when label < 4 then 'notes' when label < 7 then 'mark_scheme' else 'past_paper' end kind from embeddings where embedding is not null and label is not null),
q as (select id q_id, vec q_vec from e where id % 50 = 0),
d as (select q_id, kind, id, round(sqrt(list_sum(list_transform(list_zip(q_vec, vec), lambda p: (p[1]::double - p[2]::double) ** 2))), 6) distance from q, e)
select q_id, kind, id, distance, row_number() over (partition by q_id, kind order by distance, id)::int "rank" from d qualify "rank" <= case kind when 'notes' then 15 else 5 end
""")
def lesson_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector, which stand for lessons, 15 notes, 5 mark schemes and 5 past papers."""
    kind = F.when(F.col("label") < 4, "notes").when(F.col("label") < 7, "mark_scheme").otherwise("past_paper")
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null").select(kind.alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = semantic.build(e, shared_folder(spark))
    return semantic.lookup(index, e.filter("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), QUOTAS)
