"""Queries over graders' answers, which each order's lines stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.operators import gates
from syllabrook.plans.registry import query
from syllabrook.session import table

#: A point for each line of an order: names that are numbers, evidence that is missing, confidence that is a text or over 100.
ANSWERS = """
with p as (select l_orderkey, l_linenumber, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::int i,
  (l_quantity * 3)::int confidence, l_partkey, l_returnflag = 'R' awarded, l_linestatus = 'F' and l_returnflag = 'N' as no_evidence, l_shipdate from lineitem),
n as (select l_orderkey, count(*) n from p group by 1)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, answer): JSON texts in a code fence, most of them with something wrong."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    li = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey").cast("string")).otherwise(q(F.concat(F.lit("P"), "l_partkey")))
    confidence = (F.col("l_quantity") * 3).cast("int").cast("string")
    confidence = F.when(F.col("l_linenumber") == 4, q(confidence)).otherwise(confidence)
    evidence = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "").otherwise(F.concat(F.lit(', "evidence": "on '), F.to_date("l_shipdate").cast("string"), F.lit('"')))
    point = F.concat(F.lit('{"mark_point_id": '), name, F.lit(', "awarded": '), (F.col("l_returnflag") == "R").cast("string"), evidence, F.lit(', "confidence": '), confidence, F.lit("}"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), point.alias("p")))).alias("p"))
    points = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["p"]), ", "), F.lit("]"))
    whole = F.concat(F.lit('```json\n{"objective_id": "O1", "question_id": '), q(F.col("l_orderkey").cast("string")), F.lit(', "points": '), points, F.lit("}\n```"))
    return g.select("l_orderkey", F.when(F.col("l_orderkey") % 17 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("answer"))


@query(ANSWERS + """
, v as (
  select l_orderkey, '$.points[' || i || '].mark_point_id: not a string' violation from p where l_partkey % 5 = 0
  union all select l_orderkey, '$.points[' || i || '].evidence: missing' from p where no_evidence
  union all select l_orderkey, '$.points[' || i || '].confidence: not an integer' from p where l_linenumber = 4
  union all select l_orderkey, '$.points[' || i || '].confidence: above 100' from p where l_linenumber <> 4 and confidence > 100
  union all select l_orderkey, '$.points: fewer than 3 items' from n where n < 3
  union all select l_orderkey, '$.points: more than 6 items' from n where n > 6
)
select * from v where l_orderkey % 17 <> 0 union all select l_orderkey, '$: no JSON' from n where l_orderkey % 17 = 0
""")
def answer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of the graders' schema that an answer breaks, with the place where it does."""
    _, bad = gates.graded(answers(spark, sf_dir), "answer", gates.SYLLABUS_GRADING)
    return bad.select("l_orderkey", F.explode("violations").alias("violation"))


@query(ANSWERS + """
, bad as (select l_orderkey from p where l_partkey % 5 = 0 or no_evidence or l_linenumber = 4 or confidence > 100)
select l_orderkey, n n_points, (select sum(confidence) from p where p.l_orderkey = n.l_orderkey)::bigint confidence, (select count(*) from p where p.l_orderkey = n.l_orderkey and awarded) awarded
from n where n between 3 and 6 and l_orderkey % 17 <> 0 and l_orderkey not in (select l_orderkey from bad)
""")
def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers that break no rule, as values."""
    good, _ = gates.graded(answers(spark, sf_dir), "answer", gates.SYLLABUS_GRADING)
    points = F.col("grading.points")
    total: Column = F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x["confidence"])
    return good.select("l_orderkey", F.size(points).cast("long").alias("n_points"), total.alias("confidence"), F.size(F.filter(points, lambda x: x["awarded"])).cast("long").alias("awarded"))
