"""Scheduling and scoring queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.operators import schedule, score
from syllabrook.plans.registry import query
from syllabrook.session import table

STATE = """
with e as (select *, row_number() over (partition by user_id order by ts, event_id) rn from events),
i as (select *, sum(case when rn = 1 or value < 70 then 1 else 0 end) over (partition by user_id order by ts, event_id) island from e),
b as (select user_id, island, count(*) n, max(ts) t from i group by all),
state as (select user_id, least(5, arg_max(n, island))::int box, max(t) updated_at,
  case when sum(n) = 1 then max(t)::date else max(t)::date + [1, 2, 4, 7, 15][least(5, arg_max(n, island))::int] end next_review from b group by 1)
"""


def passed() -> Column:
    return F.col("value") >= 70


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.leitner(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", passed())


@query(STATE + "select user_id, box, next_review, updated_at from state")
def leitner_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


@query("""
with f as (select user_id, ts, value, sum(case when value < 70 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between current row and unbounded following) later from events),
d as (select user_id, least(2, count(distinct case when value >= 70 and later = 0 then ts::date end))::int met_count from f group by 1)
select user_id, met_count, ['unmet', 'met_once', 'mastered'][met_count + 1] status from d
""")
def mastery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.mastery(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", passed())


@query(STATE + "select user_id, box, next_review from state where next_review <= date '2024-01-31'")
def due_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.due(_state(spark, sf_dir), F.lit("2024-01-31").cast("date")).select("user_id", "box", "next_review")


@query(STATE + """, due as (select user_id, row_number() over (order by box, updated_at, user_id) n from state where next_review <= date '2024-01-30'),
fresh as (select c_custkey user_id, row_number() over (order by c_nationkey, c_custkey) n from customer where c_custkey not in (select user_id from due)),
u as (select user_id, 'review' source, 0 p, n from due union all select user_id, 'new', 1, n from fresh)
select user_id, source, row_number() over (order by p, n)::int as position from u order by position limit 12
""")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = schedule.due(_state(spark, sf_dir), F.lit("2024-01-30").cast("date"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return schedule.next_batch(due, new, "user_id", [F.asc("box"), F.asc("updated_at"), F.asc("user_id")], [F.asc("c_nationkey"), F.asc("user_id")], 12)


@query("""
select l_orderkey, sum(case when l_returnflag <> 'R' then l_quantity else 0 end) awarded_marks, sum(l_quantity) total_marks,
  round_even(100.0 * sum(case when l_returnflag <> 'R' then l_quantity else 0 end) / sum(l_quantity), 0)::int score_pct,
  array_to_string(list(l_linenumber order by l_linenumber) filter (l_returnflag = 'R'), ',') missed
from lineitem group by 1
""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("marks_value"), (F.col("l_returnflag") != "R").alias("awarded"), F.col("l_linenumber").alias("mark_point_id"))
    s = score.weighted(p, "l_orderkey")
    return s.select("l_orderkey", "awarded_marks", "total_marks", "score_pct", F.nullif(F.array_join(F.col("missed").cast("array<string>"), ","), F.lit("")).alias("missed"))


@query("""
select l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey, l_quantity) = 1
""")
def fanout_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("g", F.struct("l_orderkey", "l_partkey"))
    return score.keep_first(li, "g", [F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_quantity")], F.col("l_linenumber")).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("""
select l_orderkey, case when bool_or(l_linenumber >= 4 and p_size = 50) then 5 else min(l_linenumber) end "rank" from lineitem join part on p_partkey = l_partkey group by 1
""")
def rank_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = table(spark, sf_dir, "part").filter("p_size = 50").select(F.col("p_partkey").alias("l_partkey"))
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return score.provenance(li, "l_orderkey", "l_linenumber", 4, queued, "l_partkey")


@query("""
select user_id, coalesce(min(case when event_type = 'click' then value end), min(case when event_type = 'view' then 40.0 end), 50.0) confidence from events group by 1
""")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("confidence"), F.when(F.col("event_type") == "view", 40.0).alias("overall"))
    return score.confidence(e, "user_id", "overall", 50).withColumn("confidence", F.col("confidence").cast("double"))


@query("select l_partkey, bool_or(l_returnflag <> 'R') awarded from lineitem group by 1")
def fanout_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.any_awarded(table(spark, sf_dir, "lineitem").withColumn("awarded", F.col("l_returnflag") != "R"), "l_partkey")


@query("""
with c as (select o_custkey, count(*) filter (o_orderstatus = 'F') notes, count(*) filter (o_orderstatus = 'O') schemes, count(*) filter (o_orderstatus = 'P') papers from orders group by 1)
select o_custkey, greatest(case when notes >= 3 then 90 when notes = 2 then 70 when notes = 1 then 50 else 30 end - case when notes = 0 and papers = 0 and schemes > 0 then 20 else 0 end, 30)::int floor from c
""")
def source_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("F").alias("n"), of("O").alias("s"), of("P").alias("p"))
    return c.select("o_custkey", score.source_floor(F.col("n"), F.col("s"), F.col("p")).alias("floor"))


@query("""
with p as (select l_orderkey k, l_linenumber i, l_returnflag = 'A' awarded, case l_linestatus when 'F' then 'Student gave an example here' else '' end evidence from lineitem)
select k, i, awarded or contains(lower(evidence), 'student gave') awarded,
 case when not awarded and contains(lower(evidence), 'student gave') then '[auto-corrected] ' || evidence when not awarded and trim(evidence) = '' then 'No relevant content found in answer.' else evidence end evidence from p
""")
def reconcile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_returnflag") == "A").alias("awarded"), F.when(F.col("l_linestatus") == "F", "Student gave an example here").otherwise("").alias("evidence"))
    return score.reconcile(p)


@query("""
with p as (select l_orderkey k, l_linenumber i, l_returnflag = 'A' awarded, 'the answer of ' || l_partkey || case when l_linenumber % 2 = 0 then ' because it holds' else '' end evidence,
  case l_linestatus when 'F' then 'I say the answer of ' || l_partkey || ' because it holds' else 'no' end answer from lineitem),
t as (select *, awarded and length(evidence) < 20 thin, contains(answer, evidence) inside, contains(evidence, 'because') or contains(evidence, 'so') or contains(evidence, 'thus') or contains(evidence, 'since') explains from p)
select k, i, awarded and not thin awarded, awarded and not thin and ((inside and not explains) or not inside) flagged from t
""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("the answer of "), "l_partkey")
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_returnflag") == "A").alias("awarded"),
        F.concat(text, F.when(F.col("l_linenumber") % 2 == 0, " because it holds").otherwise("")).alias("evidence"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("I say "), text, F.lit(" because it holds"))).otherwise("no").alias("answer"),
    )
    return score.evidence_gates(p).select("k", "i", "awarded", "flagged")
