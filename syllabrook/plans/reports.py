"""Reporting queries: feedback, progress, coverage, filters, activity, trees.

On the driver's tables region, nation and customer are subject, section and objective; orders are sessions,
lineitem award points and events graded or felt events (see the README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.functions.parsing import int_prefix
from syllabrook.functions.values import percent
from syllabrook.operators.match import best, small
from syllabrook.plans.registry import query
from syllabrook.session import table



def passed() -> Column:
    return F.col("value") >= 70


@query("""
select user_id, count(*) filter (event_type = 'error') negative, count(*) filter (event_type = 'view') confused,
       count(*) filter (event_type = 'purchase') positive
from events group by user_id having count(*) filter (event_type in ('error', 'view')) > 0
order by negative desc, confused desc, user_id limit 20
""")
def feedback_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.count_if(F.col("event_type") == t)
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(of("error").alias("negative"), of("view").alias("confused"), of("purchase").alias("positive"))
    return e.filter(F.col("negative") + F.col("confused") > 0).orderBy(F.desc("negative"), F.desc("confused"), "user_id").limit(20)


@query("""
with s as (select user_id, case when count(*) filter (value >= 70) = 0 then 'unmet' when count(*) filter (value < 70) = 0 then 'mastered' else 'met_once' end status from events group by 1)
select count(*) total, count(*) filter (status = 'unmet') unmet, count(*) filter (status = 'met_once') met_once, count(*) filter (status = 'mastered') mastered,
       round_even(100.0 * count(*) filter (status = 'mastered') / count(*), 0)::int pct from s
""")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(passed()).alias("p"), F.count_if(~passed()).alias("f"))
    s = s.select(F.when(F.col("p") == 0, "unmet").when(F.col("f") == 0, "mastered").otherwise("met_once").alias("status"))
    s = s.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in ("unmet", "met_once", "mastered")])
    return s.withColumn("pct", percent(F.col("mastered"), F.col("total")))


@query("""
with l as (select o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) last_score, count(*) n from orders group by 1)
select c_custkey, n_name, last_score, coalesce(n, 0) attempts from customer left join nation on c_nationkey = n_nationkey left join l on o_custkey = c_custkey
""")
def progress_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_score"), F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(small(n), "c_nationkey", "left").join(o, "c_custkey", "left")
    return c.select("c_custkey", "n_name", "last_score", F.coalesce("n", F.lit(0)).alias("attempts"))


@query("""
select c_custkey, n_name, case when not exists (select 1 from orders where o_custkey = c_custkey) then 'not_started'
  when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then 'mastered' else 'attempted' end status
from customer join nation on c_nationkey = n_nationkey
""")
def objective_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("met"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(small(n), "c_nationkey").join(o, "c_custkey", "left")
    return c.select("c_custkey", "n_name", F.when(F.col("met").isNull(), "not_started").when(F.col("met"), "mastered").otherwise("attempted").alias("status"))


@query("""
select c_custkey, o_orderkey, o_orderstatus from customer left join
 (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on o_custkey = c_custkey
""")
def latest_log_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = best(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate"), "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, sf_dir, "customer").select("c_custkey").join(o.drop("o_orderdate"), "c_custkey", "left")


@query("""
select count(*) total, count(l_partkey) covered, count(*) - count(l_partkey) zero, round_even(100.0 * count(l_partkey) / count(*), 0)::int pct
from part left join (select distinct l_partkey from lineitem where l_returnflag = 'R') on l_partkey = p_partkey
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1))
    p = table(spark, sf_dir, "part").select("p_partkey").join(have, "p_partkey", "left").agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return p.select("total", "covered", (F.col("total") - F.col("covered")).alias("zero"), percent(F.col("covered"), F.col("total")).alias("pct"))


@query("select l_partkey, count(*) n from lineitem group by 1 order by n desc, l_partkey limit 10")
def coverage_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 49)")
def coverage_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(have, "p_partkey", "left_anti")


@query("select distinct l_returnflag, l_linestatus, year(l_shipdate)::int ship_year from lineitem where l_shipdate is not null")
def filters_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_shipdate is not null").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year")).distinct()


@query("""
select l_orderkey, count(distinct l_partkey) questions, min(l_partkey) first_question, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) flag
from lineitem group by 1 having count(distinct l_partkey) > 4
""")
def papers_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("questions"), F.min("l_partkey").alias("first_question"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("flag"))
    return g.filter("questions > 4")


@query("""
select * from (select 'session' kind, o_orderkey id, o_orderdate happened from orders union all select 'feedback', event_id, ts from events)
order by happened desc, kind, id desc limit 10
""")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (F.desc("happened"), F.asc("kind"), F.desc("id"))
    o = table(spark, sf_dir, "orders").select(F.lit("session").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened"))
    e = table(spark, sf_dir, "events").select(F.lit("feedback").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened"))
    return o.orderBy(*order).limit(10).union(e.orderBy(*order).limit(10)).orderBy(*order).limit(10)


@query("""
with s as (select o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) score from orders group by 1)
select c_custkey, score from customer left join s on o_custkey = c_custkey order by (score is null), score, c_custkey limit 25
""")
def weakest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("score"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(s, "c_custkey", "left").orderBy(F.col("score").asc_nulls_last(), "c_custkey").limit(25)


@query("select p_name, p_size, p_brand, row_number() over (order by coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) as int), 0), p_brand, p_partkey) as pos from part")
def numeric_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.regexp_extract("p_brand", r"([0-9]+)", 1).try_cast("int"), F.lit(0))
    # A global position: ranges are sorted in parallel, and only their sizes are summed in one place.
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", key.alias("k"))
    sizes = p.groupBy("k", "p_brand").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("k", "p_brand").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    p = p.withColumn("i", F.row_number().over(W.partitionBy("k", "p_brand").orderBy("p_partkey"))).join(sizes, ["k", "p_brand"])
    return p.select("p_name", "p_size", "p_brand", (F.col("before") + F.col("i")).alias("pos"))


@query("""
select p_brand, p_size, coalesce(try_cast(regexp_extract(p_brand, '^\\s*([+-]?[0-9]+)', 1) as int), 0) prefix_number, count(*) n from part group by all
""")
def numeric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size", int_prefix(F.col("p_brand")).alias("prefix_number")).agg(F.count("*").alias("n"))


@query("""
select trim(split_part(coalesce(nullif(o_orderpriority, ''), 'unknown'), '-', 1)) reason, count(*) n from orders group by 1
""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.trim(F.split_part(F.coalesce(F.nullif("o_orderpriority", F.lit("")), F.lit("unknown")), F.lit("-"), F.lit(1)))
    return table(spark, sf_dir, "orders").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


@query("select p_brand, p_type, count(*) n from part group by all order by n desc, p_brand, p_type limit 30")
def crosstab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", "p_type").limit(30)


@query("""
select case grouping_id(p_brand, p_type, p_size) when 3 then 'brand' when 5 then 'type' else 'size' end kind,
  coalesce(p_brand, p_type, p_size::varchar) as key, count(*) n from part group by grouping sets ((p_brand), (p_type), (p_size))
""")
def run_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))])).alias("x")
    return p.select(kinds).groupBy("x.kind", "x.key").agg(F.count("*").alias("n"))


@query("""
select r_name, to_json(list({'n_name': n_name, 'n': n} order by n_name)) sections from region join
 (select n_regionkey, n_name, count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey group by all) on n_regionkey = r_regionkey group by r_name
""")
def syllabus_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(small(c), "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_name", "n"))).alias("s"))
    return table(spark, sf_dir, "region").join(t, "r_regionkey").select("r_name", F.to_json("s").alias("sections"))


@query("select s_suppkey, s_name from supplier where s_name ilike '%00005%' or s_name ilike 'SUPPLIER#0000001%'")
def like_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter(F.col("s_name").ilike("%00005%") | F.col("s_name").ilike("SUPPLIER#0000001%")).select("s_suppkey", "s_name")


@query("""
select o_orderpriority, count(*) n, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'P') p,
  max(case when o_totalprice > 300000 then 1 else 0 end)::int has_large from orders group by 1
""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s.lower())
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), of("F"), of("O"), of("P"), F.max(F.when(F.col("o_totalprice") > 300000, 1).otherwise(0)).alias("has_large"))


@query("""
select l_orderkey, l_linenumber, p_name, o_orderstatus, concat(l_linestatus, ' · Q', l_linenumber) as label from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey
where l_quantity = 50 and p_size in (1, 7, 11) and o_orderdate <= timestamp '1998-12-31'
""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    p = table(spark, sf_dir, "part").filter(F.col("p_size").isin(1, 7, 11)).select(F.col("p_partkey").alias("l_partkey"), "p_name")
    o = table(spark, sf_dir, "orders").filter("o_orderdate <= timestamp '1998-12-31'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    j = li.join(p, "l_partkey").join(o, "l_orderkey")
    return j.select("l_orderkey", "l_linenumber", "p_name", "o_orderstatus", F.concat("l_linestatus", F.lit(" · Q"), "l_linenumber").alias("label"))


@query("""
select s_suppkey, n_name, c.n from supplier left join nation on s_nationkey = n_nationkey and n_regionkey = 1
 left join (select c_nationkey, count(*) n from customer where c_mktsegment = 'BUILDING' group by 1) c on c_nationkey = s_nationkey where n_regionkey = 1 or c.n > 5
""")
def either_side_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "supplier").join(small(n), "s_nationkey", "left").join(small(c), "s_nationkey", "left")
    return j.filter(F.col("n_name").isNotNull() | (F.col("n") > 5)).select("s_suppkey", "n_name", "n")


@query("select c_custkey, c_name from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2) and exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def semi_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(small(n), "c_nationkey", "left_semi").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("(select s_nationkey as key, 'only_a' side from supplier where s_acctbal > 5000 except select c_nationkey, 'only_a' from customer where c_acctbal > 9900) union all (select c_nationkey, 'only_b' from customer where c_acctbal > 9900 except select s_nationkey, 'only_b' from supplier where s_acctbal > 5000)")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("key"))
    return a.subtract(b).withColumn("side", F.lit("only_a")).union(b.subtract(a).withColumn("side", F.lit("only_b")))


@query("select p_brand, max_by(p_name, (length(p_name), p_name)) title, max_by(p_partkey, (p_size, p_partkey)) last_key from part group by 1")
def longest_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), F.col("p_name"))).alias("title"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("last_key"))


@query("""
select l_orderkey, case min(case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end) when 1 then 'past_paper' when 2 then 'recovered' else 'syllabus' end basis from lineitem group by 1
""")
def strongest_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.min(F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rank.alias("r")).select("l_orderkey", F.when(F.col("r") == 1, "past_paper").when(F.col("r") == 2, "recovered").otherwise("syllabus").alias("basis"))
