"""Queries over names, lists and codes that are parsed from text, and the smaller rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.functions import parsing, text, values
from syllabrook.operators import curate, lines
from syllabrook.plans.registry import query
from syllabrook.session import table


@query("""
with s as (select l_orderkey, l_linenumber, l_linenumber + 2 a, l_linenumber b, (l_suppkey % 7)::int c from lineitem)
select l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat(range(b, a + 1), [c]))), ',') pages from s
""")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat((F.col("l_linenumber") + 2).cast("string"), F.lit("-"), "l_linenumber", F.lit(", "), (F.col("l_suppkey") % 7).cast("string"), F.lit(",x"))
    pages = parsing.page_list(spec)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query(r"""
with n as (select o_orderkey, o_orderkey % 4 k, year(o_orderdate) y, year(o_orderdate) % 100 yy, case o_orderstatus when 'F' then 'January' when 'O' then 'June' else '' end sitting from orders)
select o_orderkey, case when k = 3 then 3 else 2 end paper, sitting,
  case when k = 0 then case when y between 2002 and 2030 then y end when k = 1 then case when yy <= 30 then 2000 + yy else 1900 + yy end when k = 2 then null else 2014 end::int exam_year,
  'Paper ' || case when k = 3 then 3 else 2 end || ' - ' || trim(sitting || ' ' || exam_year) paper_label
from n
""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a whole year, two digits that stand alone, two that do not, and a second year."""
    month = F.when(F.col("o_orderstatus") == "F", "_Jan_").when(F.col("o_orderstatus") == "O", "_MAY ").otherwise("_MayJune_")
    kind, year = F.col("o_orderkey") % 4, F.year("o_orderdate").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("econ p2"), month, year, F.lit(".pdf")))
        .when(kind == 1, F.concat(F.lit("Paper 2 "), F.substring(year, 3, 2), F.lit(" x"), month, F.lit("y.PDF")))
        .when(kind == 2, F.concat(F.lit("econ_Paper 02_"), F.substring(year, 3, 2), F.lit("_"), month, F.lit("z.v1.pdf")))
        .otherwise(F.concat(F.lit("paper_3"), month, F.lit("1066 2014 2015.docx")))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    found = {"paper": parsing.paper_number, "exam_year": parsing.exam_year, "sitting": parsing.sitting, "paper_label": parsing.paper_label}
    return o.select("o_orderkey", *[f(F.col("name")).alias(c) for c, f in found.items()])


@query("""
select c_custkey, case c_custkey % 3 when 0 then 'a_____' || regexp_replace(c_name || ' ' || c_mktsegment, '[^a-zA-Z0-9_-]', '_', 'g') || '.pdf'
  when 1 then 'file.x_y' else right('n' || repeat('_', 120) || c_custkey || '.docx', 100) end file_name from customer
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("../a/../ "), "c_name", F.lit(" "), "c_mktsegment", F.lit(".PDF"))).when(kind == 1, F.lit(" ._-.X Y")).otherwise(F.concat(F.lit("n"), F.repeat(F.lit("."), F.lit(120)), "c_custkey", F.lit(".docx")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_filename(raw).alias("file_name"))


@query(r"""
with s as (select l_orderkey, l_linenumber, l_quantity::int % 8 k from lineitem)
select l_orderkey, l_linenumber,
  ['Examine', 'Describe', 'State,Solve', '', 'Compare', 'Outline', 'Make,List', ''][k + 1] command_words,
  ['Application', 'Understanding', 'Application', 'UNCLASSIFIED', 'Application', 'Knowledge', 'Understanding', 'Understanding'][k + 1] skill_type,
  ['Examine the cost', 'Describe it', 'State and solve both', 'Understated facts', 'Compare a with b', 'Outline pre-paid costs', 'Make a list', 'Summarize interconversion'][k + 1] statement,
  ['Both', 'Both', 'P1', 'Both', 'Both', 'Both', 'Both', 'Both'][k + 1] exam_weight,
  [null, '1', '12', null, null, '3', null, '4'][k + 1] question
from s
""")
def statement_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = [
        "examine the cost; and", "1. describe it. 7.", "intro\n 12) state and solve both, or", "understated facts", "compare a with b;.", "3 (a) outline pre-\npaid costs", "make a list,", "4. summarize inter- conversion",
    ]
    at = (F.col("l_quantity").cast("int") % 8) + 1
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*[F.lit(x) for x in raw]), at).alias("raw"))
    body = F.regexp_replace(F.col("raw"), r"^(intro\n )?\d+(\)|\.| \(a\)) ", "")
    li = li.withColumn("statement", text.clean_statement(text.dehyphenate(body)))
    words = F.array_join(parsing.command_words(F.col("statement")), ",")
    return li.select("l_orderkey", "l_linenumber", words.alias("command_words"), parsing.skill_type(F.col("statement")).alias("skill_type"), "statement", parsing.exam_weight(parsing.leading_verb(F.col("statement"))).alias("exam_weight"), parsing.question_number(F.col("raw")).alias("question"))


@query("""
select event_id, json_extract_string(props, '$.k') single, case when event_id % 3 = 0 then [json_extract_string(props, '$.k'), 'x'] when event_id % 3 = 1 then [json_extract_string(props, '$.k')] else ['k=' || json_extract_string(props, '$.k')] end words from events
""")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, scalars and texts that are no JSON."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit('["'), k, F.lit('", "x"]'))).when(kind == 1, k).otherwise(F.concat(F.lit("k="), k))
    return table(spark, sf_dir, "events").select("event_id", k.alias("single"), values.json_list(raw).alias("words"))


@query("select event_type as key, arg_max(value, (ts, event_id)) as value, max(ts) updated_at from events group by 1")
def app_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("updated_at"))


@query("""
select c_custkey, coalesce(case when c_acctbal >= 0 then c_acctbal end, (select min(o_totalprice) from orders where o_custkey = c_custkey)) filled from customer
""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("filled"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return curate.fill(c, "filled", o, "c_custkey", "o_totalprice")


@query("""
select item_id, 1 page, length(regexp_replace(text, ' .*$', '', 's')) body from benchmark union all select item_id, 2, length(text) from benchmark
""")
def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("[Page 1 of 2]"), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("[Page 2 OCR]"), "text").alias("t"))
    return lines.pages(b, ["item_id"], F.col("t")).select("item_id", "page", F.length("body").alias("body"))


@query("select event_id, 'K=' || json_extract_string(props, '$.k') options, case when json_extract_string(props, '$.k')::int > 50 then 'K' end answer from events")
def options_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = values.options_map(F.from_json("props", "map<string,string>"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.map_keys(m)[0], F.lit("="), F.map_values(m)[0]).alias("options"), F.when(F.map_contains_key(m, "K") & (m["K"].cast("int") > 50), "K").alias("answer"))


@query("""
with u as (select l_orderkey, unnest([l_partkey, l_suppkey]) objective, l_linenumber from lineitem)
select l_orderkey, objective, min(l_linenumber) as first_line, count(*) n from u group by all
""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("objective"), "l_linenumber")
    return li.groupBy("l_orderkey", "objective").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("n"))


@query("""
with s as (select l_orderkey, max_by(l_linestatus, (l_linenumber, l_partkey, l_linestatus)) status, max(l_linenumber) last_line, bool_or(l_discount = 0) missing from lineitem group by 1)
select l_orderkey, status, last_line, case when missing then 'failed' when last_line > 6 then 'queued' else 'ingested' end outcome from s
""")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linestatus", F.struct("l_linenumber", "l_partkey", "l_linestatus")).alias("status"), F.max("l_linenumber").alias("last_line"), F.bool_or(F.col("l_discount") == 0).alias("missing"))
    return g.select("l_orderkey", "status", "last_line", curate.partition_rows([(F.col("missing"), "failed"), (F.col("last_line") > 6, "queued")], "ingested").alias("outcome"))
