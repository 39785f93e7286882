"""Queries over gates, lookups and small rules. Awkward values come from lists that rows of a whole table choose from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook import schemas
from syllabrook.functions import parsing, text, values
from syllabrook.operators import curate, gates, lines, lookup, papers, status
from syllabrook.plans.registry import query
from syllabrook.session import table
from syllabrook.sources import files, sinks


def pick(key: str, items: list) -> Column:
    """The item that a row's key chooses."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.col(key) % len(items)).cast("int") + 1)


def sql_list(items: list) -> str:
    told = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join(map(told, items)) + "]"


# Gates
@query("""
with k as (select c_custkey objective, c_nationkey subject from customer), l as (select n_nationkey from nation where n_regionkey in (1, 2))
select o_orderkey, (exists (select 1 from k where objective = o_custkey and subject = o_orderkey % 25) and o_orderkey % 25 in (select n_nationkey from l)) in_scope from orders
""")
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("objective_id"), (F.col("o_orderkey") % 25).cast("int").alias("subject_id"))
    objectives = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("objective_id"), F.col("c_nationkey").alias("subject_id"))
    subjects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject_id"), F.col("n_regionkey").isin(1, 2).alias("syllabus_locked"))
    return gates.in_scope(r, objectives, subjects).select("o_orderkey", "in_scope")


@query("""
with w as (select distinct o_custkey::bigint % 40 subject_id from orders), n as (select s_nationkey, count(*) n from supplier where s_acctbal > 9000 group by 1)
select subject_id, coalesce(n, 0) n_objectives, case when subject_id not in (select n_nationkey from nation) then 'unknown subject' when n is null then 'no objectives' end refused from w left join n on s_nationkey = subject_id
""")
def lock_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("subject_id")).distinct()
    subjects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("subject_id"))
    objectives = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("subject_id"))
    return gates.lock_refusals(subjects, objectives, wanted)


@query("""
with r as (select l_orderkey, l_linenumber, l_quantity >= 45 artifact, l_discount = 0 excluded, l_tax = 0 manual, l_returnflag = 'R' verified, case when l_linenumber > 1 then l_linenumber end page, case when l_suppkey % 9 > 0 then l_suppkey::varchar else '' end objective from lineitem)
select l_orderkey, l_linenumber, case when artifact and excluded then 'overlapping states' when artifact or excluded or manual then null when not verified then 'not reviewed' when page is null then 'no source page' when objective = '' then 'no objective' end reason from r
""")
def lock_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gates.blocking(F.col("l_returnflag") == "R", F.col("l_quantity") >= 45, F.when(F.col("l_discount") == 0, "cover").otherwise(""), F.col("l_tax") == 0, F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey").cast("string")).otherwise(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", out.alias("reason"))


PAGES = ["12", " 7 ", "", None, "x3", "0"]


@query(f"""
select o_orderkey, case when o_orderstatus <> 'F' then 'not verified' when {sql_list([False, False, True, True, True, False])}[(o_orderkey % 6 + 1)::int] then 'page is no number' end reason from orders
""")
def stem_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", gates.stem_gate(F.when(F.col("o_orderstatus") == "F", "1").otherwise("0"), pick("o_orderkey", PAGES)).alias("reason"))


@query("""
with e as (select distinct o_custkey k from orders where o_orderstatus = 'F'), r as (select c_custkey, c_custkey in (select k from e) now, case when c_custkey % 3 = 0 and c_custkey + 1 in (select k from e) then c_custkey + 1 end former from customer)
select c_custkey chunk_id, case when now then 'update' when former is not null then 'rename' else 'insert' end action, case when now then c_custkey else former end target from r
""")
def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    have = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("chunk_id"))
    return gates.routed(rows, have, rows.filter("chunk_id % 3 = 0").select("chunk_id", (F.col("chunk_id") + 1).alias("former")))


@query("select p_partkey question_id from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 45) and p_partkey not in (select l_partkey from lineitem where l_quantity <= 3)")
def missing_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    stems = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"))
    return gates.missing_stems(stems, li.filter("l_quantity >= 45").select(F.col("l_partkey").alias("question_id")), li.filter("l_quantity <= 3").select(F.col("l_partkey").alias("chunk_id")))


@query("""
select p_partkey, case when p_size % 3 = 0 then p_name || '-STEM' when p_size % 3 = 1 then p_name || '-stem' else p_name || '-stem' end chunk_id, p_size % 3 = 2 was_missing from part
""")
def stem_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that lack the suffix (in any case) get it."""
    raw = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "-STEM").when(F.col("p_size") % 3 == 1, "-stem").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", gates.with_suffix(raw).alias("chunk_id"), (~raw.ilike("%-stem")).alias("was_missing"))


PROMPTS = ["Define a market.", "What is a market, briefly?", "Too short?", "The firm lost $500. Calculate the loss here.", "Just a statement about firms", "What is it? (Answer: a firm) ok?", "Let me know if you need another one?"]
FAULTS = [None, None, "recall_question too short", None, "recall_question is not a question or command prompt", "recall_question leaks the answer", "recall_question contains chat boilerplate"]
TASKS = [["Define"], ["discuss", "state"], ["Unheard"], [], ["Sketch", "list"]]


@query(rf"""
with d as (select doc_id, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n, [180, 350, 300, 300, 250][(doc_id % 5 + 1)::int] floor from documents)
select doc_id, floor, case when doc_id % 11 = 0 then 'lesson_text cites chunk section' when n < floor then 'lesson too short (' || n || ' words; min ' || floor || ' for this command word)'
  when doc_id % 13 = 0 then 'recall_questions count != 1 (got 2)' else {sql_list(FAULTS)}[(doc_id % 7 + 1)::int] end reason from d
""")
def lesson_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*[F.array(*[F.lit(w) for w in ws]).cast("array<string>") for ws in TASKS]), (F.col("doc_id") % 5).cast("int") + 1)
    lesson = F.when(F.col("doc_id") % 11 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" According to Section 4."))).otherwise(F.col("text"))
    asked = F.array(pick("doc_id", PROMPTS))
    asked = F.when(F.col("doc_id") % 13 == 0, F.concat(asked, asked)).otherwise(asked)
    return table(spark, sf_dir, "documents").select("doc_id", gates.word_floor(words).alias("floor"), gates.lesson_gate(lesson, asked, words).alias("reason"))


POINTS = ["Total:", "[12]", "= 2 x 2 =", "Be poor. ()", "of living each", "Limited resources", "A firm (1)", "each.", "", "3 firms", "Économie"]
NOISE = [True, True, True, True, True, False, False, True, False, False, False]


@query(f"""
with p as (select l_orderkey, l_linenumber, (l_partkey % 11 + 1)::int k, l_quantity > 40 bad, l_returnflag = 'R' verified, l_linestatus = 'F' was, l_tax = 0 manual from lineitem), a as (select *, {sql_list(NOISE)}[k] noise from p)
select l_orderkey, l_linenumber, noise and not bad artifact, case when bad then 'contaminated_exam_instructions' else '' end excluded, was or (noise and not bad) repaired, verified and (was or not noise or bad) still_verified,
  case when was or (noise and not bad) then 'artifact' when manual then 'manual' when verified then 'verified' end state from a
""")
def point_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points classified, rows of an earlier run classified again, and the state of each."""
    excerpt = F.when(F.col("l_quantity") > 40, "xx ANSWER ALL the questions xx").otherwise("plain")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick("l_partkey", POINTS).alias("point_text"), excerpt.alias("raw_excerpt"), (F.col("l_linestatus") == "F").alias("artifact"), F.lit("").alias("excluded"), (F.col("l_returnflag") == "R").alias("verified"), (F.col("l_tax") == 0).alias("manual"))
    c = gates.classified_point(F.col("point_text"), F.col("raw_excerpt"))
    first = li.withColumns({"first_artifact": c["artifact"], "first_excluded": c["excluded"]})
    out = gates.reclassified(first)
    return out.select("l_orderkey", "l_linenumber", F.col("first_artifact").alias("artifact"), F.col("first_excluded").alias("excluded"), F.col("artifact").alias("repaired"), F.col("verified").alias("still_verified"), gates.tally(F.col("artifact"), F.col("excluded"), F.col("manual"), F.col("verified")).alias("state"))


@query("""
select s_nationkey, string_agg(trim(s_name), ' ' order by s_suppkey) point_text, sum(s_suppkey)::bigint marks_value, (sum(case when s_acctbal > 0 and s_acctbal < 5000 then 1 else 0 end))::bigint n_artifacts from supplier group by 1
""")
def repaired_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of a group as one row; rows that are left out are no artifacts, too."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_nationkey", "s_suppkey", F.concat(F.lit(" "), "s_name").alias("point_text"), F.col("s_suppkey").cast("int").alias("marks_value"), (F.col("s_acctbal") > 0).alias("artifact"), F.when(F.col("s_acctbal") >= 5000, "cover").otherwise("").alias("excluded"))
    sizes = rows.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    merged = gates.merged_fragments(rows.join(sizes, "s_nationkey"), ["s_nationkey"], "s_suppkey", F.col("n"))
    counts = gates.without_overlap(rows).groupBy("s_nationkey").agg(F.count_if("artifact").alias("n_artifacts"))
    return merged.join(counts, "s_nationkey").select("s_nationkey", "point_text", F.col("marks_value").cast("long").alias("marks_value"), "n_artifacts")


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents where text is not null)
select doc_id, n::int n, concat_ws('|', case when regexp_matches(line, '(?i)(\b(of|the|a|an|to|for|and|or|in|on|with|that|which|from|by|as)|[:,])\s*$') then 'truncated (ends on a connector/preposition)' end,
  case when regexp_matches(line, '(?i)\(\s*(i{1,3}|iv|vi{0,3}|ix|x)\s*\)') then 'note bleed (contains a roman-numeral enumerator)' end,
  case when regexp_matches(line, '\(\s*\)|(\b[a-zA-Z]\s+){3,}[a-zA-Z]\b|\s\d\s*[+)]') then 'garbled math/typesetting residue' end,
  case when length(line) < 15 then 'suspiciously short' end) flags from l
""".replace("\\\\", "\\"))
def statement_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a statement."""
    ls = lines.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return ls.select("doc_id", "n", F.array_join(gates.lint(F.col("line")), "|").alias("flags"))


# Lookups
@query("""
with c as (select l_orderkey || '-' || l_linenumber || case when l_returnflag = 'R' then '-Stem' else '' end question_id, l_partkey, l_linenumber question_num, l_shipdate, l_orderkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber > 1),
d as (select o_orderkey, o_orderpriority paper, year(o_orderdate)::int yr from orders where o_orderstatus in ('F', 'P')),
m as (select l_orderkey || '-' || l_linenumber || '-Stem' question_id, count(*) n from lineitem where l_quantity > 25 group by 1)
select question_id, question_num, paper, yr as year, coalesce(n, 0) marks_total, filter from c join d on o_orderkey = l_orderkey left join m using (question_id), (values ('all'), ('paper'), ('year'), ('both')) t(filter)
where (filter not in ('paper', 'both') or paper = '5-LOW') and (filter not in ('year', 'both') or yr = 1997)
""")
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list with none, either and both of its optional filters."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    stem = F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("-Stem"))
    chunks = li.select(F.when(F.col("l_returnflag") == "R", stem).otherwise("plain").alias("chunk_id"), F.col("l_linestatus").alias("subject_id"), F.col("l_linenumber").alias("question_num"), F.when(F.col("l_linenumber") > 1, 1).alias("page"), F.col("l_orderkey").alias("doc_id"), F.lit("text").alias("chunk_text"))
    documents = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus").isin("F", "P"), "specimen").otherwise("notes").alias("content_type"), F.col("o_orderpriority").alias("paper"), F.year("o_orderdate").alias("year"))
    points = li.filter("l_quantity > 25").select(stem.alias("question_id"))
    filters = {"all": (None, None), "paper": ("5-LOW", None), "year": (None, 1997), "both": ("5-LOW", 1997)}
    return lookup.question_lists(chunks, documents, points, "F", filters).drop("stem")


@query("""
with c as (select l_partkey, l_orderkey * 10 + l_linenumber id, case l_returnflag when 'R' then 'past_paper' when 'A' then 'mark_scheme' else 'other' end kind from lineitem where l_quantity >= 30),
b as (select l_partkey, kind, id from c qualify row_number() over (partition by l_partkey order by case kind when 'mark_scheme' then 2 when 'past_paper' then 3 else 5 end, id) = 1)
select p_partkey objective_id, coalesce(kind, 'syllabus_only') context_source,
  case when kind is null then 'Section: ' || case when p_size <= 25 then n_name else '(unknown section)' end || chr(10) || 'Objective ' || p_size || ': ' || p_name || chr(10) || 'Skill type: ' || case when p_type = 'SMALL' then '(unspecified)' else p_type end || chr(10) || 'Command words: ' || case when p_size % 2 = 0 then 'Define, List' else '(none specified)' end else 'chunk ' || id end chunk_text
from part left join b on l_partkey = p_partkey left join nation on n_nationkey = p_size - 1
""")
def context_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("p_size") % 2 == 0, '["Define", "List"]')
    objectives = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("objective_id"), (F.col("p_size") - 1).alias("section_id"), F.col("p_size").cast("string").alias("objective_num"), F.col("p_name").alias("content_stmt"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).otherwise("").alias("skill_type"), words.alias("command_words"))
    kind = F.when(F.col("l_returnflag") == "R", "past_paper").when(F.col("l_returnflag") == "A", "mark_scheme").otherwise("other")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    chunks = table(spark, sf_dir, "lineitem").filter("l_quantity >= 30").select(F.col("l_partkey").alias("objective_id"), key.alias("id"), F.concat(F.lit("chunk "), key).alias("chunk_text"), F.col("l_linenumber").alias("page"), F.lit("f").alias("source_file"), kind.alias("content_type"))
    chunks = chunks.dropDuplicates(["objective_id", "id", "content_type"])
    sections = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("section_id"), F.col("n_name").alias("title"))
    return lookup.context(objectives, chunks, sections).select("objective_id", "context_source", "chunk_text")


@query("""
with o as (select s_suppkey id, lower('Explain how ' || s_name || ' works with its many partners and clients') stmt from supplier where s_acctbal > 1000),
k as (select s_suppkey row_id, case s_suppkey % 4 when 0 then 'Explain how ' || s_name || ' works with its many partners and clients' when 1 then 'explain how ' || s_name || ' WORKS with its many partners and clients; and ' when 2 then 'Explain how ' || s_name || ' works quite differently' else 'Nothing of this' end raw from supplier),
m as (select row_id, raw, lower(trim(raw)) key, trim(regexp_replace(lower(trim(raw)), '[;,]\\s+and\\s*$', '')) short from k)
select row_id, coalesce(a.id, b.id, (select min(id) from o where starts_with(stmt, left(m.key, 40)))) objective_id,
  case when a.id is not null then 0 when b.id is not null then 1 when exists (select 1 from o where starts_with(stmt, left(m.key, 40))) then 2 end tier
from m left join o a on a.stmt = m.key left join o b on b.stmt = m.short
""".replace("\\\\", "\\"))
def statement_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    objectives = s.filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("objective_id"), F.concat(F.lit(" Explain how "), "s_name", F.lit(" works with its many partners and clients")).alias("content_stmt"), F.col("s_suppkey").alias("ordinal"))
    kind = F.col("s_suppkey") % 4
    full = F.concat(F.lit("Explain how "), "s_name", F.lit(" works with its many partners and clients"))
    raw = F.when(kind == 0, full).when(kind == 1, F.concat(F.lit("explain how "), "s_name", F.lit(" WORKS with its many partners and clients; and "))).when(kind == 2, F.concat(F.lit("Explain how "), "s_name", F.lit(" works quite differently"))).otherwise("Nothing of this")
    return lookup.resolved(s.select(F.col("s_suppkey").alias("row_id"), raw.alias("raw")), "raw", objectives).select("row_id", "objective_id", "tier")


@query("""
with o as (select 'ECON-' || s_nationkey || '.' || s_suppkey id from supplier)
select distinct c_custkey, case when id is not null then id end objective_id from customer left join o on id = 'ECON-' || c_nationkey || '.' || (c_custkey % 100)
""")
def structural_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    objectives = table(spark, sf_dir, "supplier").select(lookup.structural_id(F.lit("ECON"), F.col("s_nationkey"), F.col("s_suppkey")).alias("objective_id"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return lookup.structural(rows, objectives, F.lit("ECON"), F.col("c_nationkey"), F.col("c_custkey") % 100).select("c_custkey", "objective_id")


FLAGS = ["OK", " video_reused_3x ", "LOW_MATCH", "", "ok", None]


@query("""
with v as (select o_orderkey, o_orderkey % 6 k, o_custkey from orders), o as (select c_custkey, lower(trim(c_name)) stmt from customer where c_acctbal > 0)
select o_orderkey, case when k in (2, 3, 5) then 'skipped_flag' when c_custkey is null then 'unresolved' when c_custkey % 5 = 0 then 'already_present' else 'loaded' end outcome from v left join o on c_custkey = o_custkey
""")
def video_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    objectives = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("objective_id"), F.concat("c_name", F.lit(" is a long name of a customer, and more")).alias("content_stmt"), F.col("c_custkey").alias("ordinal"))
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name").hint("merge"), "o_custkey")
    rows = o.select("o_orderkey", pick("o_orderkey", FLAGS).alias("flag"), F.concat("c_name", F.lit(" is a long name of a customer, AND more")).alias("matched_content_stmt"), F.lit("u").alias("url"))
    present = objectives.filter("objective_id % 5 = 0").select("objective_id", F.lit("u").alias("url"))
    return lookup.videos(rows, objectives, present).select("o_orderkey", "outcome")


@query("""
with w as (select doc_id, lang, lower(text) t from documents)
select doc_id, array_to_string(list_filter(['the', 'que', 'nicht', 'zz'], lambda k: contains(left(t, 2000), k)), ',') hits from w
""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose first letters have a keyword: the limit is the operator's feature."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lookup.keyword_hits(F.col("text"), ("the", "que", "nicht", "zz")), ",").alias("hits"))


@query(r"""
with f as (select source = 'src0' as old, regexp_extract_all(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.;])', '\\1 ', 'g'), '(?i)(?:^|[^\\pL\\pN_])((?:that|with|des|und)(?:[^\\pL\\pN_.;][^.;]*)?[.;])', 1) found from documents where text is not null and source is not null),
b as (select distinct old, lower(rtrim(trim(regexp_replace(s, '^\d+\.\d+\s+', '')), '.;')) statement from (select old, unnest(found) s from f))
select statement, case when bool_and(old) then 'removed' when bool_or(old) then 'kept' else 'added' end state from b where length(statement) >= 12 group by 1
""".replace("\\\\", "\\"))
def edition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of one source that the other sources lack, share or add."""
    d = table(spark, sf_dir, "documents").select("source", "text")
    return lookup.editions(d.filter("source = 'src0'"), d.filter("source <> 'src0'"), "text", ("that", "with", "des", "und"))


# Small rules
@query(r"""
select doc_id, coalesce(lower(trim(lead(line) over (partition by doc_id order by n))) like '%the%', false) next_has_the, n::int n from
(select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents where text is not null)
""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines.lines(table(spark, sf_dir, "documents").filter("text is not null"), ["doc_id"], "text")
    ahead = lines.next_line(ls, ["doc_id"])
    return ahead.select("doc_id", F.coalesce(F.lower("next_line").contains("the"), F.lit(False)).alias("next_has_the"), "n")


@query("select n_nationkey, row_number() over (order by md5('week 3|' || n_nationkey)) as pos from nation")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "nation")  # 25 rows
    return n.select("n_nationkey", F.row_number().over(W.orderBy(values.seeded(F.col("n_nationkey"), "week 3"))).alias("pos"))


LISTS = ["a|b", " a , b ,", "", None, "x||y, z", "one"]


@query(f"select c_custkey, {sql_list(['a;b', 'a;b', '', '', 'x;y;z', 'one'])}[(c_custkey % 6 + 1)::int] words, case when c_custkey % 6 in (2, 3) then 0 else json_array_length(to_json(string_split(words, ';'))) end n from customer")
def delimited_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = values.delimited(pick("c_custkey", LISTS))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(words, ";").alias("words"), F.coalesce(F.json_array_length(F.to_json(words)), F.lit(0)).cast("long").alias("n"))


@query("select l_orderkey, l_linenumber, case when l_extendedprice * 50000 < 1073741824 then 'too little' when l_extendedprice * 50000 < 2147483648 then 'tight' when l_extendedprice * 50000 < 3758096384 then 'enough' else 'plenty' end band from lineitem")
def memory_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.memory_band(F.col("l_extendedprice") * 50000).alias("band"))


REQUESTS = ['{"objective_id": "a", "score": 50}', '{"objective_id": "", "score": 50}', '{"objective_id": "a", "score": 101}', '{"objective_id": "a"', '{"score": "x"}', "[]", '{"objective_id": "a", "score": 0, "more": 1}']


@query(f"select o_orderkey, {sql_list([None, 'objective_id is empty', 'score out of range', 'not readable', 'not readable', 'not readable', None])}[(o_orderkey % 7 + 1)::int] error from orders")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").withColumn("v", values.parsed_json(pick("o_orderkey", REQUESTS), "struct<objective_id:string,score:int>"))
    rules = [(F.col("v.objective_id") != "", "objective_id is empty"), (F.col("v.score").between(0, 100), "score out of range")]
    return r.select("o_orderkey", values.request_error(F.col("v"), rules).alias("error"))


# Reports of the application
@query("""
select (select count(*) from region) subjects, (select count(*) from customer) objectives, (select count(*) from lineitem where l_returnflag = 'R') open_points, (select max(ts) from events) last_event, 'ok' status
""")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals, each from its own table (five single rows are joined)."""
    parts = [
        table(spark, sf_dir, "region").agg(F.count("*").alias("subjects")),
        table(spark, sf_dir, "customer").agg(F.count("*").alias("objectives")),
        table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("open_points")),
        table(spark, sf_dir, "events").agg(F.max("ts").alias("last_event")),
    ]
    out = parts[0].withColumn("k", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("k", F.lit(1))), "k")
    return out.drop("k").withColumn("status", F.lit("ok"))


@query("""
select r_regionkey subject_id, r_name as name, count(distinct n_nationkey) sections, count(c_custkey) objectives, r_regionkey in (1, 2) locked from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all
""")
def subject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.count("*").alias("sections"), F.sum(F.coalesce("n", F.lit(0))).alias("objectives"))
    r = table(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return r.select(F.col("r_regionkey").alias("subject_id"), F.col("r_name").alias("name"), F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("objectives", F.lit(0)).alias("objectives"), F.col("r_regionkey").isin(1, 2).alias("locked"))


@query("""
with p as (select o_custkey, count(*) n, max(o_orderdate) last_seen, avg(case when o_orderstatus = 'F' then 100.0 else 0.0 end) score from orders group by 1)
select c_custkey objective_id, c_name statement, n_name section, coalesce(n, 0) attempts, last_seen, round(coalesce(score, 0), 6) score, exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal > 9000) has_lesson from customer join nation on n_nationkey = c_nationkey left join p on o_custkey = c_custkey
""")
def objective_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_seen"), F.avg(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0)).alias("score"))
    lessons = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("l", F.lit(True))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    c = c.join(p, F.col("o_custkey") == F.col("c_custkey"), "left").join(lessons, "c_nationkey", "left")
    return c.select(F.col("c_custkey").alias("objective_id"), F.col("c_name").alias("statement"), F.col("n_name").alias("section"), F.coalesce("n", F.lit(0)).alias("attempts"), "last_seen", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.coalesce("l", F.lit(False)).alias("has_lesson"))


@query("""
select n_nationkey || '.' || c_custkey objective_num, c_name statement, '' approved, '' notes, n_name section, row_number() over (order by n_nationkey, c_custkey) as pos from customer join nation on n_nationkey = c_nationkey
""")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objectives with their place in the order of the syllabus and blank columns for a reviewer."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = status.numbered(table(spark, sf_dir, "customer").join(n, "c_nationkey"), [F.asc("c_nationkey"), F.asc("c_custkey")], "pos")
    return sinks.review_sheet(rows.select(F.concat("c_nationkey", F.lit("."), "c_custkey").alias("objective_num"), F.col("c_name").alias("statement"), F.col("n_name").alias("section"), (F.col("pos") + 1).alias("pos")))


HTML = ["<!doctype html><html>x</html>", "```html\n<html></html>", "<html>cut off", None, "  <html></html>\n"]


@query(f"select s_suppkey, {sql_list([True, False, False, False, True])}[(s_suppkey % 5 + 1)::int] valid, case when s_suppkey % 5 in (0, 4) then 'cached' else 'made again' end outcome from supplier")
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the cache that are whole are used, others are made again."""
    ok = sinks.whole_page(pick("s_suppkey", HTML))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ok.alias("valid"), F.when(ok, "cached").otherwise("made again").alias("outcome"))


@query("""
with r as (select l_orderkey, l_linenumber, case when l_suppkey % 5 = 0 then 'p. 3' else l_linenumber::varchar end source_page, l_quantity from lineitem)
select l_orderkey, count(*) filter (try_cast(source_page as int) = 3) on_page, count(*) filter (try_cast(source_page as int) is null) bad from r group by 1
""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one page; what is no page number is on none."""
    page = F.when(F.col("l_suppkey") % 5 == 0, "p. 3").otherwise(F.col("l_linenumber").cast("string"))
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", page.alias("source_page"))
    return r.groupBy("l_orderkey").agg(F.count_if(F.coalesce(lookup.on_page(F.col("source_page"), 3), F.lit(False))).alias("on_page"), F.count_if(F.col("source_page").try_cast("int").isNull()).alias("bad"))


# Names, marks and numbers
NAMES = ["/a/MCQ bank.json", "/a/x solution.txt", "/kb/generated/a.md", "/kb/b.md", "/kb/notes/c.PPTM", "/kb/past_papers/d.PDF", "/kb/e.xyz"]


@query(f"""
select c_custkey, {sql_list(['mcq_bank', 'solutions', 'front_matter', 'notes', 'office', 'pdf', None])}[k] family, {sql_list([None, None, None, None, 'notes', 'past_paper', None])}[k] content_type,
  {sql_list(['application/octet-stream', 'text/plain', 'application/octet-stream', 'application/octet-stream', 'application/octet-stream', 'application/pdf', 'application/octet-stream'])}[k] mime, {sql_list(['MCQ bank.json', 'x solution.txt', 'generated/a.md', 'b.md', 'notes/c.PPTM', 'past_papers/d.PDF', 'e.xyz'])}[k] relative,
  {sql_list([None, None, 'front_matter', None, None, None, None])}[k] only_front from (select c_custkey, (c_custkey % 7 + 1)::int k from customer)
""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pick("c_custkey", NAMES)
    c = table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    return c.select("c_custkey", files.family(F.col("path")).alias("family"), files.content_type(F.col("path")).alias("content_type"), files.mime(F.col("path")).alias("mime"), parsing.relative_path(F.col("path"), "/kb").alias("relative"), files.family(F.col("path"), only="front_matter").alias("only_front"))


@query("""
select distinct s_suppkey from supplier where s_suppkey % 3 = 0 and s_suppkey % 2 = 0
""")
def format_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of which the same name exists as a PDF."""
    s = table(spark, sf_dir, "supplier")
    name = lambda ext: F.concat("s_name", F.lit(ext)).alias("name")
    both = s.filter("s_suppkey % 3 = 0").select("s_suppkey", name(".PPTX")).unionByName(s.filter("s_suppkey % 2 = 0").select("s_suppkey", name(".pdf")))
    return curate.twins(both, "name", "pdf", "pptx").select("s_suppkey")


@query("""
select p_partkey, coalesce(case when p_type = 'SMALL' then 'o-small' end, case when p_brand = 'Brand#3' and p_type = 'ECONOMY' then 'o-3e' end, case when p_brand = 'Brand#3' then 'o-3' end, 'UNMAPPED') objective_id from part
""")
def topic_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = {f"Brand#{n}": {"default_objective": "o-3" if n == 3 else None, "subtopic_overrides": {"SMALL": "o-small"} | ({"ECONOMY": "o-3e"} if n == 3 else {})} for n in range(0, 60)}
    q = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("topic"), F.col("p_type").alias("subtopic"))
    return files.bind_topics(q, files.topic_map(spark, small)).select("p_partkey", "objective_id")


@query("""
with w as (select l_orderkey, case when l_quantity < 10 then -1 else l_quantity end conf, l_comment from (select l_orderkey, l_quantity, '' l_comment from lineitem))
select l_orderkey, coalesce(trunc(avg(conf) filter (conf <> -1))::int, 0) confidence from w group by 1
""")
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") < 10, -1.0).otherwise(F.col("l_quantity")).alias("conf"))
    return files.mean_confidence(w, "l_orderkey")


@query("""
select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey) occurrence, max(case when l_quantity > 25 then l_linenumber end) over (partition by l_orderkey order by l_linenumber, l_partkey rows unbounded preceding) header from (select distinct l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity from lineitem) qualify count(*) over (partition by l_orderkey, l_linenumber) = 1
""")
def header_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a group has occurred, and the last header that carries on; rows whose line number repeats are left out afterwards."""
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity").distinct()
    li = li.withColumn("__r", F.count("*").over(W.partitionBy("l_orderkey", "l_linenumber"))).withColumn("n", F.struct("l_linenumber", "l_partkey"))
    li = lines.counters(li, ["l_orderkey"], ["l_returnflag"], "n", "occurrence")
    li = lines.carry(li, ["l_orderkey"], "header", F.when(F.col("l_quantity") > 25, F.col("l_linenumber")))
    return li.filter("__r = 1").select("l_orderkey", "l_linenumber", "l_partkey", F.col("occurrence").cast("long").alias("occurrence"), "header")


SPECS = ["3-4", "1 2", "4–2", "1, 2 and 5", "", None, "7"]
CODES = ["S.O: 1.6, 2.3", "so 4", "1.1 x 2", "", None, "S.O. 9.9", "3"]
MARKED = ["• one\n- two\n1. three\n(2 marks)\n5 marks", "4. What\n* a\n* a", "none", None, "2) x\n10 marks", "- a", "1 mark"]
FENCED = ['```json\n{"a": 1}\n```', "text [1, 2] end", "plain", "```\n[]\n```", '{"b": {"c": 2}}', "", "x {y"]


@query(f"""
with c as (select o_orderkey, (o_orderkey % 7 + 1)::int k from orders)
select o_orderkey, {sql_list(['3,4', '1,2', '2,3,4', '1,2,5', '', '', '7'])}[k] numbers, {sql_list(['high', 'high', 'medium', 'medium', 'medium', 'medium', 'high'])}[k] confidence, {sql_list(['1.6,2.3', '4', '1.1,2', '', '', '9.9', '3'])}[k] codes,
  {sql_list(['one,two,three', 'a,What', '', '', 'x', 'a', ''])}[k] bullets, {sql_list([5, None, None, None, 10, None, 1])}[k] marks, {sql_list(['{"a": 1}', '[1, 2]', 'plain', '[]', '{"b": {"c": 2}}', '', 'x {y'])}[k] fenced from c
""".replace('"marks"', "marks"))
def parsed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[pick("o_orderkey", v).alias(n) for n, v in (("spec", SPECS), ("so", CODES), ("t", MARKED), ("f", FENCED))])
    return o.select("o_orderkey", F.array_join(parsing.objective_numbers(F.col("spec")).cast("array<string>"), ",").alias("numbers"), parsing.objective_confidence(F.col("spec")).alias("confidence"), F.array_join(parsing.codes(F.col("so")), ",").alias("codes"), F.array_join(parsing.bullets(F.col("t")), ",").alias("bullets"), parsing.mark_allocation(F.col("t")).alias("marks"), F.trim(text.strip_fence(F.col("f")), ).alias("fenced"))


@query("""
select doc_id, regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '', 'g') slug, coalesce(length(text) // 700 + case when length(text) % 700 > 0 then 1 else 0 end, 0) n_slices, trim(regexp_replace(regexp_replace(left(text, 30), '^\\s+', ''), '\\s+$', '') || coalesce(' ' || nullif(trim(source), ''), '')) corpus, length(text) > 1000 cut from documents
""")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("head", F.substring("text", 1, 30))
    shown = text.preview(F.col("text"), 1000)
    return d.select("doc_id", text.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"), F.size(text.slices(F.col("text"), 700, 10_000_000)).cast("long").alias("n_slices"), text.match_text(F.col("head"), F.col("source")).alias("corpus"), shown.endswith("see chunks]").alias("cut"))


@query("""
select l_orderkey, l_linenumber, greatest(0, least(100, trunc(l_extendedprice / 500)::int)) clamped, case when l_quantity * l_linenumber * 90000 > 1000000 then floor(300 * sqrt(1000000.0 / (l_quantity * l_linenumber * 90000)))::int else 300 end dpi,
  case when l_linenumber between 1 and 4 then [l_partkey, l_suppkey, 7, 9][l_linenumber] end step from lineitem
""")
def clamped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.col("l_partkey"), F.col("l_suppkey"), F.lit(7), F.lit(9))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.clamp((F.col("l_extendedprice") / 500).cast("int").cast("string")).alias("clamped"), values.render_dpi(F.col("l_quantity"), F.col("l_linenumber"), 1_000_000).alias("dpi"), values.step(items, F.col("l_linenumber")).alias("step"))


@query("""
with w as (select l_orderkey, l_linenumber, l_quantity x, l_linenumber * 5 y, l_suppkey w from (select distinct on (l_orderkey, l_linenumber, l_quantity) * from lineitem order by l_suppkey)),
b as (select *, row_number() over (partition by l_orderkey order by y) rn from w where x between 10 and 40)
select l_orderkey, y::double y, count(*) n from b group by all
""")
def band_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a band of the page in lines: here every line number is one."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 5).alias("y"), F.col("l_quantity").alias("x"), F.lit("w").alias("word")).distinct()
    out = lines.word_lines(li, ["l_orderkey"], 10, 40)
    return out.select("l_orderkey", F.col("y").cast("double").alias("y"), F.size(F.split("text", " ")).cast("long").alias("n"))


@query("""
with s as (select l_orderkey, 230 + l_linenumber * 10 x0, 235 + l_linenumber * 10 x1 from lineitem), c as (select distinct l_orderkey, unnest(range(x0, x1 + 1)) x from s),
f as (select l_orderkey, x from (select distinct l_orderkey from s), range(230, 321) t(x) where (l_orderkey, x) not in (select l_orderkey, x from c)),
r as (select l_orderkey, x - row_number() over (partition by l_orderkey order by x) run, x from f), g as (select l_orderkey, run, count(*) width, (min(x) + max(x)) / 2 middle, min(x) x from r group by all)
select l_orderkey, max(width) width, arg_max(middle, width * 1000 - x) middle from g group by 1
""")
def gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", (230 + F.col("l_linenumber") * 10).alias("x0"), (235 + F.col("l_linenumber") * 10).alias("x1"))
    return lines.gutter(spans, "l_orderkey")


@query("""
with p as (select l_orderkey, l_linenumber page, min(l_returnflag) flag from lineitem group by all), f as (select l_orderkey, min(case when flag = 'A' then page end) as first_page, max(page) most from p group by 1),
e as (select p.l_orderkey, min(page) - 1 stop from p join f on p.l_orderkey = f.l_orderkey where flag = 'R' and page > first_page group by 1)
select f.l_orderkey, first_page, case when first_page is not null then coalesce(stop, most) end last_page from f left join e on e.l_orderkey = f.l_orderkey
""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("body"))
    r = lines.page_range(p, "l_orderkey", "A", "R")
    return r.select("l_orderkey", F.col("first").alias("first_page"), F.col("last").cast("int").alias("last_page"))


@query("""
with p as (select l_orderkey, l_linenumber page, min(l_quantity::int) length from lineitem group by all), s as (select *, coalesce(sum(length + 1) over (partition by l_orderkey order by page rows between unbounded preceding and 1 preceding), 0)::bigint as start from p),
o as (select distinct l_orderkey, (l_partkey % 60)::bigint pos from lineitem)
select o.l_orderkey, pos, (select arg_max(page, page) from s where s.l_orderkey = o.l_orderkey and start <= pos) page from o
""")
def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy("l_orderkey", F.col("l_linenumber").alias("page")).agg(F.min(F.col("l_quantity").cast("int")).alias("length"))
    o = li.select("l_orderkey", (F.col("l_partkey") % 60).alias("at")).distinct()
    return lines.page_of(o, p, "l_orderkey").withColumnRenamed("at", "pos").select("l_orderkey", "pos", "page")


@query("""
select 'o_orderstatus' rule, count(*) n from orders where o_orderstatus not in ('F', 'O') union all select 'o_orderpriority', count(*) from orders where o_orderpriority not in ('5-LOW', '1-URGENT')
""")
def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = [schemas.outside(o, c, allowed).agg(F.lit(c).alias("rule"), F.count("*").alias("n")) for c, allowed in (("o_orderstatus", ("F", "O")), ("o_orderpriority", ("5-LOW", "1-URGENT")))]
    return parts[0].unionByName(parts[1])


@query("""
select 'ocr' what, count(*) n from (select doc_id, case when length(trim(coalesce(text, ''))) < 500 or avg(length(trim(coalesce(text, '')))) over (partition by source) < 100 then 1 end ocr from documents) where ocr = 1
""")
def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.col("text").alias("body"))
    return files.needs_ocr(d, "source", 500, 100).filter("ocr").agg(F.lit("ocr").alias("what"), F.count("*").alias("n"))


@query("""
select p_partkey, case when p_size % 3 = 0 then 'CLEAN' when p_size % 3 = 1 then 'PARTIAL' else 'POOR' end quality from part
""")
def ocr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(i.cast("string"), F.lit(". an item of the list"))), "\n")
    t = F.when(F.col("p_size") % 3 == 0, items(45)).when(F.col("p_size") % 3 == 1, F.concat(items(45), F.repeat(F.lit("~|"), F.lit(40)))).otherwise(items(9))
    return table(spark, sf_dir, "part").select("p_partkey", files.ocr_quality(t).alias("quality"))


@query("""
with l as (select page_id, url, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) link from pages where html is not null), h as (select page_id, link, regexp_matches(link, '^[a-z]+://') whole, lower(regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1)) host, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) own from l),
f as (select page_id, case when whole then host else own end host from h)
select page_id, host, case when host = 'example.com' or ends_with(host, '.example.com') then 'blocked' when host = 'org' or ends_with(host, '.org') then 'allowed' else 'unknown' end state, count(*) n from f group by all
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    found = files.marked_links(p.select(F.concat("url", F.lit("\t"), "page_id").alias("url"), "html"), "url", "html", ("org",), ("example.com",))
    return found.groupBy(F.split_part("url", F.lit("\t"), F.lit(-1)).cast("long").alias("page_id"), "host", "state").agg(F.count("*").alias("n"))


@query("""
with e as (select user_id, list({'id': event_type, 'c': least(100, greatest(0, value::int))} order by event_id) l from events group by 1)
select user_id, array_to_string(list_transform(list_filter(l, lambda x: x.id in ('click', 'view'))[:15], lambda x: x.id || x.c), ',') kept from e
""")
def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("id"), F.rint("value").cast("int").alias("confidence")))).alias("l"))
    kept = values.keep_valid(F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["confidence"].alias("confidence"))), F.array(F.lit("click"), F.lit("view")))
    return e.select("user_id", F.array_join(F.transform(kept, lambda x: F.concat(x["id"], x["confidence"].cast("string"))), ",").alias("kept"))


@query("""
select n_nationkey || '' doc, n_nationkey % 3 + 2 n_points, 'Point ' || n_nationkey || ' a' first_point, (n_nationkey % 3 + 4) - (n_nationkey % 3 + 1) missing from nation
""")
def scheme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark scheme of one question for each nation: its points, and the marks for which none was found."""
    n = F.col("n_nationkey")
    points = F.array_join(F.transform(F.sequence(F.lit(0), n % 3), lambda i: F.concat(F.lit("- Point "), n, F.lit(" "), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), i + 1))), "\n")
    body = F.concat(F.lit("Question 1\n(a) Say\n"), points, F.lit("\n"), (n % 3 + 4).cast("string"), F.lit(" marks"))
    rows = papers.mark_scheme(table(spark, sf_dir, "nation").select(n.cast("string").alias("doc"), F.lit(1).alias("page"), body.alias("body")), ["doc"])
    review = F.col("point_text").startswith("[REVIEW")
    return rows.groupBy("doc").agg(F.count("*").alias("n_points"), F.min_by("point_text", "point_order").alias("first_point"), F.sum(F.when(review, F.col("marks_value")).otherwise(0)).alias("missing"))


@query("""
select n_nationkey || '' doc, 'X-SEC-' || n_regionkey section_id, n_name section_title, 'X-' || n_regionkey || '.1' objective_id, 'Explain how ' || n_name || ' trades' content_stmt, 'Understanding' skill_type from nation
""")
def syllabus_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("SECTION "), "n_regionkey", F.lit(": "), "n_name", F.lit("\nStudents should be able to\n1. explain how\n"), "n_name", F.lit(" trades;\nCONTENT\n2. not this"))
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc"), body.alias("t"))
    return papers.syllabus(d, ["doc"], "t", "X").select("doc", "section_id", "section_title", "objective_id", "content_stmt", "skill_type")


@query("""
select n_nationkey || '' doc, '1(b)(ii)' question, n_nationkey::int + 1 page, 'Question 1.' || chr(10) || chr(10) || 'Of ' || n_name || '.' || chr(10) || chr(10) || 'Two' || chr(10) || chr(10) || '(ii) second' stem from nation
""")
def paper_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first = n.select(F.col("n_nationkey").cast("string").alias("doc"), F.col("n_nationkey").cast("int").alias("page"), F.concat(F.lit("- 2 -\n1.\nOf "), "n_name", F.lit(".\n(a)\nOne\n(b)\nTwo\n(i)\nfirst")).alias("body"))
    second = n.select(F.col("n_nationkey").cast("string").alias("doc"), (F.col("n_nationkey").cast("int") + 1).alias("page"), F.lit("(ii)\nsecond\nTotal 9 marks\nEND").alias("body"))
    return papers.question_paper(first.unionByName(second), ["doc"]).filter("question = '1(b)(ii)'")


@query("""
select n_nationkey::bigint doc, '1(a)' label, n_name stem, 'Answer ' || n_nationkey || ' goes on' bullet, 2 marks_value from nation
""")
def solution_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("12\n1\n(a) "), "n_name", F.lit("\n• Answer "), "n_nationkey", F.lit("\ngoes on\ntwo marks each\n(4 marks)"))
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc"), F.lit(1).alias("page"), body.alias("body"))
    return papers.worked_solutions(pages, "doc").select("doc", "label", "stem", F.col("bullets")[0].alias("bullet"), "marks_value")


@query("""
select n_nationkey::bigint doc, 2 number, 'Stem of ' || n_name || ' here' stem, 'one' a, 'four' d from nation
""")
def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("9. skipped ahead\n2. Stem of "), "n_name", F.lit("\nhere\n(A) one\n(B) two\n(C) three\n(D) four\n3. no options"))
    q = lines.choice_questions(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc"), body.alias("t")), ["doc"], "t")
    return q.select("doc", "number", "stem", F.col("options")["A"].alias("a"), F.col("options")["D"].alias("d"))


@query("""
select s_suppkey, 2012 + s_suppkey % 2 yr, (s_suppkey % 9)::int number, 'b' letter from supplier
""")
def topic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    cell = lambda parity: F.when(F.col("s_suppkey") % 2 == parity, F.concat((F.col("s_suppkey") % 9).cast("string"), F.lit("B,")))
    grid = s.select(F.col("s_suppkey").cast("string").alias("topic"), cell(0).alias("a"), cell(1).alias("b"))
    return papers.topics(grid, "topic", {2012: "a", 2013: "b"}).select(F.col("topic").cast("long").alias("s_suppkey"), F.col("year").cast("long").alias("yr"), "number", "letter")


@query("select c_custkey, case when c_acctbal < 0 then 'failed' when c_acctbal < 3000 then 'pending' else 'ready' end before_run, case when c_acctbal < 3000 then 'pending' else 'ready' end after_reset from customer")
def reset_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("c_acctbal") < 0, "failed").when(F.col("c_acctbal") < 3000, "pending").otherwise("ready")
    c = table(spark, sf_dir, "customer").select("c_custkey", b.alias("before_run"), b.alias("extract_status"))
    return status.reset(c, F.col("extract_status") == "failed").select("c_custkey", "before_run", F.col("extract_status").alias("after_reset"))
