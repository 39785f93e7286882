"""Queries over the state machines: staged files, classifications, reviews, lessons and queues.

Orders stand for staged files, lines for attempts and log rows, events for decisions, parts for lessons and points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.functions import values
from syllabrook.operators import status
from syllabrook.plans.registry import query
from syllabrook.session import table


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as staged files that an earlier run has left in some state."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("staging_id"), "lang", "source", F.col("text").alias("full_text"), F.col("n_chars").alias("n"))
    return d.withColumns({"extract_status": F.lit("pending"), "extracted_text": F.lit(None).cast("string"), "extract_error": F.lit(None).cast("string"), "ocr_used": F.lit(False), "ocr_pages_count": F.lit(0), "ocr_confidence_avg": F.lit(None).cast("double"), "truncated": F.lit(False)})


@query("""
select doc_id staging_id, case when lang = 'es' then 'pending' when text is null or n_chars > 9000 then 'failed' else 'ready' end extract_status,
  case when lang <> 'es' and text is not null and n_chars <= 9000 then least(length(text), 2000) end shown, case when lang <> 'es' and n_chars > 9000 then 'too long: ' || n_chars when lang <> 'es' and text is null then 'no text' end extract_error,
  (lang <> 'es' and text is not null and n_chars <= 9000 and n_chars % 4 > 0) ocr_used, (lang <> 'es' and text is not null and n_chars <= 9000 and length(text) > 2000) truncated from documents
""")
def extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _staged(spark, sf_dir)
    run = s.filter("lang <> 'es'").select("staging_id", F.col("full_text").alias("text"), (F.col("n") % 4).cast("int").alias("ocr_pages"), F.lit(80.0).alias("confidence"), F.when(F.col("n") > 9000, F.concat(F.lit("too long: "), "n")).alias("error"))
    out = status.extracted(s.drop("full_text"), run, preview=2000)
    return out.select("staging_id", "extract_status", F.length("extracted_text").alias("shown"), "extract_error", "ocr_used", "truncated")


@query("""
with l as (select doc_id staging_id, text from documents where length(text) > 2000 and n_chars <= 9000)
select staging_id, i::int chunk_index, length(substr(substr(text, 1, 8000), (i * 1500 + 1)::int, 1500)) n from l, range(6) t(i) where i * 1500 < least(length(text), 8000)
""")
def extract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _staged(spark, sf_dir)
    run = s.select("staging_id", F.col("full_text").alias("text"), F.when(F.col("n") > 9000, "too long").alias("error"))
    return status.chunks_of(run, preview=2000, size=1500, hard=8000).select("staging_id", "chunk_index", F.length("chunk_text").alias("n"))


@query("""
with s as (select doc_id, text, source = 'src0' as pages_known, n_chars % 3 = 0 ocr_used, lang <> 'fr' ready from documents),
m as (select *, coalesce(len(regexp_extract_all('[Page 1]' || text, '\\[Page |\\.\\n')), 0) n from s)
select doc_id staging_id, case when ready and not ocr_used and not pages_known then 'pending' when ready then 'ready' else 'failed' end extract_status,
  (ready and not ocr_used and not pages_known) queued,
  coalesce(ready and not ocr_used and not pages_known and (length(text) + 8 + 6 * (n - 1) - len(regexp_extract_all(text, '\\.\\n '))) / n < 100, false) low from m
""".replace("\\\\", "\\"))
def extract_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from before page counts were kept, with each paragraph marked as a page, and which of them are poor scans."""
    s = _staged(spark, sf_dir)
    marked = F.concat(F.lit("[Page 1]"), F.regexp_replace("full_text", r"\.\n", ".\n[Page"))
    marked = F.regexp_replace(marked, r"\[Page(?! )", "[Page ")
    s = s.withColumns({"extract_status": F.when(F.col("lang") != "fr", "ready").otherwise("failed"), "extracted_text": marked, "ocr_used": F.col("n") % 3 == 0, "total_pages": F.when(F.col("source") == "src0", 1)})
    again = status.read_again(s).select("staging_id", status.low_quality(F.col("extracted_text")).alias("__low"))
    out = s.join(again, "staging_id", "left").withColumn("queued", F.col("__low").isNotNull())
    done = status.reset(out, F.col("queued"))
    return done.select("staging_id", "extract_status", "queued", F.coalesce("__low", F.lit(False)).alias("low"))


@query("""
with s as (select o_orderkey, case o_orderstatus when 'F' then 'unclassified' when 'O' then 'classifying' else 'classified' end st, o_orderpriority = '1-URGENT' skip, o_totalprice > 1000 ready from orders)
select o_orderkey staging_id, case when skip then 'skipped' when st = 'classifying' then 'unclassified' else st end healed,
  (ready and not skip and (st = 'classifying' or st = 'unclassified')) open_files, (ready and not skip) forced from s
""")
def classify_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all files heals first; the force flag drops one predicate."""
    o = table(spark, sf_dir, "orders")
    st = F.when(F.col("o_orderstatus") == "F", "unclassified").when(F.col("o_orderstatus") == "O", "classifying").otherwise("classified")
    s = o.select(F.col("o_orderkey").alias("staging_id"), st.alias("classification_status"), (F.col("o_orderpriority") == "1-URGENT").alias("skip_classification"), F.when(F.col("o_totalprice") > 1000, "ready").otherwise("failed").alias("extract_status"))
    s = s.withColumn("classification_status", status.healed(F.col("classification_status"), F.col("skip_classification")))
    hit = lambda force, name: status.eligible(s, force).select("staging_id", F.lit(True).alias(name))
    out = s.join(hit(False, "open_files"), "staging_id", "left").join(hit(True, "forced"), "staging_id", "left")
    return out.select("staging_id", F.col("classification_status").alias("healed"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("open_files", "forced")])


@query("""
with a as (select l_orderkey, l_linenumber n, min(l_discount) d, max(l_returnflag) f from lineitem group by all),
g as (select l_orderkey, min(case when d >= 0.05 then n end) filter (n <= 3) as first_good, arg_min(f, n) filter (n <= 3 and d >= 0.05) answer, arg_max('bad ' || f, n) filter (n <= 3 and d < 0.05) err, max(n) filter (n <= 3) last from a group by 1)
select l_orderkey staging_id, case when first_good is not null then 'classified' else 'failed' end status, answer, case when first_good is null then 'ERROR: ' || err end rationale, coalesce(first_good, last) attempts from g where last is not null
""")
def classify_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("staging_id"), F.col("l_linenumber").alias("attempt")).agg(F.min("l_discount").alias("d"), F.max("l_returnflag").alias("f"))
    good = F.col("d") >= 0.05
    return status.classified(a.select("staging_id", "attempt", F.when(good, F.col("f")).alias("answer"), F.when(~good, F.concat(F.lit("bad "), "f")).alias("error")))


@query("""
with e as (select user_id, list({'o': event_type, 'c': greatest(0, least(100, trunc(value * 3)::int))} order by event_id) items, max(value) conf, count(*) filter (event_type not in ('click', 'view', 'signup'))::int dropped from events group by 1)
select user_id staging_id, case when user_id % 7 = 0 then '04_NOTES' else 'UNCERTAIN' end folder, greatest(0, least(100, trunc(conf * 2)::int)) folder_confidence,
  array_to_string(list_transform(list_filter(items, lambda x: x.o in ('click', 'view', 'signup'))[:15], lambda x: x.o || ':' || x.c), ',') objectives,
  trim('seen ' || case when dropped > 0 then '[Filtered ' || dropped || ' objective id(s) not in the syllabus.]' else '' end) rationale, dropped from e
""")
def classify_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("l"), F.max("value").alias("conf"))
    items = F.transform("l", lambda x: F.struct(x["event_type"].alias("objective_id"), (x["value"] * 3).cast("int").cast("string").alias("confidence")))
    folder = F.when(F.col("user_id") % 7 == 0, "04_NOTES").otherwise("elsewhere")
    valid = F.array(*[F.lit(v) for v in ("click", "view", "signup")])
    c = e.select(F.col("user_id").alias("staging_id"), status.checked_classification(folder, (F.col("conf") * 2).cast("int").cast("string"), items, valid, F.lit(" seen ")).alias("c"))
    listed = F.array_join(F.transform("c.objectives", lambda x: F.concat(x["objective_id"], F.lit(":"), x["confidence"].cast("string"))), ",")
    return c.select("staging_id", F.col("c.recommended_folder").alias("folder"), "c.folder_confidence", listed.alias("objectives"), "c.rationale", "c.dropped")


@query("""
select o_orderkey staging_id, case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'unclassified' else 'skipped' end classification_status, not (o_orderpriority = '1-URGENT' and o_orderstatus = 'F') skip_classification,
  case when not (o_orderpriority = '1-URGENT' and o_orderstatus = 'F') then o_orderpriority end skip_reason from orders
""")
def unskip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("staging_id"), F.lit("skipped").alias("classification_status"), F.lit(True).alias("skip_classification"), F.col("o_orderpriority").alias("skip_reason"), "o_orderstatus")
    return status.unskipped(s, (F.col("skip_reason") == "1-URGENT") & (F.col("o_orderstatus") == "F")).drop("o_orderstatus")


REVIEW = """
with d as (select user_id, case event_type when 'click' then 'accepted' when 'view' then 'overridden' else 'rejected' end decision, case when value > 50 then '03_MARK_SCHEMES' end folder, case when value > 30 then ['o' || user_id] end objs
  from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
c as (select c_custkey staging_id, decision, case when decision = 'overridden' then folder end review_folder, case when decision = 'overridden' then objs end review_objectives, ['p' || c_nationkey, 'q'] proposed from customer left join d on user_id = c_custkey)
"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "view", "overridden").otherwise("rejected")
    d = e.select(F.col("user_id").alias("staging_id"), kind.alias("decision"), F.when(F.col("value") > 50, "03_MARK_SCHEMES").alias("folder"), F.when(F.col("value") > 30, F.array(F.concat(F.lit("o"), "user_id"))).alias("objectives"), F.col("event_type").alias("notes"), "ts", "event_id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("staging_id"), F.array(F.concat(F.lit("p"), "c_nationkey"), F.lit("q")).alias("proposed"), "c_acctbal")
    return status.reviewed(c, d, [F.desc("ts"), F.desc("event_id")])


@query(REVIEW + """
select staging_id, decision review_decision, array_to_string(case when decision = 'overridden' then coalesce(review_objectives, proposed) else proposed end, ',') bound,
  case when decision = 'overridden' then coalesce(review_folder, '04_NOTES') else '04_NOTES' end destination from c
""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = _reviewed(spark, sf_dir), F.col("review_decision")
    return r.select("staging_id", "review_decision", F.array_join(status.binding(d, F.col("proposed"), F.col("review_objectives")), ",").alias("bound"), status.destination(d, F.lit("04_NOTES"), F.col("review_folder")).alias("destination"))


@query(REVIEW + """, s as (select c.*, c_acctbal from c join customer on c_custkey = staging_id)
select outcome, count(*) n from (select case when decision in ('accepted', 'overridden') then case when c_acctbal < 0 then 'failed' else 'ingested' end when staging_id % 2 = 0 then 'queued' else 'not_started' end outcome from s) group by 1
""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would do, counted without writing anything."""
    r = _reviewed(spark, sf_dir)
    before = F.when(F.col("staging_id") % 2 == 0, "queued")
    after = status.ingestion(before, F.col("review_decision"), status.binding(F.col("review_decision"), F.col("proposed"), F.col("review_objectives")), F.when(F.col("c_acctbal") < 0, "overdrawn"))
    return status.outcome_counts(r, after)


LESSONS = "l as (select p_partkey, p_size > 40 was_stale, p_partkey in (select l_partkey from lineitem where l_quantity >= 49) hit, p_partkey in (select l_partkey from lineitem where l_quantity <= 1) again from part)"


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("p_size") > 40
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("objective_id"), old.alias("is_stale"), F.when(old, "edited").alias("stale_reason"), F.when(old, F.lit("2024-01-01")).alias("staled_at"))
    hit = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("objective_id"))
    return status.staled(p, hit, "new material", F.lit("2024-02-02"))


@query(f"""
with {LESSONS}
select p_partkey objective_id, (hit or was_stale) and not again is_stale, case when again then null when hit then 'new material' when was_stale then 'edited' end stale_reason, case when again then null when hit then '2024-02-02' when was_stale then '2024-01-01' end staled_at from l
""")
def stale_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = table(spark, sf_dir, "lineitem").filter("l_quantity <= 1").select(F.col("l_partkey").alias("objective_id"))
    return status.refreshed(_lessons(spark, sf_dir), written)


@query(f"""
with {LESSONS}, g as (select l_partkey, o_orderpriority f, min(l_orderkey) as seen from lineitem join orders on o_orderkey = l_orderkey group by all),
c as (select l_partkey, string_agg(f, '|' order by seen) files from g group by 1)
select p_partkey objective_id, coalesce(files, '') caused_by_files from l left join c on l_partkey = p_partkey where hit or was_stale
""")
def stale_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("staging_id")).agg(F.to_json(F.sort_array(F.collect_set(F.col("l_partkey").cast("string")))).alias("lessons_staled")).withColumn("started_at", F.col("staging_id"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("staging_id"), F.col("o_orderpriority").alias("original_name"))
    lessons = _lessons(spark, sf_dir).withColumn("objective_id", F.col("objective_id").cast("string"))
    out = status.stale_causes(lessons, log, files)
    return out.select(F.col("objective_id").cast("long").alias("objective_id"), F.array_join("caused_by_files", "|").alias("caused_by_files"))


QUEUE = """
q as (select s_suppkey id, case when s_nationkey < 20 then 'Brand#' || (s_nationkey + 1) end objective, s_nationkey doc_id, s_acctbal > 0 derived,
  trim(s_name || case when s_acctbal > 5000 then ' ' else '' end) as point, s_acctbal from supplier),
p as (select *, objective || '-rec-' || left(sha1(doc_id || '|' || point), 10) mp from q where objective is not null and point <> '')
"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    objective = F.when(F.col("s_nationkey") < 20, F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1))
    mark = F.when(F.col("s_acctbal") > 5000, F.lit(" | EVIDENCE: seen")).when(F.col("s_acctbal") > 0, F.lit("\n\nEvidence: a quote | EVIDENCE: x")).otherwise(F.lit(""))
    return s.select(F.col("s_suppkey").alias("id"), objective.alias("objective_id"), F.col("s_nationkey").alias("doc_id"), F.concat("s_name", mark).alias("chunk_text"), F.when(F.col("s_acctbal") > 0, "syllabus_derived_first_run").otherwise("other").alias("reason"))


@query(f"""
with {QUEUE}, m as (select p_brand, max(p_size) m from part group by 1)
select p_brand || '/' || p_partkey mark_point_id, p_brand objective_id, p_name point_text, p_size::int point_order, 'manual' source_type from part
union all select mp, objective, point, (coalesce(m, 0) + row_number() over (partition by objective order by id))::int, case when derived then 'syllabus_derived' else 'recovered_extraction' end from p left join m on p_brand = objective
""")
def promote_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_partkey").alias("mark_point_id"), F.col("p_brand").alias("objective_id"), F.lit(None).cast("int").alias("doc_id"), F.col("p_name").alias("point_text"), F.col("p_size").alias("point_order"), F.lit("manual").alias("source_type"))
    return status.promoted(points, _queue(spark, sf_dir)).drop("doc_id")


@query("""
select s_suppkey id, s_name as point, case when s_acctbal > 5000 then 'seen' when s_acctbal > 0 then 'a quote | EVIDENCE: x' else '' end evidence from supplier
""")
def evidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("id", status.split_evidence(F.col("chunk_text")).alias("s")).select("id", "s.*")


@query("""
with d as (select s_suppkey id, case when s_acctbal > 3000 then 'obj-' || s_nationkey end objective from supplier where s_acctbal > 1000)
select s_suppkey id, case when id is null then 'queued' when objective is null then 'rejected' else objective end outcome from supplier left join d on id = s_suppkey
""")
def manual_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queue(spark, sf_dir)
    d = table(spark, sf_dir, "supplier").filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("obj-"), "s_nationkey")).alias("objective_id"))
    rows, left = status.assigned(q, d)
    gone = q.select("id").join(left.select("id"), "id", "left_anti").join(rows.select("id"), "id", "left_anti")
    return rows.select("id", F.col("objective_id").alias("outcome")).unionByName(left.select("id", F.lit("queued").alias("outcome"))).unionByName(gone.select("id", F.lit("rejected").alias("outcome")))


@query("""
select 'dry' run, s_suppkey id, 0 batch from supplier order by s_acctbal, s_suppkey limit 5
""")
def queue_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows, as a dry run of the prose queue shows them."""
    b = status.batches(table(spark, sf_dir, "supplier"), [F.asc("s_acctbal"), F.asc("s_suppkey")], dry_run=True)
    return b.select(F.lit("dry").alias("run"), F.col("s_suppkey").alias("id"), "batch")


@query("""
select o_orderkey id, ((row_number() over (order by o_totalprice desc, o_orderkey) - 1) // 20)::bigint batch from orders
""")
def queue_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue in batches, numbered throughout."""
    return status.batches(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select(F.col("o_orderkey").alias("id"), "batch")


@query("""
select s_suppkey id, ((row_number() over (order by s_acctbal, s_suppkey) - 1) // 20)::bigint batch from supplier qualify row_number() over (order by s_acctbal, s_suppkey) <= 50
""")
def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = status.batches(table(spark, sf_dir, "supplier"), [F.asc("s_acctbal"), F.asc("s_suppkey")], size=20, limit=50)
    return b.select(F.col("s_suppkey").alias("id"), "batch")


@query("""
with m as (select p_brand, max(p_size) m from part group by 1)
select s_suppkey, (coalesce(m, 0) + row_number() over (partition by 'Brand#' || s_nationkey order by s_suppkey))::int ordinal from supplier left join m on p_brand = 'Brand#' || s_nationkey
""")
def next_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), "s_nationkey").alias("p_brand"))
    old = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("ordinal"))
    return status.next_ordinal(new, old, "p_brand", "ordinal", [F.asc("s_suppkey")]).select("s_suppkey", F.col("ordinal").cast("int").alias("ordinal"))


@query("""
select user_id, event_type, count(*)::int attempts, arg_min(value, (ts, event_id)) first_value, max(value) best, (count(*) > 1) retried from events group by all
""")
def first_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt of each user at each kind of task counts; later ones are retries."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    return g.agg(F.count("*").cast("int").alias("attempts"), F.min_by("value", F.struct("ts", "event_id")).alias("first_value"), F.max("value").alias("best")).withColumn("retried", F.col("attempts") > 1)


@query("""
select o_orderkey, sha256(concat_ws('|', o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)) note_hash, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') stamp, strftime(o_orderdate, '%Y%m%d_%H%M%S') file_stamp,
  date_diff('millisecond', timestamp '1992-01-01 00:00:00', o_orderdate) elapsed_ms from orders
""")
def note_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of saving salts a note's hash, so that equal notes stay apart."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    stamp = values.stamp(at)
    return o.select("o_orderkey", values.salted_hash(F.col("o_custkey"), at, F.col("o_orderpriority")).alias("note_hash"), stamp.alias("stamp"), values.file_stamp(at).alias("file_stamp"), values.elapsed_ms(F.lit("1992-01-01 00:00:00").cast("timestamp"), at).alias("elapsed_ms"))
