"""Queries over texts, pages, vectors and JSON, and the ingest side's rewrites and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.functions import parsing, text, values
from syllabrook.operators import curate, lines, lookup, match
from syllabrook.plans.registry import query
from syllabrook.session import table
from syllabrook.sources import records

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{c}}, '')), '[a-z]+'), lambda w: length(w) > 2 and not list_contains([{STOP}], w)))"
#: Lower-casing differs for few letters outside of a to z between engines; these queries keep to ASCII text where it matters.


@query("""
with t as (select doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') s from documents where text is not null),
w as (select doc_id, s, unnest(range(0, greatest(0, ceil((length(s) - 500) / 400.0))::int + 1)) i from t where length(s) > 0)
select doc_id, i::int as position, substr(s, i * 400 + 1, 500) chunk from w
""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.regexp_replace(F.regexp_replace("text", r"^\s+", ""), r"\s+$", "")
    d = table(spark, sf_dir, "documents").select("doc_id", c.alias("s"))
    return d.select("doc_id", F.posexplode(text.windows(F.col("s"))).alias("position", "chunk"))


@query(f"""
with a as (select doc_id, unnest({TOKENS.format(c='text')}) token from documents), b as (select item_id, unnest({TOKENS.format(c='text')}) token from benchmark),
s as (select doc_id, item_id, count(*) score from a join b using (token) group by all having count(*) >= 2)
select * from s qualify row_number() over (partition by doc_id order by score desc, item_id) = 1
""")
def keyword_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.bind(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""
with a as (select doc_id, {TOKENS.format(c='text')} ta from documents), b as (select item_id, {TOKENS.format(c='text')} tb from benchmark),
x as (select doc_id, unnest(ta) token, len(ta) na from a), y as (select item_id, unnest(tb) token, len(tb) nb from b),
s as (select doc_id, item_id, count(*)::double / (any_value(na) + any_value(nb) - count(*)) jaccard from x join y using (token) group by all)
select * from s where jaccard >= 0.15 qualify row_number() over (partition by doc_id order by jaccard desc, item_id) = 1
""")
def jaccard_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.jaccard(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 0.15)


@query(f"""
with a as (select item_id, unnest({TOKENS.format(c='text')}) token from benchmark), b as (select doc_id, source, unnest({TOKENS.format(c='text')}) token from documents where source is not null),
s as (select item_id, doc_id, count(*) score, min(case when source = 'src0' then 0 else 1 end) tier from a join b using (token) group by all having count(*) >= 2)
select item_id, doc_id target, score, tier::int tier from s qualify row_number() over (partition by item_id order by tier, score desc, doc_id) = 1
""")
def tiered_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("source is not null").select("doc_id", "source", F.col("text").alias("statement"))
    tiers = [(d.filter("source = 'src0'"), "doc_id", "statement"), (d.filter("source <> 'src0'"), "doc_id", "statement")]
    return match.bind_tiers(table(spark, sf_dir, "benchmark"), "item_id", "text", tiers)


@query("select min(doc_id) doc_id, sha256(text) content_hash, count(*) copies from documents where text is not null group by 2")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
select doc_id, first_value(doc_id) over w original, row_number() over w > 1 is_duplicate from documents window w as (partition by md5(text) order by doc_id)
""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return curate.first_seen(d, "h", ["doc_id"], "doc_id").select("doc_id", "original", "is_duplicate")


@query("""
select b.doc_id, length(b.text) as length, min(a.doc_id) first_key from documents a join documents b on a.source is not distinct from b.source and length(a.text) = length(b.text) and a.doc_id < b.doc_id
where length(b.text) > 1000 group by 1, 2
""")
def length_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return curate.same_length(d, ["source"], "text", "doc_id", 1000).select("doc_id", "length", "first_key")


@query("""
with j as (select doc_id, n_chars, quality, toxic, length(text) > 20000 trunc from documents left join labels using (doc_id)),
a as (select doc_id, n_chars, concat_ws(',', case when quality = 0 then 'low_ocr_confidence' end, case when toxic = 1 then 'ocr_dpi_reduced' end, case when trunc then 'truncated' end) r from j)
select doc_id, case when r <> '' then r when n_chars < 200 then 'duplicate' end skip_reason from a
""")
def skip_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(lab, "doc_id", "left")
    rules = [(F.col("quality") == 0, "low_ocr_confidence"), (F.col("toxic") == 1, "ocr_dpi_reduced"), (F.length("text") > 20000, "truncated"), (F.col("n_chars") < 200, "duplicate")]
    return d.select("doc_id", curate.skip_cascade(rules, 2).alias("skip_reason"))


@query("""
with o as (select case when toxic is null then 'undecided' when toxic = 1 then 'skipped' when quality = 1 then 'accepted' else 'left' end outcome from documents left join labels using (doc_id))
select outcome, count(*) n from o group by 1
""")
def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = curate.partition_rows([(F.col("toxic").isNull(), "undecided"), (F.col("toxic") == 1, "skipped"), (F.col("quality") == 1, "accepted")], "left")
    return d.groupBy(state.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
with q as (select vec_id q_id, embedding q_vec, label ql from embeddings where vec_id in (0, 7, 19)),
d as (select q_id, vec_id id, round(sqrt(list_sum(list_transform(list_zip(q_vec, embedding), lambda p: (p[1]::double - p[2]::double) ** 2))), 6) distance from q join embeddings on label = ql)
select q_id, id, distance, row_number() over (partition by q_id order by distance, id)::int "rank" from d qualify "rank" <= 5
""")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id").isin(0, 7, 19)).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("q_label"))
    r = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return match.nearest(q, r, 5, F.col("label") == F.col("q_label")).select("q_id", "id", "distance", "rank")


@query("""
with q as (select embedding q_vec from embeddings where vec_id = 3), s as (select vec_id, round_even(list_cosine_similarity(embedding::double[], q_vec::double[]), 2) similarity from embeddings, q where vec_id <> 3)
select vec_id, similarity from s order by similarity desc, vec_id limit 3
""")
def cosine_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = F.broadcast(e.filter("vec_id = 3").select(F.col("embedding").alias("q_vec")).limit(1))  # one row
    s = e.filter("vec_id <> 3").join(q, F.lit(True)).select("vec_id", F.bround(values.cosine(F.col("embedding"), F.col("q_vec")), 2).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "vec_id").limit(3)


_L2 = "round(sqrt(list_sum(list_transform(list_zip(q_vec, embedding), lambda p: (p[1]::double - p[2]::double) ** 2))), 6)"


@query(f"""
with q as (select embedding q_vec from embeddings where vec_id = 5), d as (select vec_id, label, {_L2} distance from embeddings, q where vec_id <> 5),
a as (select vec_id, distance, 0 source_rank from d where label < 3 order by distance, vec_id limit 15), b as (select vec_id, distance, 1 source_rank from d where label < 6 order by distance, vec_id limit 20)
select vec_id, min(distance) distance, min(source_rank)::int source_rank from (select * from a union all select * from b) group by 1
""")
def additive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, 5)
    order = [F.asc("distance"), F.asc("vec_id")]
    parts = [near.filter("label < 3").orderBy(*order).limit(15), near.filter("label < 6").orderBy(*order).limit(20)]
    return match.first_wins([p.select("vec_id", "distance") for p in parts], ["vec_id"], order)


def _near(spark: SparkSession, sf_dir: str, of: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.filter(F.col("vec_id") == of).select(F.col("embedding").alias("q_vec")).limit(1))  # one row
    return e.filter(F.col("vec_id") != of).join(q, F.lit(True)).select("vec_id", "label", F.round(values.l2(F.col("embedding"), F.col("q_vec")), 6).alias("distance"))


@query("""
with a as (select o_custkey, o_orderkey from orders where o_orderstatus = 'F'), b as (select o_custkey, o_orderkey from orders where o_orderstatus = 'O'),
n as (select o_custkey from a group by 1 having count(*) >= 2) select * from a union all select * from b where o_custkey not in (select o_custkey from n)
""")
def conditional_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return match.otherwise_second(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'O'").drop("o_orderstatus"), "o_custkey", 2)


@query("""
with s as (select o_custkey, max(o_orderkey) hit from orders where o_orderstatus = 'P' group by 1), m as (select label, min(vec_id) hit from embeddings group by 1)
select c_custkey, coalesce(s.hit, m.hit) hit, case when s.hit is not null then 'structured' when m.hit is not null then 'semantic' end via
from customer left join s on o_custkey = c_custkey left join m on label = c_nationkey
""")
def structured_or_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("s"))
    m = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("c_nationkey")).agg(F.min("vec_id").alias("m"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(s, "c_custkey", "left").join(match.small(m), "c_nationkey", "left")
    return c.select("c_custkey", F.coalesce("s", "m").alias("hit"), F.when(F.col("s").isNotNull(), "structured").when(F.col("m").isNotNull(), "semantic").alias("via"))


@query("""
select page_id, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) link from pages
""")
def seed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a[^>]+href="([^"]*)"'), F.lit(1))).alias("link"))


@query("""
with h as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) host from pages)
select page_id, host, case when host = 'example.net' or ends_with(host, '.example.net') then 'blocked' when host in ('www.example.com') or ends_with(host, '.example.org') then 'allowed' else 'unknown' end verdict from h
""")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1))
    h = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    under = lambda d: (F.col("host") == d) | F.col("host").endswith("." + d)
    state = curate.partition_rows([(under("example.net"), "blocked"), ((F.col("host") == "www.example.com") | F.col("host").endswith(".example.org"), "allowed")], "unknown")
    return h.withColumn("verdict", state)


@query("""
select page_id, case when contains(lower(url), '/de/') then 'german' when contains(lower(url), '/fr/') then 'french' when contains(lower(url), '.html') or contains(lower(url), '.htm') then 'document' else 'other' end kind from pages
""")
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = parsing.first_keyword(F.col("url"), {"german": ("/de/",), "french": ("/fr/",), "document": (".html", ".htm")}, "other")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


@query(r"""
select conv_id, turn, coalesce(regexp_matches(text, '(?i)\blet me know if\b') or regexp_matches(text, '(?i)\bif you (?:need|want|have)\b.{0,20}\b(?:clarification|examples|help)\b')
 or regexp_matches(text, '(?i)\bdo you (?:have|need) any questions\b') or regexp_matches(text, '(?i)\bI hope this helps\b') or regexp_matches(text, '(?i)\bI''m happy to\b')
 or (regexp_matches(text, '(?i)\bfeel free to ask\b') and not regexp_matches(text, '(?i)\bfeel free to ask\b\s+(?:the|your|a|an|our|their|his|her|each)\b')), false) chat_voice from conversations
""")
def chat_voice_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(text.chat_voice(F.col("text")), F.lit(False)).alias("chat_voice"))


@query(r"""
with w as (select doc_id, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n from documents)
select doc_id, case when text is null then 'missing' when n < 20 then 'too short' when n > 2000 then 'too long' when contains(text, '%%%') then 'garbled' end reason from w
""")
def quality_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", text.word_count(F.col("text")).alias("n"))
    rules = [(F.col("text").isNull(), "missing"), (F.col("n") < 20, "too short"), (F.col("n") > 2000, "too long"), (F.col("text").contains("%%%"), "garbled")]
    return d.select("doc_id", curate.first_failing(rules).alias("reason"))


@query("""
select event_id, case when json_array_length('[' || props || ']') = 1 then json_extract_string('[' || props || ']', '$[0].k') end word, json_extract_string(props, '$.k')::int k from events
""")
def json_first_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.concat(F.lit("["), "props", F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.json_array_length(j) == 1, F.get_json_object(j, "$[0].k")).alias("word"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select event_id, coalesce(try_cast(json_extract_string(case when json_valid(props) then props end, '$.missing') as int), 15) missing, coalesce(json_extract(props, '$.k')::int, 0) k from events")
def json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "struct<k:int,missing:int>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(p["missing"], F.lit(15)).alias("missing"), F.coalesce(p["k"], F.lit(0)).alias("k"))


@query("""
select c_custkey as key, c_acctbal as value from customer where c_acctbal >= 0 union all
(select o_custkey, o_totalprice from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0) qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1)
""")
def upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    return curate.insert_ignore(old, new, ["key"], ["o_orderdate", "o_orderkey"])


@query("""
with n as (select o_custkey as key, o_totalprice as value from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select * from n union all select c_custkey, c_acctbal from customer where c_custkey not in (select key from n)
""")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    return curate.insert_replace(old, new, ["key"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""
with n as (select o_custkey as key, max(o_totalprice) as value from orders group by 1)
select coalesce(c_custkey, key) as key, coalesce(value, c_acctbal) as value from customer full join n on key = c_custkey
""")
def merge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("value"))
    return curate.merge_state(old, new, ["key"], ["value"])


@query("""
select o_orderkey, o_orderstatus from orders where not (o_orderpriority = '1-URGENT' and o_orderstatus <> 'F') union all select l_orderkey, min(l_linestatus) from lineitem group by 1
""")
def relock(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("o_orderstatus")).withColumn("o_orderpriority", F.lit(""))
    return curate.relock(old, new, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("""
select l_orderkey, l_linenumber, case when l_quantity >= 49 then 'artifact' when l_discount = 0 then 'excluded' when l_tax = 0 then 'manual' else 'eligible' end state from lineitem
""")
def row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = curate.partition_rows([(F.col("l_quantity") >= 49, "artifact"), (F.col("l_discount") == 0, "excluded"), (F.col("l_tax") == 0, "manual")], "eligible")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"))


@query("""
select 'orphan' gate, count(*) n from lineitem where l_partkey not in (select p_partkey from part where p_size <> 13)
union all select 'no date', count(*) from lineitem where l_shipdate is null
union all select 'collision', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
""")
def lock_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syllabrook.schemas import duplicates, orphans

    li = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").filter("p_size <> 13")
    checks = {"orphan": orphans(li.select("l_partkey"), "l_partkey", parts, "p_partkey"), "no date": li.filter("l_shipdate is null").select("l_orderkey"), "collision": duplicates(li, ("l_orderkey", "l_linenumber"))}
    out = [d.agg(F.lit(n).alias("gate"), F.count("*").alias("n")) for n, d in checks.items()]
    return out[0].union(out[1]).union(out[2])


@query("select l_orderkey, l_partkey, count(*) n, array_to_string(list(l_linenumber order by l_linenumber), ',') lines from lineitem group by all having count(*) > 1")
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("l_linenumber")).alias("l")).filter("n > 1")
    return g.select("l_orderkey", "l_partkey", "n", F.array_join(F.col("l").cast("array<string>"), ",").alias("lines"))


@query("""
with m as (select l_orderkey, max(l_linenumber) m from lineitem group by 1), r as (select l_orderkey, unnest(range(1, m + 1))::int missing from m)
select r.* from r anti join (select l_orderkey, l_linenumber missing from lineitem) using (l_orderkey, missing)
""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.missing_numbers(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) > 30")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return curate.retain(e, [F.desc("ts"), F.desc("event_id")], 30, ["user_id"]).select("user_id", "event_id")


@query("""
with e as (select user_id, list({'id': event_type, 'confidence': value} order by event_id) o, max(value) conf from events group by 1)
select user_id, case when len(o) = 0 then 'error' when conf >= 85 and len(list_filter(o, lambda x: x.confidence >= 85)) = 1 then 'added' else 'review' end route from e
""")
def upload_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("id"), F.col("value").alias("confidence"))).alias("o"), F.max("value").alias("c"))
    return e.select("user_id", curate.route(F.col("c"), F.col("o")).alias("route"))


@query("""
select sha256(concat_ws('|', o_orderkey, o_custkey))[1:12] short, o_orderkey, 'order-' || sha1(concat_ws('|', o_orderkey, o_orderstatus))[1:10] doc_id from orders
""")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.substring(F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey"), 256), 1, 12).alias("short"), "o_orderkey", values.short_id("order", F.col("o_orderkey"), F.col("o_orderstatus"), n=10, kind="sha1").alias("doc_id"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents where text is not null)
select doc_id, count(*) n_lines, max(length(line)) longest, count(distinct line) different from l group by 1
""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines.lines(table(spark, sf_dir, "documents").filter("text is not null"), ["doc_id"], "text")
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"), F.count_distinct("line").alias("different"))


@query(f"""
with o as (select item_id, text, item_id % 7 topic, left(text, 60) title from benchmark), c as (select doc_id, text, doc_id % 7 topic from documents),
a as (select doc_id, topic, unnest({TOKENS.format(c='text')}) token from c), b1 as (select item_id, unnest({TOKENS.format(c="substr(text, 61)")}) token from o), b2 as (select item_id, topic, unnest({TOKENS.format(c="concat_ws(' ', substr(text, 61), title)")}) token from o),
s as (select doc_id, item_id, count(*) score, 1 tier from a join b1 using (token) group by all union all select doc_id, item_id, count(*), 2 from a join b2 using (token) group by 1, 2
  union all select doc_id, item_id, count(*), 0 from a join b2 using (token) where a.topic = b2.topic group by 1, 2)
select doc_id, item_id::varchar target, score, tier from s where score >= 5 qualify row_number() over (partition by doc_id order by tier, score desc, item_id::varchar) = 1
""")
def preferred_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives of a document's own topic first, then statements, then statements with their title."""
    o = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("objective_id"), F.substring("text", 61, 1_000_000).alias("content_stmt"), F.substring("text", 1, 60).alias("title"), F.pmod("item_id", F.lit(7)).alias("topic"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(7)).alias("topic"))
    return lookup.best_objective(d, "doc_id", "text", o, "topic", least=5)


@query(f"""
with o as (select item_id, text from benchmark), w as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) t from documents where lang = 'fr'),
c as (select doc_id, i::int chunk_seq, trim(substr(t, (i * 400 + 1)::int, 500), ' ' || chr(9) || chr(10) || chr(13)) body from w, range(400) r(i) where i = 0 or i * 400 < length(t) - 100),
a as (select doc_id, chunk_seq, unnest({TOKENS.format(c='body')}) token from c where body <> ''), b as (select item_id, unnest({TOKENS.format(c='text')}) token from o),
s as (select doc_id, chunk_seq, item_id::varchar item_id, count(*) n from a join b using (token) group by doc_id, chunk_seq, b.item_id having count(*) >= 2 qualify row_number() over (partition by doc_id, chunk_seq order by n desc, item_id::varchar) = 1)
select doc_id::varchar source_file, c.chunk_seq, coalesce(item_id, 'REVIEW') objective_id, case when item_id is null then 'review' else 'medium' end confidence, case when item_id is null then 'no_objective_match_via_keywords' end review_reason
from c left join s using (doc_id, chunk_seq) where body <> ''
""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of French documents bound to English statements, most of them for review."""
    d = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("page"), text.strip(F.col("text")).alias("body"))
    o = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("objective_id"), F.col("text").alias("content_stmt"), F.lit(None).cast("string").alias("title"))
    r = records.page_records(d, o, "generic_pdf", F.lit("notes"))
    return r.select("source_file", "chunk_seq", "objective_id", "confidence", "review_reason")


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pack_paragraphs(F.regexp_replace("text", "\n", "\n\n"))).alias("position", "chunk"))


@query()
def nfkc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.nfkc_in_python(F.col("text")), 256).alias("folded"))


@query()
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalise(F.col("text")), 256).alias("normalised"))
