"""Queries whose rows go through streams into tables that persist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.functions.values import PASS
from syllabrook.plans.registry import query
from syllabrook.session import shared_folder, table
from syllabrook.sources.store import Store
from syllabrook.streaming import logs


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern as path lets the table be one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("maxFileAge", "36500d").parquet(f"{sf_dir}/{name}.parque[t]")


@query("select user_id, count(distinct event_id) n, count(distinct event_id) filter (value >= 70) passes, 2::bigint runs from events group by 1")
def logged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all events, each once, after two runs of the stream that writes it."""
    root = shared_folder(spark)
    store = Store(spark, f"{root}/store")
    change = store.begin()
    change.create("log", "event_id long, user_id long, ts timestamp, value double, batch long")
    change.commit()
    for _ in range(2):
        events = source(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
        logs.event_log(events, store, "log", f"{root}/checkpoint").awaitTermination()
    g = store.read("log").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= PASS).alias("passes"))
    return g.withColumn("runs", F.lit(2).cast("long"))


def counted_words(payload: Column) -> Column:
    """The number of words of a text, or why it has none."""
    words = F.regexp_count(payload, F.lit(r"[^\x20\x09-\x0D]+"))
    short = F.coalesce(words, F.lit(0)) < 5
    return F.struct(F.when(~short, words).alias("result"), F.when(short, F.concat(F.lit("too short: "), F.coalesce(words, F.lit(0)))).alias("error"))


@query(r"""
with w as (select conv_id || '-' || turn job_id, len(regexp_extract_all(coalesce(min(text), ''), '[^\x20\x09-\x0D]+')) n from conversations group by 1)
select job_id, case when n < 5 then 'failed' else 'done' end status, case when n < 5 then 'too short: ' || n else n || '' end detail from w
""")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each turn of a conversation, done as requests come in; a job that fails says why."""
    root = shared_folder(spark)
    store = Store(spark, f"{root}/store")
    logs.make_jobs(store, "jobs")
    requests = source(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("job_id"), F.col("text").alias("payload"))
    logs.jobs(requests, store, "jobs", logs.outcomes(counted_words), f"{root}/checkpoint").awaitTermination()
    return store.read("jobs").select("job_id", "status", "detail")
