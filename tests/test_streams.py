"""Streams into the store: lost and repeated batches, jobs, and walks that read each file once."""

import os
import shutil
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from support import DATA

from syllabrook.functions.values import PASS
from syllabrook.operators import schedule
from syllabrook.sources.store import Store
from syllabrook.streaming import logs, study, walk

EVENT = "event_id long, ts timestamp, user_id long, value double"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def write_events(spark, folder, parts):
    """Event ids by file; every event comes an hour after the one before."""
    for n, ids in enumerate(parts):
        rows = [(i, 3600 * i, i % 3, float(i)) for i in ids]
        df = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/new")
        made = next(p for p in os.listdir(f"{folder}/new") if p.startswith("part-"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/new/{made}", f"{folder}/in/{n}-{made}")
        os.utime(f"{folder}/in/{n}-{made}", (n + 1, n + 1))
        shutil.rmtree(f"{folder}/new")


def log_of(spark, tmp_path, store):
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(f"{tmp_path}/in")
    return logs.event_log(events, store, "log", f"{tmp_path}/checkpoint", delay="10 hours")


def test_a_log_that_is_started_again_is_that_of_the_batch(spark, store, tmp_path, monkeypatch):
    c = store.begin()
    c.create("log", EVENT + ", batch long")
    c.commit()
    write_events(spark, tmp_path, [[1, 2, 3], [3, 4, 2], [5, 6, 5]])
    # The store has the second batch, but the stream is stopped before it notes that.
    commit = logs.Change.commit
    calls = []

    def stopped(self, note=""):
        out = commit(self, note)
        calls.append(note)
        if len(calls) == 2:
            raise RuntimeError("the driver went away")
        return out

    monkeypatch.setattr(logs.Change, "commit", stopped)
    with pytest.raises(Exception, match="went away"):
        log_of(spark, tmp_path, store).awaitTermination()
    assert sorted(r["event_id"] for r in store.read("log").collect()) == [1, 2, 3, 4]
    log_of(spark, tmp_path, store).awaitTermination()
    write_events(spark, tmp_path, [[7], [7, 8, 6]])
    log_of(spark, tmp_path, store).awaitTermination()
    got = store.read("log").orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r["batch"] for r in got][:4] == [0, 0, 0, 1] and store.snapshot().streams["log"] >= 3


def test_a_batch_that_fails_half_way_is_written_once(spark, store, tmp_path):
    c = store.begin()
    c.create("log", "event_id long, batch long")
    c.commit()
    lost = []

    def write(change, batch, number):
        change.append("log", batch.withColumn("batch", F.lit(number).cast("long")))
        if not lost:
            lost.append(1)
            raise RuntimeError("lost after writing, before the commit")

    run = logs.once(store, "s", write)
    df = spark.range(5).withColumnRenamed("id", "event_id")
    with pytest.raises(RuntimeError, match="before the commit"):
        run(df, 0)
    assert store.read("log").count() == 0
    for number in (0, 0, 1, 0, 1):
        run(df, number)
    assert store.read("log").count() == 10


def test_jobs_are_done_once(spark, store, tmp_path):
    logs.make_jobs(store, "jobs", 2)
    logs.make_jobs(store, "jobs", 2)
    assert store.versions() == [1]
    folder = f"{tmp_path}/requests"
    ask = lambda rows: spark.createDataFrame(rows, "job_id string, payload string").coalesce(1).write.mode("append").parquet(folder)
    number = lambda p: F.struct(p.try_cast("int").alias("result"), F.when(p.try_cast("int").isNull(), F.concat(F.lit("no number: "), p)).alias("error"))
    go = lambda: logs.jobs(spark.readStream.schema("job_id string, payload string").parquet(folder), store, "jobs", logs.outcomes(number), f"{tmp_path}/checkpoint").awaitTermination()
    ask([("a", "1"), ("b", "x"), ("a", "1")])
    go()
    ask([("a", "99"), ("c", "3")])
    go()
    got = sorted((r["job_id"], r["status"], r["detail"], r["batch"]) for r in store.read("jobs").collect())
    assert got == [("a", "done", "1", 0), ("b", "failed", "no number: x", 0), ("c", "done", "3", 1)]


def test_mastery_as_a_stream_is_that_of_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("value").cast("double").alias("value"))
    third = F.ntile(3).over(W.orderBy("ts", "event_id"))
    for n in range(3):
        events.withColumn("n", third).filter(F.col("n") == n + 1).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by time
    study.replay(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", EVENT, state=study.mastery_stream)
    got = {r["key"]: (r["met_count"], r["status"]) for r in study.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = schedule.mastery(events, "user_id", "ts", "event_id", F.col("value") >= PASS)
    assert got == {r["user_id"]: (r["met_count"], r["status"]) for r in want.collect()}


def put(folder, name, body, at=None):
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body)
    if at:
        os.utime(path, (at, at))


def test_a_walk_reads_each_content_once(spark, store, tmp_path):
    kb, opened = f"{tmp_path}/kb", spark.sparkContext.accumulator(0)
    walk.make_registry(store, "records", "path string, body string", 4)
    count = F.udf(lambda c: (opened.add(1), bytes(c).decode())[1], "string").asNondeterministic()
    go = lambda: walk.walk(store, [kb], f"{tmp_path}/checkpoint", "*.txt", lambda f: f.select("path", count("content").alias("body")), "records")
    bodies = lambda: sorted(r["body"] for r in store.read("records").collect())
    name = lambda p: p.rsplit("/", 1)[1]
    put(kb, "a.txt", "one", 1000)
    put(kb, "sub/b.txt", "two", 2000)
    put(kb, "sub/copy.txt", "one", 3000)
    put(kb, "x.bin", "not this")
    go()
    assert bodies() == ["one", "two"] and opened.value == 2
    go()
    assert opened.value == 2 and store.read("kb_paths").count() == 3
    put(kb, "c.txt", "three", 500)  # older than all that was read
    shutil.copy2(f"{kb}/sub/b.txt", f"{kb}/renamed.txt")
    go()
    assert bodies() == ["one", "three", "two"] and opened.value == 3
    assert {(name(r["path"]), name(r["original"])) for r in walk.copies(store.read("kb_paths")).collect()} == {("copy.txt", "a.txt"), ("renamed.txt", "b.txt")}
    put(kb, "a.txt", "four", 9000)  # in place
    go()
    assert bodies() == ["four", "one", "three", "two"] and opened.value == 4
    assert walk.rewritten(store, [kb], "*.txt") == 0 and store.read("kb_contents").count() == 4


def test_a_walk_over_nothing(spark, store, tmp_path):
    os.makedirs(f"{tmp_path}/kb")
    walk.make_registry(store)
    walk.walk(store, [f"{tmp_path}/kb"], f"{tmp_path}/checkpoint")
    assert store.read("kb_paths").count() == 0
