"""The study state as a stream: the twin of the batch form in operators.schedule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from syllabrook.functions.values import BOXES, PASS
from syllabrook.plans.registry import query
from syllabrook.session import table

STATE = "box int, events long, updated_at timestamp"
OUT = "key long, box int, next_review date, updated_at timestamp"


def next_box(box: int | None, score: float) -> int:
    """1 for the first event and after a fail, else one more, 5 at most."""
    return 1 if box is None or score < PASS else min(box + 1, 5)


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds the new events of one key, in order of time, into its state."""
    box, n, at = state.get if state.exists else (None, 0, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ts, value in zip(rows["ts"], rows["value"], strict=True):
        box, n, at = next_box(box, value), n + 1, ts
    state.update((box, n, at))
    day = at.date()
    due = day if n == 1 else day + dt.timedelta(days=BOXES[box - 1])
    yield pd.DataFrame({"key": [key[0]], "box": [box], "next_review": [due], "updated_at": [at]})


def leitner_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The state after each micro-batch of every key that it touches (update mode). ``events``: key, event_id, ts, value."""
    e = events.select(F.col(key).cast("long").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.groupBy("key").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


MASTERY, MET = "met int, day date", "key long, met_count int, status string, updated_at timestamp"
STATUS = ("unmet", "met_once", "mastered")


def meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds new events of one key: a pass on another day counts once more, two at most; a fail starts again."""
    met, day = state.get if state.exists else (0, None)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for ts, value in zip(rows["ts"], rows["value"], strict=True):
        if value < PASS:
            met, day = 0, None
        elif day != ts.date():
            met, day = min(met + 1, 2), ts.date()
    state.update((met, day))
    yield pd.DataFrame({"key": [key[0]], "met_count": [met], "status": [STATUS[met]], "updated_at": [rows["ts"].iat[-1]]})


def mastery_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The mastery after each micro-batch of every key that it touches (update mode); the twin of ``schedule.mastery``."""
    e = events.select(F.col(key).cast("long").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return e.groupBy("key").applyInPandasWithState(meet, MET, MASTERY, "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, folder: str, sink: str, checkpoint: str, schema: str, files_at_a_time: int = 1, state: Callable[[DataFrame], DataFrame] = leitner_stream) -> None:
    """Runs all files of a folder through the stream, a few at a time, into a Parquet sink of updates with their batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)
    q = state(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def current(updates: DataFrame) -> DataFrame:
    """The last state of each key."""
    columns = [c for c in updates.columns if c not in ("key", "batch")]
    return updates.groupBy("key").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("key", "s.*")


@query("""
select user_id, window_start, n, passes from (select user_id, time_bucket(interval '1 day', ts) window_start, count(*) n, count(*) filter (value >= 70) passes from events group by all)
""")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days with a watermark when read as a stream (an extension; the reference has no windows)."""
    return daily(table(spark, sf_dir, "events"))


def daily(events: DataFrame) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", "1 day")
    g = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= PASS).alias("passes"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "passes")
