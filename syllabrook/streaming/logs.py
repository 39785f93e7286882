"""Streams into tables that persist, each batch exactly once: event logs, state by key, and jobs that run in the background.

A batch and its number become visible with one commit of the store. A stream that is started again repeats the batch that it had
not noted as done; if the store has that number already, the batch is read and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from syllabrook.sources.store import Change, Conflict, Store

#: States of a job (fixed values).
DONE, FAILED = "done", "failed"
JOBS = "job_id STRING, payload STRING, status STRING, detail STRING, batch BIGINT"

Write = Callable[[Change, DataFrame, int], None]


def once(store: Store, stream: str, write: Write) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: ``write`` with a change that commits the batch's number, too; again where another change was first."""

    def run(batch: DataFrame, number: int) -> None:
        while True:
            change = store.begin()
            if not change.batch(stream, number):
                batch.write.format("noop").mode("overwrite").save()  # what operators of the stream remember has to follow
                return
            write(change, batch, number)
            try:
                change.commit(f"{stream} {number}")
                return
            except Conflict:
                continue

    return run


def appended(name: str) -> Write:
    """Rows of a batch at the end of a log, with the batch's number if the log has a column for it."""
    return lambda change, batch, number: change.append(name, batch.withColumn("batch", F.lit(number).cast("long")))


def merged(name: str, order: list[Column], matched: dict[str, Column]) -> Write:
    """Rows of a batch merged into a table by its key."""
    return lambda change, batch, number: change.merge(name, batch, order, matched)


def distinct_events(events: DataFrame, event_id: str, ts: str, delay: str) -> DataFrame:
    """Events once by their id; a repetition is known as one for ``delay`` after the event, and the state is kept no longer."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])


def started(rows: DataFrame, store: Store, stream: str, write: Write, checkpoint: str) -> StreamingQuery:
    """Runs all that there is to read now, and ends."""
    q = rows.writeStream.outputMode("append" if not _has_state(rows) else "update").option("checkpointLocation", checkpoint)
    return q.foreachBatch(once(store, stream, write)).trigger(availableNow=True).start()


def _has_state(rows: DataFrame) -> bool:
    return "FlatMapGroupsInPandasWithState" in rows._jdf.queryExecution().logical().toString()


def event_log(events: DataFrame, store: Store, name: str, checkpoint: str, event_id: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> StreamingQuery:
    """Appends events to the log ``name``, which the store has to have, each event and each batch once."""
    return started(distinct_events(events, event_id, ts, delay), store, name, appended(name), checkpoint)


def outcomes(work: Callable[[Column], Column], payload: str = "payload") -> Callable[[DataFrame], DataFrame]:
    """Jobs with the status and detail that ``work`` gives for their payload, a struct (result, error): an error fails its job only."""

    def run(jobs: DataFrame) -> DataFrame:
        w = jobs.withColumn("__w", work(F.col(payload)))
        failed = F.col("__w.error").isNotNull()
        return w.withColumns({"status": F.when(failed, FAILED).otherwise(DONE), "detail": F.when(failed, F.col("__w.error")).otherwise(F.col("__w.result").cast("string"))}).drop("__w")

    return run


def jobs(requests: DataFrame, store: Store, name: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Does the jobs of a stream of requests (job_id, payload) and keeps their outcome in the table ``name`` (of schema JOBS, key job_id).

    A job is done once, however often it is asked for: requests of a job that the table has are left out, and of one that comes twice
    in a batch the first payload counts. Jobs that were lost with their batch are done again when the stream is started again.
    """

    def write(change: Change, batch: DataFrame, number: int) -> None:
        known = change.read(name).select("job_id")
        asked = batch.groupBy("job_id").agg(F.min("payload").alias("payload")).join(known, "job_id", "left_anti")
        change.insert(name, work(asked).withColumn("batch", F.lit(number).cast("long")), [F.asc("job_id")])

    return started(requests, store, name, write, checkpoint)


def make_jobs(store: Store, name: str, buckets: int = 16) -> None:
    change = store.begin()
    if change.create(name, JOBS, ("job_id",), buckets):
        change.commit(f"table {name}")
