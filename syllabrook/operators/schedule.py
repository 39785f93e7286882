"""Spaced repetition and mastery, told from the whole event log at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.functions.values import review_date


def leitner(events: DataFrame, key: str, at: str, tie: str, passed: Column) -> DataFrame:
    """(key, box, score row's time, next_review) after all events of each key.

    The first event puts a key in box 1, a pass moves it up to box 5 at most, a fail back to 1: an island of
    events starts with the first or a fail, and the box is the length of the last island.
    """
    order = W.partitionBy(key).orderBy(at, tie)
    e = events.withColumn("__pass", passed)
    e = e.withColumn("__start", (F.row_number().over(order) == 1) | ~F.col("__pass"))
    e = e.withColumn("__island", F.sum(F.col("__start").cast("int")).over(order))
    last = e.groupBy(key, "__island").agg(F.count("*").alias("n"), F.max(F.struct(at, tie)).alias("t"))
    last = last.groupBy(key).agg(F.max_by("n", "__island").alias("n"), F.max_by("t", "__island").alias("t"), F.sum("n").alias("events"))
    box = F.least(F.lit(5), F.col("n")).cast("int")
    day = F.to_date(F.col("t")[at])
    # A new key is due on the day of its only event.
    return last.select(key, box.alias("box"), F.when(F.col("events") == 1, day).otherwise(review_date(day, box)).alias("next_review"), F.col("t")[at].alias("updated_at"))


def mastery(events: DataFrame, key: str, at: str, tie: str, passed: Column) -> DataFrame:
    """(key, met_count, status): distinct days with a pass since the last fail, 2 at most."""
    order = W.partitionBy(key).orderBy(at, tie).rowsBetween(W.currentRow, W.unboundedFollowing)
    e = events.withColumn("__pass", passed).withColumn("__fails_later", F.sum((~F.col("__pass")).cast("int")).over(order))
    days = e.groupBy(key).agg(F.count_distinct(F.when(F.col("__pass") & (F.col("__fails_later") == 0), F.to_date(at))).alias("days"))
    met = F.least(F.lit(2), F.col("days")).cast("int")
    return days.select(key, met.alias("met_count"), F.element_at(F.array(F.lit("unmet"), F.lit("met_once"), F.lit("mastered")), met + 1).alias("status"))


def due(state: DataFrame, as_of: Column) -> DataFrame:
    return state.filter(F.col("next_review") <= as_of)


def next_batch(due_rows: DataFrame, new_rows: DataFrame, key: str, due_order: list[Column], new_order: list[Column], size: int = 5) -> DataFrame:
    """Due reviews first, then new objectives, each key once, ``size`` in all: (key, source, position)."""
    a = due_rows.orderBy(*due_order).limit(size).withColumn("__n", F.row_number().over(W.orderBy(*due_order))).select(key, F.lit("review").alias("source"), F.lit(0).alias("__p"), "__n")
    b = new_rows.join(due_rows.select(key), key, "left_anti").orderBy(*new_order).limit(size)
    b = b.withColumn("__n", F.row_number().over(W.orderBy(*new_order))).select(key, F.lit("new").alias("source"), F.lit(1).alias("__p"), "__n")
    both = a.unionByName(b).withColumn("position", F.row_number().over(W.orderBy("__p", "__n")))  # two lists of ``size`` rows
    return both.filter(F.col("position") <= size).select(key, "source", "position")
