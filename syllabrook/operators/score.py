"""Scoring of judged points against a scheme, and the gates before and after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.functions.values import percent

#: Wording that contradicts a point not awarded, and words that explain (fixed values).
POSITIVE = (
    "student gave", "student mentioned", "student described",
    "student provided", "student said", "student stated",
    "student explained", "student identified",
    "answer contains", "answer mentions", "answer includes",
    "answer describes", "answer states", "answer explains",
    "present in the answer", "covered in the answer",
    "addressed in the answer",
)
CONNECTORS = ("because", "so", "which means", "therefore", "this causes", "as a result", "since", "thus")
NO_EVIDENCE = "No relevant content found in answer."


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def weight(c: Column) -> Column:
    """A missing or zero weight counts as 1."""
    return F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(1)).otherwise(c)


def weighted(points: DataFrame, key: str | list[str], value: str = "marks_value", awarded: str = "awarded", point: str = "mark_point_id") -> DataFrame:
    """(key, awarded_marks, total_marks, score_pct, missed) of judged points joined to their scheme."""
    w, keys = weight(F.col(value)), [key] if isinstance(key, str) else key
    out = points.groupBy(*keys).agg(
        F.sum(F.when(F.col(awarded), w).otherwise(0)).alias("awarded_marks"),
        F.sum(w).alias("total_marks"),
        F.sort_array(F.collect_list(F.when(~F.col(awarded), F.col(point)))).alias("missed"),
    )
    return out.withColumn("score_pct", percent(F.col("awarded_marks"), F.col("total_marks")))


def keep_first(rows: DataFrame, group: str, order: list[Column], own: Column) -> DataFrame:
    """One row for each group, the first; a null group is a group of its own row."""
    key = F.struct(F.col(group), F.when(F.col(group).isNull(), own))
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def reconcile(points: DataFrame) -> DataFrame:
    """Points whose evidence says that they were met are awarded; missing evidence is filled in."""
    e = F.coalesce("evidence", F.lit(""))
    flip = ~F.col("awarded") & contains_any(F.lower(e), POSITIVE)
    text = F.when(flip, F.concat(F.lit("[auto-corrected] "), e)).when(~F.col("awarded") & (F.trim(e) == ""), F.lit(NO_EVIDENCE)).otherwise(F.col("evidence"))
    return points.withColumns({"evidence": text, "awarded": F.col("awarded") | flip})


def evidence_gates(points: DataFrame) -> DataFrame:
    """Adds ``flagged``; awards with evidence below 20 letters are withdrawn."""
    e = F.trim(F.coalesce("evidence", F.lit("")))
    thin = F.col("awarded") & (F.length(e) < 20)
    echo = F.col("answer").contains(e) & ~contains_any(F.lower(e), CONNECTORS)
    absent = ~F.col("answer").contains(e)
    return points.withColumns({
        "flagged": F.coalesce(F.col("awarded") & ~thin & (echo | absent), F.lit(False)),
        "evidence": F.when(thin, F.concat(F.coalesce("evidence", F.lit("")), F.lit(" [auto-downgraded: evidence too thin]"))).otherwise(F.col("evidence")),
        "awarded": F.col("awarded") & ~thin,
    })


def confidence(points: DataFrame, key: str, overall: str, default: int = 50) -> DataFrame:
    """(key, confidence): the lowest of the points, else the overall one, else the default."""
    return points.groupBy(key).agg(F.coalesce(F.min("confidence"), F.min(overall), F.lit(default)).alias("confidence"))


def any_awarded(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.bool_or("awarded").alias("awarded"))


def source_floor(notes: Column, schemes: Column, papers: Column) -> Column:
    """Confidence that the sources of a lesson allow."""
    base = F.when(notes >= 3, 90).when(notes == 2, 70).when(notes == 1, 50).otherwise(30)
    return F.greatest(base - F.when((notes == 0) & (papers == 0) & (schemes > 0), 20).otherwise(0), F.lit(30))


def provenance(points: DataFrame, key: str, rank: str, blocked_from: int, queued: DataFrame, objective: str) -> DataFrame:
    """(key, rank): the best source rank; 5 if a weak point's objective waits for review."""
    q = points.join(queued.select(objective).distinct().withColumn("__queued", F.lit(True)), objective, "left")
    blocked = F.coalesce(F.bool_or(F.col("__queued") & (F.col(rank) >= blocked_from)), F.lit(False))
    return q.groupBy(key).agg(F.when(blocked, F.lit(5)).otherwise(F.min(rank)).alias("rank"))
