"""Sinks: CSV and JSON files, append-only logs, the review queue, versioned backups and stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.operators.curate import insert_replace, retain


def csv_file(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV with a header, also without rows; for reports of bounded size (see their limits)."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)



def review_rows(rejected: DataFrame, columns: list[str], reason: Column) -> DataFrame:
    """(payload, reason): rejected records as JSON text; they go nowhere else."""
    return rejected.select(F.to_json(F.struct(*columns)).alias("payload"), reason.alias("reason"))


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one)."""
    r = df.withColumn("reason", reason)
    return r.filter("reason is null").drop("reason"), r.filter("reason is not null")


def version(df: DataFrame, root: str, stamp: str) -> str:
    """A dated copy; refuses to write over one."""
    path = f"{root.rstrip('/')}/{stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def expired(versions: DataFrame, keep: int = 30) -> DataFrame:
    """Of (path, modified), what goes when the newest ``keep`` stay."""
    return retain(versions, [F.desc("modified"), F.desc("path")], keep)


def upsert_vectors(old: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """(id, embedding): the last vector of each id."""
    return insert_replace(old, new, ["id"], [order])


def progress_rows(progress: DataFrame) -> DataFrame:
    """Progress with the status that a workbook colours."""
    s = F.when(F.col("last_score").isNull(), "not_started").when(F.col("last_score") >= 70, "strong").when(F.col("last_score") >= 40, "developing").otherwise("weak")
    return progress.withColumn("status", s)


def scheme_review_rows(rows: DataFrame) -> DataFrame:
    """Rows of a scheme with their state: artifact before manual, unmapped and unverified."""
    s = F.when(F.col("artifact"), "artifact").when(F.col("manual"), "manual").when(F.col("objective_id").isNull(), "unmapped").when(~F.col("verified"), "unverified").otherwise("ok")
    return rows.withColumn("state", s)


def review_sheet(rows: DataFrame) -> DataFrame:
    """Rows with empty columns for a reviewer's approval and notes."""
    return rows.withColumns({"approved": F.lit(""), "notes": F.lit("")})


def whole_page(html: Column) -> Column:
    """A stored page without code fences that ends as a page does."""
    return F.coalesce(~html.contains("```") & F.rtrim(F.lower(html), F.lit(" \n\t\r")).endswith("</html>"), F.lit(False))
