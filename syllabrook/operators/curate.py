"""Deduplication, skipping, routing, upserts and gates of the ingest side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.functions.text import comma_append



def first_seen(df: DataFrame, key: str, order: list[str], what: str) -> DataFrame:
    """Adds ``original``: ``what`` of the first row with the same key, and ``is_duplicate``; the order has to be total.

    The first of each key is found before rows are shuffled, and a join splits keys that many rows share; a window would
    sort all of them in one task.
    """
    first = df.groupBy(key).agg(F.min_by(what, F.struct(*order)).alias("original"), F.min(F.struct(*order)).alias("__first"))
    out = df.withColumn("__k", F.col(key)).join(first.withColumnRenamed(key, "__key"), F.col("__k").eqNullSafe(F.col("__key")), "left")
    return out.withColumn("is_duplicate", F.struct(*order) != F.col("__first")).drop("__k", "__key", "__first")


def same_length(df: DataFrame, group: list[str], text: str, key: str, more_than: int) -> DataFrame:
    """Texts as long as one with a smaller key in their group, above a length: (key, length, first_key)."""
    n = F.length(text)
    rows = df.filter(n > more_than).select(*group, key, n.alias("length"))
    first = rows.groupBy(*group, "length").agg(F.min(key).alias("first_key"))
    return rows.join(first, [*group, "length"]).filter(F.col("first_key") < F.col(key))


def twins(df: DataFrame, name: str, kept: str, dropped: str) -> DataFrame:
    """Rows named like another one but for the extension: those with ``dropped`` where one with ``kept`` exists."""
    stem = lambda ext: F.regexp_replace(F.lower(name), rf"\.{ext}$", "")
    have = df.filter(F.lower(name).endswith(f".{kept}")).select(stem(kept).alias("__stem")).distinct()
    return df.filter(F.lower(name).endswith(f".{dropped}")).withColumn("__stem", stem(dropped)).join(have, "__stem", "left_semi").drop("__stem")


def skip_cascade(rules: list[tuple[Column, str]], additive: int) -> Column:
    """A reason to skip: the first ``additive`` + 1 rules add up with commas, the others act only on rows without one."""
    reason = F.lit(None).cast("string")
    for k, (rule, name) in enumerate(rules):
        hit = F.coalesce(rule, F.lit(False))
        reason = F.when(hit, comma_append(reason, name)).otherwise(reason) if k <= additive else F.when(reason.isNull() & hit, F.lit(name)).otherwise(reason)
    return reason


def route(confidence: Column, objectives: Column, least: int = 85) -> Column:
    """Where an upload goes: added with one sure objective and a sure folder, else to review, or an error without any."""
    sure = F.size(F.filter(objectives, lambda x: x["confidence"] >= least))
    return F.when(F.size(objectives) == 0, "error").when((confidence >= least) & (sure == 1), "added").otherwise("review")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``old`` and of ``new`` the first row of each key that it lacks."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(*old.columns))


def insert_replace(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of ``new`` for each key replaces that of ``old``."""
    last = new.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.join(last.select(*key), key, "left_anti").unionByName(last.select(*old.columns))


def merge_state(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """On conflict the new values win where they are set."""
    n = new.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(n, key, "full_outer").select(*key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def fill(df: DataFrame, column: str, source: DataFrame, key: str, value: str) -> DataFrame:
    """A null ``column`` takes ``value`` of the source row with the same key (one at most)."""
    s = source.groupBy(key).agg(F.min(value).alias("__v"))
    return df.join(s, key, "left").withColumn(column, F.coalesce(column, "__v")).drop("__v")


def relock(old: DataFrame, new: DataFrame, scope: Column, guarded: Column) -> DataFrame:
    """Rows in scope that are not guarded are replaced by the new ones."""
    return old.filter(~F.coalesce(scope & ~guarded, F.lit(False))).unionByName(new.select(*old.columns))


def retain(df: DataFrame, newest: list[Column], keep: int = 30, within: list[str] | None = None) -> DataFrame:
    """What goes when only the newest ``keep`` stay."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*(within or [])).orderBy(*newest))).filter(F.col("__n") > keep).drop("__n")


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that a row breaks, or null."""
    return F.coalesce(*[F.when(F.coalesce(r, F.lit(False)), F.lit(m)) for r, m in rules], F.lit(None).cast("string"))


def missing_numbers(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing): numbers from 1 to the largest that do not occur."""
    s = df.groupBy(group).agg(F.max(number).alias("m"), F.collect_set(number).alias("s"))
    return s.select(group, F.explode(F.array_except(F.sequence(F.lit(1), F.col("m")), "s")).alias("missing"))


def partition_rows(states: list[tuple[Column, str]], default: str) -> Column:
    """One state for each row, in this precedence."""
    out = F.lit(default)
    for rule, name in reversed(states):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out
