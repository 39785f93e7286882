"""Matching and retrieval: token overlap, Jaccard, and nearest neighbours among given vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.functions.text import tokens
from syllabrook.functions.values import cosine, l2

#: Rows of the smaller side up to which it is sent to every task; beyond it both sides are shuffled by token.
SMALL, SMALL_BYTES = 200_000, 64 << 20
#: Queries that meet all rows at a time.
BLOCK = 10_000


def small(df: DataFrame, most: int = SMALL, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """Marked for broadcasting only if its rows and their bytes are proven to be few."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, b = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= most and b <= most_bytes else df


def overlaps(texts: DataFrame, key: str, text: str, targets: DataFrame, target_key: str, target_text: str) -> DataFrame:
    """(key, target_key, score): distinct content words that a text and a target share, where any."""
    a = texts.select(key, F.explode(tokens(F.col(text))).alias("token"))
    b = targets.select(target_key, F.explode(tokens(F.col(target_text))).alias("token"))
    return a.join(small(b), "token").groupBy(key, target_key).agg(F.count("*").alias("score"))


def best(scores: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return scores.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def bind(texts: DataFrame, key: str, text: str, targets: DataFrame, target_key: str, target_text: str, least: int = 2) -> DataFrame:
    """(key, target_key, score): the target with the largest overlap of at least ``least``; ties: the smaller key. Texts without one are left out."""
    s = overlaps(texts, key, text, targets, target_key, target_text).filter(F.col("score") >= least)
    return best(s, key, [F.desc("score"), F.asc(target_key)])


def bind_tiers(texts: DataFrame, key: str, text: str, tiers: list[tuple[DataFrame, str, str]], least: int = 2) -> DataFrame:
    """``bind`` tier by tier: a later tier only sees texts that no earlier one has bound."""
    found = None
    for rank, (targets, target_key, target_text) in enumerate(tiers):
        b = bind(texts, key, text, targets, target_key, target_text, least).select(key, F.col(target_key).alias("target"), "score", F.lit(rank).alias("tier"))
        found = b if found is None else found.unionByName(b)
    return best(found, key, [F.asc("tier")])


def jaccard(texts: DataFrame, key: str, text: str, targets: DataFrame, target_key: str, target_text: str, least: float = 0.5) -> DataFrame:
    """(key, target_key, jaccard): the target with the largest Jaccard index of words, from ``least``; ties: the smaller key."""
    na = texts.select(key, F.size(tokens(F.col(text))).alias("na"))
    nb = targets.select(target_key, F.size(tokens(F.col(target_text))).alias("nb"))
    s = overlaps(texts, key, text, targets, target_key, target_text).join(na, key).join(small(nb), target_key)
    s = s.withColumn("jaccard", F.col("score") / (F.col("na") + F.col("nb") - F.col("score"))).filter(F.col("jaccard") >= least)
    return best(s, key, [F.desc("jaccard"), F.asc(target_key)]).select(key, target_key, "jaccard")


def nearest(queries: DataFrame, rows: DataFrame, k: int, on: Column | None = None, measure: str = "l2") -> DataFrame:
    """Each query (q_id, q_vec) with its k nearest of (id, vec), by distance and id.

    Queries are a stated set that meets all rows (or those that ``on`` allows) in blocks of ``BLOCK``; only the k best of
    a task leave it.
    """
    distance = l2(F.col("q_vec"), F.col("vec")) if measure == "l2" else -cosine(F.col("q_vec"), F.col("vec"))
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = [queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]
    pairs = reduce(DataFrame.unionByName, [rows.join(F.broadcast(q), on if on is not None else F.lit(True)) for q in parts])
    pairs = pairs.withColumn("distance", F.round(distance, 6))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)


def first_wins(parts: list[DataFrame], key: list[str], order: list[Column], most: int | None = None, within: list[str] | None = None) -> DataFrame:
    """Union of lists in order of priority: a key that an earlier list has is not taken from a later one."""
    out = None
    for rank, p in enumerate(parts):
        p = p.withColumn("source_rank", F.lit(rank))
        out = p if out is None else out.unionByName(p)
    out = out.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy("source_rank", *order))).filter("__n = 1").drop("__n")
    if most:
        out = out.withColumn("__n", F.row_number().over(W.partitionBy(*(within or [])).orderBy("source_rank", *order))).filter(F.col("__n") <= most).drop("__n")
    return out


def otherwise_second(first: DataFrame, second: DataFrame, key: str, least: int) -> DataFrame:
    """All of ``first``, and of ``second`` the keys for which ``first`` has fewer than ``least`` rows."""
    enough = first.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(key)
    return first.unionByName(second.join(enough, key, "left_anti"))
