"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import stored


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def components(links: DataFrame) -> DataFrame:
    """(u, v): every linked node with the smallest node of its component; the smallest itself is left out.

    ``links`` has columns u and v. Every step replaces links so that nodes hang on smaller ones, and halves
    the depth of what is left; no step gathers the neighbours of a node in one place (their minimum is
    aggregated before the shuffle, and the join that hands it out splits skewed keys).
    """
    e = links.filter("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e
