"""What the two vector searches share: valid vectors, and groups of equal ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.llm.common import add_row_id, stored


def valid(v: Column) -> Column:
    """Not null, not empty, all components finite numbers."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def by_size(rows: DataFrame, v: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of a search among the vectors of each number of components that some query (``q``) has."""
    sizes = sorted(r["n"] for r in rows.filter("q").select(F.size(v).alias("n")).distinct().collect())
    found = [search(rows.filter(F.size(v) == n)) for n in sizes] or [search(rows.limit(0))]
    return reduce(DataFrame.unionByName, found)


def groups(df: DataFrame, id_col: str, v: str, most: int) -> DataFrame:
    """(v, ids, rep): distinct vectors with the ``most`` smallest ids of the rows of each (repeated ids repeat), and the smallest of them.

    No more can reach a result. The rank limit is applied before the shuffle, so that a vector which a
    third of all rows share costs ``most`` rows a task.
    """
    rank = F.row_number().over(W.partitionBy(v).orderBy(id_col))
    few = df.select(id_col, v).withColumn("__n", rank).filter(F.col("__n") <= most)
    return few.groupBy(v).agg(F.sort_array(F.collect_list(id_col)).alias("ids")).withColumn("rep", F.col("ids")[0])


def query_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, v) of the rows for which ``q`` holds, and (q, v): a key for each distinct vector of them."""
    queries = rows.filter("q").select(F.col("id").alias("query_id"), "v")
    return queries, stored(add_row_id(queries.select("v").distinct(), "q"))


def expand(found: DataFrame, queries: DataFrame, v: str, k: int, best_first: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) of (v, id, score, same), the nearest of each distinct query vector (or its key v).

    ``queries`` holds (query_id, v), a row for each query. A query's own row is no candidate: one entry of its id among those
    whose vector is the query's (``same``) is left out, all others stay, whatever ids repeat. ``found`` has up to k + 1 rows a
    vector, so a list of them is bounded, and queries that share a vector share that list.
    """
    lists = found.groupBy(v).agg(F.sort_array(F.collect_list(F.struct(best_first.alias("o"), F.col("id").alias("vec_id"), "score", "same"))).alias("near"))
    rows = queries.join(lists, v).withColumn("own", F.array_position(F.transform("near", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True))
    rows = rows.withColumn("near", F.slice(F.filter("near", lambda x, i: i + 1 != F.col("own")), 1, k))
    rows = rows.select("query_id", F.posexplode("near").alias("pos", "x"))
    return rows.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")
