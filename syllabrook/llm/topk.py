"""Exact top-k search by inner product: ball-tree branch and bound in shards of the table.

Vectors are dealt to cells by their nearest of at most ``CELLS`` pivots; a cell is a ball around its pivot, and
is cut into shards of at most ``SHARD`` vectors by hash. Each shard builds one ball tree, and queries stream past
it. The inner product of a query with a vector in a ball is at most the one with the ball's centre plus the
radius times the query's length; nodes are visited in the order of that bound, and left out once it is below
the k-th best score known. That score is shared: a first wave searches one shard for each query, that of the cell
with the highest bound's centre, and the second sends each query with its k-th score only to shards of cells whose
bound reaches it.

Components become floor(256 * x), so scores are whole numbers and ties are exact; a node or a cell is only left
out if its bound is truly smaller, so vectors that tie with the k-th stay in.

Cases: vectors that are null, empty, or that hold null or non-finite components take no part; zero vectors do. A
query is compared with the vectors of its own size. Ties go to the smaller id. Fewer candidates than k give shorter
lists. Rows are candidates whatever their ids: a query does not find its own row, but other rows of its id. A row without
an id, which no result could name, takes no part. Scores are exact below 2**63. Pivots are at
most ``CELLS`` vectors, ``PIVOT_BYTES`` in all; without clusters few cells are left out, and a query goes to
nearly all shards, as an exact search has to.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.llm.common import give_back, small_batches, stored
from syllabrook.llm.vectors import by_size, expand, groups, query_vectors, valid

#: Vectors of a shard and of a leaf; pivots and their bytes at most.
SHARD, LEAF = 32768, 256
CELLS, PIVOT_BYTES = 1024, 8 << 20
NONE = -(1 << 62)


@dataclass
class Ball:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: tuple["Ball", "Ball"] | None = None


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> Ball:
    """Splits along the direction from the centre's farthest point to the point farthest from that."""

    def make(rows: np.ndarray) -> Ball:
        p = x[rows]
        centre = p.mean(axis=0)
        return Ball(centre, float(np.sqrt(((p - centre) ** 2).sum(axis=1).max())), rows)

    root = make(np.arange(len(x)))
    todo = [root]
    while todo:
        b = todo.pop()
        if len(b.rows) <= leaf or b.radius == 0:
            continue
        p = x[b.rows]
        far = p[((p - b.centre) ** 2).sum(axis=1).argmax()]
        other = p[((p - far) ** 2).sum(axis=1).argmax()]
        along = p @ (other - far)
        order = np.argsort(along, kind="stable")
        half = len(order) // 2
        b.children = (make(b.rows[order[:half]]), make(b.rows[order[half:]]))
        todo += b.children
    return root


def search(tree: Ball, x: np.ndarray, exact: np.ndarray, counts: np.ndarray, q: np.ndarray, q_exact: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shard that can be among the k best, with scores. counts: ids of each row; kth: what is known."""
    length = float(np.linalg.norm(q)) * (1 + 1e-9)
    bound_of = lambda b: float(slack(b.centre @ q, b.radius * length))
    todo, made = [(-bound_of(tree), 0, tree)], 0
    rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    while todo:
        bound, _, b = heapq.heappop(todo)
        if -bound < kth:
            break
        if b.children:
            for c in b.children:
                if (u := bound_of(c)) >= kth:
                    made += 1
                    heapq.heappush(todo, (-u, made, c))
            continue
        s = exact[b.rows] @ q_exact
        good = s >= kth
        if not good.any():
            continue
        rows, scores = np.concatenate((rows, b.rows[good])), np.concatenate((scores, s[good].astype(np.int64)))
        order = np.argsort(-scores, kind="stable")
        have = np.cumsum(counts[rows[order]])
        if len(have) and have[-1] >= k:
            kth = max(kth, int(scores[order[np.searchsorted(have, k)]]))
            good = scores >= kth
            rows, scores = rows[good], scores[good]
    return rows, scores


def slack(product: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """An upper bound of product + spread that rounding cannot fall below."""
    return product + spread + 1e-6 * (np.abs(product) + spread) + 1e-3


ROW = "shard int, query boolean, q long, kth long, v array<long>, ids array<long>"


def find(k: int) -> callable:
    """Streams rows of shards: the vectors of each first, then its queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, made = None, [], None
        for df in batches:
            at, asks = df["shard"].to_numpy(), df["query"].to_numpy(dtype=bool)
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(df)]
            for a, b in zip(cut, cut[1:]):
                part = df.iloc[a:b]
                if a == b:
                    continue
                if at[a] != shard:
                    shard, held, made = at[a], [], None
                if not asks[a]:
                    held.append((np.stack(part["v"].to_numpy()), part["ids"].tolist()))
                elif held:
                    made = made or _built(held)
                    yield _answers(made, part, k)
        give_back()

    return run


def _built(held: list[tuple]) -> tuple:
    exact = np.concatenate([v for v, _ in held])
    ids = [i for _, some in held for i in some]
    x = exact.astype(np.float64)
    return ball_tree(x), x, exact, np.array([len(i) for i in ids]), ids, np.abs(x).max(initial=0)


def _answers(made: tuple, by: pd.DataFrame, k: int) -> pd.DataFrame:
    tree, x, exact, counts, ids, largest = made
    qs, found, scores, same = [], [], [], []
    for q, v, kth in zip(by["q"], by["v"], by["kth"], strict=True):
        y = v.astype(np.float64)
        # Products and sums are exact in double precision below 2**52.
        near = largest * np.abs(y).max(initial=0) * len(y) < 2**52
        # One more than k, since the query itself may be among them.
        rows, s = search(tree, x, x if near else exact, counts, y, y if near else v, k + 1, int(kth))
        for r, score in zip(rows, s, strict=True):
            found += list(ids[r])
            scores += [score] * len(ids[r])
            qs += [q] * len(ids[r])
            same += [bool((exact[r] == v).all())] * len(ids[r])
    return pd.DataFrame({"q": np.array(qs, dtype=np.int64), "id": np.array(found, dtype=np.int64), "score": np.array(scores, dtype=np.int64), "same": np.array(same, dtype=bool)})


def top_k(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row for which ``is_query`` holds."""
    small_batches(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(valid(F.col("v")) & F.col("id").isNotNull())
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("long")))
    return by_size(rows, "v", lambda same: _top_k(same, k, shard))


def _top_k(rows: DataFrame, k: int, shard: int) -> DataFrame:
    index = stored(groups(rows, "id", "v", k + 1))
    n = index.count()
    width = len(index.select("v").first()["v"]) if n else 1
    cells = max(1, min(CELLS, -(-n // shard), PIVOT_BYTES // (8 * width)))
    pivots = np.array([r["v"] for r in index.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(cells).select("v").collect()], dtype=np.float64).reshape(-1, width)

    def near(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        square = (pivots**2).sum(axis=1)
        for v in batches:
            x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, width))
            cell = np.argmin(square - 2 * (x @ pivots.T), axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "away": np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))})

    index = stored(index.withColumn("c", F.pandas_udf(near, "cell int, away double")("v")).select("v", "ids", "rep", "c.cell", "c.away"))
    counts, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # one row a cell
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["away"] * (1 + 1e-9)
    parts = -(-counts // shard)
    first = np.cumsum(parts) - parts
    of_cell = lambda x: F.element_at(F.array(*[F.lit(int(i)) for i in x]), F.col("cell") + 1)
    index = index.withColumn("shard", (of_cell(first) + F.pmod(F.xxhash64("rep"), F.greatest(of_cell(parts), F.lit(1)))).cast("int")) if n else index.withColumn("shard", F.lit(0))

    def wave(known: bool) -> callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            full = np.flatnonzero(counts)
            for df in batches:
                x = np.stack(df["v"].to_numpy()).astype(np.float64) if len(df) else np.zeros((0, width))
                product = x @ pivots[full].T
                bound = slack(product, radius[full] * np.linalg.norm(x, axis=1)[:, None] * (1 + 1e-9))
                home = full[np.argmax(product, axis=1)] if len(df) else []
                own = first[home] + df["q"].to_numpy() % parts[home] if len(df) else []
                for i in range(len(df)):
                    at = [int(own[i])]
                    if known:
                        reach = full[bound[i] >= df["kth"].iat[i]]
                        at = [int(s) for c in reach for s in range(first[c], first[c] + parts[c]) if s != at[0]]
                    yield pd.DataFrame({"shard": np.array(at, dtype=np.int32), "query": True, "q": df["q"].iat[i], "kth": df["kth"].iat[i], "v": [df["v"].iat[i]] * len(at), "ids": [[]] * len(at)})

        return run

    queries, distinct = query_vectors(rows)
    vectors = index.select("shard", F.lit(False).alias("query"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("kth"), "v", "ids")

    def search_all(asked: DataFrame, known: bool) -> DataFrame:
        rows = vectors.unionByName(asked.select("q", "kth", "v").mapInPandas(wave(known), ROW))
        found = rows.repartition("shard").sortWithinPartitions("shard", "query").mapInPandas(find(k), "q long, id long, score long, same boolean")
        n = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
        return found.withColumn("n", n).filter(F.col("n") <= k + 1)

    start = stored(search_all(distinct.withColumn("kth", F.lit(NONE)), False))
    if len(pivots) == 1 and parts.sum() <= 1:
        return expand(start.drop("n"), queries.join(distinct, "v").drop("v"), "q", k, -F.col("score"))
    bar = start.filter(F.col("n") == k + 1).select("q", F.col("score").alias("kth"))
    rest = search_all(distinct.join(bar, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE))), True)
    every = start.unionByName(rest).drop("n").withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k + 1)
    return expand(every.drop("n"), queries.join(distinct, "v").drop("v"), "q", k, -F.col("score"))
