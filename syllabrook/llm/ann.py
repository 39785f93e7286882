"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are fitted on a sample of at most ``SAMPLE`` distinct vectors, ``SAMPLE_BYTES`` in all (a documented bound);
every vector of the table is then routed to one leaf of each tree. A query walks all trees at once through one
priority queue ordered by the margin to the split. It stops after as many leaves as the sample's own neighbours
need to be found with ``TARGET`` recall, and before that where the margin exceeds the distance within which the
sample proves k + 1 vectors to lie, since nothing beyond it can be nearer. Queries and vectors meet by leaf;
candidates are ranked by their exact Euclidean distance in double precision, and the best of all leaves are merged.

Leaves hold more vectors as the table outgrows the sample; each is dealt to as many parts as keep
``PART`` vectors together, and a query visits all of them. Equal vectors are one entry of the forest
with the ids that can reach a result.

Cases: vectors that are null, empty, zero, or that hold null or non-finite components take no part. A query is
compared with the vectors of its own size. Ties go to the smaller id. Fewer candidates than k give shorter lists.
Rows are candidates whatever their ids: a query does not find its own row, but other rows of its id. A row without an id,
which no result could name, takes no part. An empty table gives an empty result.
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

from syllabrook.llm.common import add_row_id, give_back, small_batches, stored
from syllabrook.llm.vectors import by_size, expand, groups, query_vectors, valid

SAMPLE, SAMPLE_BYTES, LEAF, TREES, PART, SEED = 65536, 64 << 20, 256, 10, 4096, 11
#: The recall of the sample's own neighbours that decides how many leaves are visited, the sample's vectors that are
#: asked for it, and the first leaves whose vectors bound a query's distance.
TARGET, ASKED, FIRST = 0.96, 64, 20


@dataclass
class Tree:
    """Inner nodes 0 to n-1 with direction, threshold and children; a child below 0 is leaf -1 - child."""

    direction: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    members: list[np.ndarray]  # the sample's points of each leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64) if len(self.threshold) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.direction[n]) > self.threshold[n]
            at[inner] = self.child[n, right.astype(np.int64)]
        return -1 - at


def build(x: np.ndarray, leaf: int, seed: int) -> Tree:
    """Splits at the median of the projection on the difference of two random points."""
    rng = np.random.default_rng(seed)
    direction, threshold, child, members = [], [], [], []
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                d = x[a] - x[b]
                n = np.linalg.norm(d)
                if not n:
                    continue
                p = x[rows] @ (d / n)
                t = float(np.median(p))
                if (p > t).any() and (p <= t).any():
                    split = (d / n, t, p > t)
                    break
        if split is None:
            here = -1 - len(members)
            members.append(rows)
        else:
            here = len(threshold)
            direction.append(split[0])
            threshold.append(split[1])
            child.append([0, 0])
            todo += [(rows[~split[2]], here, 0), (rows[split[2]], here, 1)]
        if parent >= 0:
            child[parent][side] = here
    return Tree(np.array(direction).reshape(-1, x.shape[1]), np.array(threshold), np.array(child, dtype=np.int64).reshape(-1, 2), members)


def search(forest: list[Tree], q: np.ndarray, probes: int) -> list[tuple[int, int, float]]:
    """The leaves (tree, leaf, least distance of what lies there) that one query visits, best first, by one queue over all trees."""
    margins = [t.direction @ q - t.threshold if len(t.threshold) else np.zeros(0) for t in forest]
    queue = [(0.0, k, 0 if len(t.threshold) else -1) for k, t in enumerate(forest)]
    heapq.heapify(queue)
    out: list[tuple[int, int, float]] = []
    while queue and len(out) < probes:
        bound, k, node = heapq.heappop(queue)
        if node < 0:
            out.append((k, -1 - node, bound))
            continue
        m = margins[k][node]
        near, far = forest[k].child[node, int(m > 0)], forest[k].child[node, int(m <= 0)]
        heapq.heappush(queue, (bound, k, int(near)))
        heapq.heappush(queue, (max(bound, abs(m)), k, int(far)))
    return out


def reach(forest: list[Tree], points: np.ndarray, q: np.ndarray, leaves: list[tuple], k: int) -> float:
    """A distance within which there are k + 1 vectors at least: that of the sample's points in the first leaves."""
    rows = np.unique(np.concatenate([forest[t].members[p] for t, p, _ in leaves[:FIRST]]))
    if len(rows) <= k:
        return float("inf")
    return float(np.sqrt(np.partition(((points[rows] - q) ** 2).sum(axis=1), k)[k])) * (1 + 1e-9)


def visited(forest: list[Tree], points: np.ndarray, q: np.ndarray, probes: int, k: int) -> tuple[list[tuple[int, int]], float]:
    """The leaves that can hold a neighbour among the first ``probes``, and the distance that they have to stay within."""
    leaves = search(forest, q, probes)
    within = reach(forest, points, q, leaves, k)
    return [(t, p) for t, p, bound in leaves if bound <= within], within


def probes_needed(forest: list[Tree], points: np.ndarray, k: int, target: float = TARGET) -> int:
    """How many leaves find ``target`` of the nearest vectors of some of the sample's own."""
    every = sum(len(t.members) for t in forest)
    if len(points) <= k + 1:
        return every
    leaf_of = []
    for t in forest:
        at = np.empty(len(points), dtype=np.int64)
        for p, rows in enumerate(t.members):
            at[rows] = p
        leaf_of.append(at)
    first: list[int] = []
    for i in np.random.default_rng(SEED).choice(len(points), min(ASKED, len(points)), replace=False):
        d = ((points - points[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        place = [np.zeros(len(t.members), dtype=np.int64) for t in forest]
        for n, (t, p, _) in enumerate(search(forest, points[i], every)):
            place[t][p] = n
        near = np.argpartition(d, k)[:k]
        first += np.min([place[t][leaf_of[t][near]] for t in range(len(forest))], axis=0).tolist()
    return min(every, int(np.sort(first)[min(len(first) - 1, int(np.ceil(target * len(first))))]) + 1)


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds."""
    small_batches(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(valid(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    return by_size(rows, "v", lambda same: _nearest(same, k, trees, sample, leaf, target))


def _nearest(rows: DataFrame, k: int, trees: int, sample: int, leaf: int, target: float) -> DataFrame:
    spark = rows.sparkSession
    index = stored(add_row_id(groups(rows, "id", "v", k + 1), "key"))
    n = index.count()
    size = len(index.select("v").first()["v"]) if n else 1
    sample = min(sample, SAMPLE_BYTES // (8 * size))
    part = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30))
    few = index.filter(part < int(min(1.0, sample / max(n, 1)) * (1 << 30))).select("v").limit(2 * sample).toPandas()["v"]
    points = np.array(few.tolist(), dtype=np.float64).reshape(-1, size)
    kind = dict(index.dtypes)["v"]
    grown = [build(points, leaf, SEED + t) for t in range(trees)]
    probes = max(trees, probes_needed(grown, points, k, target))
    forest = spark.sparkContext.broadcast((grown, points))
    # A leaf grows as the table outgrows the sample.
    parts = max(1, -(-(n * leaf) // (max(1, len(points)) * PART)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = matrix(df["v"])
            for t, tree in enumerate(forest.value[0]):
                yield df.assign(tree=t, leaf=tree.leaves(x), part=(df["rep"] % parts).astype("int32"))
        give_back()

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, points = forest.value
        for df in batches:
            out = []
            for q, v, x in zip(df["q"], df["v"], matrix(df["v"]), strict=True):
                leaves, within = visited(trees, points, x, probes, k)
                out += [(q, v, within, t, p, m) for t, p in leaves for m in range(parts)]
            yield pd.DataFrame(out, columns=["q", "v", "within", "tree", "leaf", "part"])

    def rank(at: tuple, of: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        cells: dict[str, list] = {c: [] for c in ("q", "key", "nth", "id", "score", "same")}
        if len(of) and len(by):
            x, members, keys = matrix(of["v"]), of["ids"].to_numpy(), of["key"].to_numpy()
            for q, v, within in zip(by["q"], matrix(by["v"]), by["within"], strict=True):
                d = np.sqrt(((x - v) ** 2).sum(axis=1))
                if len(d) > k + 1:
                    within = min(within, np.partition(d, k)[k])
                for j in np.flatnonzero(d <= within):
                    n = len(members[j])
                    for c, values in (("q", [q] * n), ("key", [keys[j]] * n), ("nth", range(n)), ("id", members[j]), ("score", [d[j]] * n), ("same", [bool((x[j] == v).all())] * n)):
                        cells[c] += list(values)
        kinds = {"nth": np.int32, "score": np.float64, "same": bool}
        return pd.DataFrame({c: np.array(a, dtype=kinds.get(c, np.int64)) for c, a in cells.items()})

    spots = index.mapInPandas(route, f"v {kind}, ids array<long>, rep long, key long, tree int, leaf long, part int")
    queries, distinct = query_vectors(rows)
    visits = distinct.select("q", "v").mapInPandas(probe, f"q long, v {kind}, within double, tree int, leaf long, part int")
    key = ["tree", "leaf", "part"]
    found = spots.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(rank, "q long, key long, nth int, id long, score double, same boolean")
    order = W.partitionBy("q").orderBy("score", "id")
    # Several trees report a row: it is told by its vector's key and its place among the rows of that vector.
    found = found.groupBy("q", "key", "nth").agg(F.first("id").alias("id"), F.first("score").alias("score"), F.first("same").alias("same")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return expand(found.select("q", "id", "score", "same"), queries.join(distinct, "v").drop("v"), "q", k, F.col("score"))


def matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 1))
