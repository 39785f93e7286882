"""Semantic lookup by content type: an index of cells that is stored, and searches that read only the cells they need, with exact results.

The vectors of each content type are dealt to cells by the nearest of a few of their own; a cell knows its radius. A search first reads the
nearest cells that hold k vectors, which bounds the distance of the k-th; then those other cells that can hold something nearer. Types and
cells are folders of the stored index, so both readings leave all other files alone.

Centres are a bounded number of vectors of each type (``CELLS``, fewer of small types, and ``CENTRE_BYTES`` in all); queries are a stated set. Ties go to the smaller id;
rows without a vector or of another length than the centres' take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS, CENTRE_BYTES = 64, 16 << 20
#: Vectors that a cell should hold on average, at least.
LEAST = 256
#: Vectors of a cell that a task looks at together, and queries at a time.
PART, BLOCK = 8192, 256
#: What a distance may be off by when it is compared with a bound.
SLACK = 1e-6


@dataclass
class Index:
    """vectors: (kind, cell, id, vec), a folder for each kind and cell; cells: (kind, cell, centre, radius, n)."""

    spark: SparkSession
    root: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")


def build(rows: DataFrame, root: str, cells: int = CELLS, least: int = LEAST) -> Index:
    """Writes the index of rows (kind, id, vec) to the folder ``root``, which must not exist."""
    rows = rows.select(F.col("kind").cast("string").alias("kind"), "id", F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("kind").isNotNull() & F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))
    # The centres: of each kind the first few by hash, which has nothing to do with where they lie.
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("id"), "id"))
    few = F.broadcast(rows.groupBy("kind").agg(F.least(F.lit(cells), F.ceil(F.count("*") / least)).alias("few")))  # one row a kind
    chosen = rows.withColumn("n", rank).filter(F.col("n") <= cells).join(few, "kind").filter(F.col("n") <= F.col("few")).groupBy("kind", F.size("vec").alias("size")).agg(F.sort_array(F.collect_list(F.struct("n", "vec"))).alias("c")).collect()
    if sum(len(r["c"]) * r["size"] * 8 for r in chosen) > CENTRE_BYTES:
        raise ValueError("too many kinds for so many cells; build with fewer cells")
    centres = {(r["kind"], r["size"]): np.array([c["vec"] for c in r["c"]]).reshape(len(r["c"]), r["size"]) for r in chosen}

    def nearest(kinds: pd.Series, vecs: pd.Series) -> pd.DataFrame:
        cell, away = np.full(len(kinds), -1, dtype=np.int32), np.zeros(len(kinds))
        sizes = np.array([len(v) for v in vecs], dtype=np.int64)
        for key, c in centres.items():
            at = np.flatnonzero((kinds.to_numpy() == key[0]) & (sizes == key[1]))
            if len(at):
                x = np.stack(vecs.iloc[at].to_numpy())
                square = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)
                cell[at] = square.argmin(axis=1)
                away[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "away": away})

    dealt = rows.withColumn("c", F.pandas_udf(nearest, "cell int, away double")("kind", "vec")).select("kind", "c.cell", "id", "vec", "c.away").filter("cell >= 0")
    dealt.repartition("kind", "cell").write.partitionBy("kind", "cell").parquet(f"{root}/vectors")
    spark = rows.sparkSession
    schema = "kind string, cell int, centre array<double>"
    told = spark.createDataFrame([(kind, n, v.tolist()) for (kind, _), c in centres.items() for n, v in enumerate(c)], schema)
    # Of kinds with vectors of several lengths the cells of the most frequent length only are told apart by their number.
    if told.groupBy("kind", "cell").count().filter("count > 1").limit(1).count():
        raise ValueError("the vectors of a kind have to be of one length")
    sizes = _typed(spark.read.parquet(f"{root}/vectors")).groupBy("kind", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    told.join(sizes, ["kind", "cell"]).write.parquet(f"{root}/cells")
    return Index(spark, root)


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({"kind": F.col("kind").cast("string"), "cell": F.col("cell").cast("int")})


def lookup(index: Index, queries: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(q_id, kind, id, distance, rank): of each kind its quota of the vectors that are nearest to each query (q_id, q_vec).

    A query's cells are put in order beside it, without a shuffle; cells and their centres are bounded (``CELLS``, ``CENTRE_BYTES``).
    What leaves a part of a cell is the best of each query there. Queries with components that are null or NaN take no part.
    """
    cells = [r for r in _typed(index.cells).collect() if r["kind"] in quotas]
    near = _near(queries, cells, quotas)
    found = _read(index, near.filter("first"), cells, max(quotas.values()))
    kth = found.filter(F.col("rank") == F.col("k")).select("q_id", "kind", F.col("exact").alias("kth"))
    more = near.filter(~F.col("first")).drop("q_vec").join(kth, ["q_id", "kind"], "left")
    more = more.filter(F.col("kth").isNull() | (F.col("away") - F.col("radius") <= F.col("kth") + SLACK * (1 + F.col("away"))))
    more = more.join(queries.select("q_id", F.col("q_vec").cast("array<double>").alias("q_vec")), "q_id")
    every = found.drop("rank").unionByName(_read(index, more, cells, max(quotas.values())).drop("rank"))
    return _ranked(every, max(quotas.values())).select("q_id", "kind", "id", "distance", "rank")


def _near(queries: DataFrame, cells: list[Row], quotas: dict[str, int]) -> DataFrame:
    """(q_id, q_vec, kind, cell, k, away, radius, first): each query's cells; the first are the nearest that hold k vectors. Only those carry ``q_vec``."""
    kinds = sorted({r["kind"] for r in cells})
    told = {kind: (np.array([r["centre"] for r in cells if r["kind"] == kind]), np.array([(r["cell"], r["radius"], r["n"]) for r in cells if r["kind"] == kind])) for kind in kinds}

    def ordered(vecs: pd.Series) -> pd.Series:
        out = []
        for v in vecs:
            row = []
            for kind, (centres, facts) in told.items():
                if centres.shape[1] != len(v):
                    continue
                away = np.sqrt(((centres - np.asarray(v)) ** 2).sum(axis=1))
                order = np.lexsort((facts[:, 0], away))
                have = np.cumsum(facts[order, 2]) - facts[order, 2]
                row += [{"kind": kind, "cell": int(facts[i, 0]), "away": float(away[i]), "radius": float(facts[i, 1]), "first": bool(h < quotas[kind])} for i, h in zip(order, have, strict=True)]
            out.append(row)
        return pd.Series(out)

    q = queries.select("q_id", F.col("q_vec").cast("array<double>").alias("q_vec")).filter(F.forall("q_vec", lambda x: x.isNotNull() & ~F.isnan(x)))
    udf = F.pandas_udf(ordered, "array<struct<kind:string,cell:int,away:double,radius:double,first:boolean>>")
    near = q.select("q_id", "q_vec", F.explode(udf("q_vec")).alias("c")).select("q_id", "q_vec", "c.*")
    k = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return near.withColumn("k", F.element_at(k, F.col("kind"))).select("q_id", F.when(F.col("first"), F.col("q_vec")).alias("q_vec"), "kind", "cell", "k", "away", "radius", "first")


def _read(index: Index, probes: DataFrame, cells: list[Row], most: int) -> DataFrame:
    """The best of what the cells of the probes hold; only their folders are read.

    Vectors of a cell are dealt to parts of about ``PART``, each with all probes of the cell, so no task sees more than that of a large cell.
    """
    wanted = {(r["kind"], r["cell"]) for r in probes.select("kind", "cell").distinct().collect()}  # as many as there are cells at most
    folders = F.lit(False)
    for kind in sorted({k for k, _ in wanted}):
        folders = folders | ((F.col("kind").cast("string") == kind) & F.col("cell").isin(*[c for k, c in wanted if k == kind]))
    parts = max([-(-r["n"] // PART) for r in cells if (r["kind"], r["cell"]) in wanted], default=1)
    rows = _typed(index.vectors.filter(folders)).select("kind", "cell", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "vec")
    asked = probes.select("kind", "cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "q_id", "q_vec", "k")
    types = dict(probes.dtypes) | {"id": dict(rows.dtypes)["id"]}
    by = ["kind", "cell", "part"]
    pairs = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(_best, f"q_id {types['q_id']}, kind string, k int, id {types['id']}, exact double")
    return _ranked(pairs.withColumn("distance", F.round("exact", 6)), most)


def _best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Of the rows those that may be among the k best of a query: also what is as near when it is rounded, of the same distance the k smallest ids."""
    out = []
    if len(rows) and len(asked):
        rows = rows.sort_values("id", kind="stable")
        x, ids = np.stack(rows["vec"].to_numpy()), rows["id"].to_numpy()
        norms = (x * x).sum(axis=1)
        for start in range(0, len(asked), BLOCK):
            some = asked.iloc[start : start + BLOCK]
            q = np.stack(some["q_vec"].to_numpy())
            own = (q * q).sum(axis=1)
            square = own[:, None] + norms - 2 * (q @ x.T)
            for i, (q_id, kind, k) in enumerate(zip(some["q_id"], some["kind"], some["k"], strict=True)):
                quota, k = int(k), min(int(k), len(ids))
                bound = max(np.partition(square[i], k - 1)[k - 1], 0.0)
                slack = 1e-9 * (own[i] + norms.max()) + 4e-6 * np.sqrt(bound) + 1e-11
                at = np.flatnonzero(square[i] <= bound + 2 * slack)
                total = np.zeros(len(at))
                for d in range(x.shape[1]):  # in the order of the components, as ``values.l2`` adds them
                    total += (q[i, d] - x[at, d]) ** 2
                exact = np.sqrt(total)
                order = np.argsort(exact, kind="stable")  # rows are in the order of their ids
                at, exact = at[order], exact[order]
                first = np.maximum.accumulate(np.where(np.r_[True, exact[1:] != exact[:-1]], np.arange(len(at)), 0))
                kept = np.arange(len(at)) - first < k
                out.append(pd.DataFrame({"q_id": q_id, "kind": kind, "k": quota, "id": ids[at[kept]], "exact": exact[kept]}))
    return pd.concat(out) if out else pd.DataFrame({"q_id": [], "kind": [], "k": [], "id": [], "exact": []})


def _ranked(pairs: DataFrame, most: int) -> DataFrame:
    """The k best of each query and kind; ``most``, the largest k, is known before, so Spark limits the groups before it shuffles them."""
    rank = F.row_number().over(W.partitionBy("q_id", "kind").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= F.col("k"))
