"""Recall of the forest with the parameters in use, on a table that is larger than the trees' sample."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from syllabrook.llm import ann


def test_recall_beyond_the_sample(spark, tmp_path):
    n = ann.SAMPLE + 6000
    x = np.random.default_rng(8).normal(size=(n, 32)).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(tmp_path / "embeddings.parquet")
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumns({"label": F.lit(1), "score": F.lit(2)}).repartition(4)
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 1500 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    queries = np.arange(0, n, 1500)
    hits = 0
    for q in queries:
        d = np.linalg.norm(x.astype(float) - x[q].astype(float), axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    print("recall", hits / (10 * len(queries)))
    assert hits / (10 * len(queries)) >= 0.9


def compared(x, queries):
    """Recall and the share of a scan that the production parameters compare, on the driver."""
    forest = [ann.build(x, ann.LEAF, ann.SEED + t) for t in range(ann.TREES)]
    probes = max(ann.TREES, ann.probes_needed(forest, x, 10))
    hits = looked = 0
    for q in queries:
        leaves, _ = ann.visited(forest, x, x[q], probes, 10)
        rows = np.concatenate([forest[t].members[p] for t, p in leaves])
        looked += len(rows)
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(set(rows.tolist()) & set(np.argsort(d)[:10].tolist()))
    return hits / (10 * len(queries)), looked / (len(x) * len(queries))


def test_clustered_vectors_take_a_small_part_of_a_scan():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(500, 64)) * 3, 100, axis=0) + rng.normal(size=(50_000, 64)) * 0.3
    recall, share = compared(x, range(0, 50_000, 1000))
    print("clustered: recall", recall, "share of a scan", share)
    assert recall >= 0.9 and share <= 0.2


def test_vectors_without_clusters_keep_their_recall():
    x = np.random.default_rng(6).normal(size=(20_000, 64))
    recall, share = compared(x, range(0, 20_000, 1000))
    print("without clusters: recall", recall, "share of a scan", share)
    assert recall >= 0.9
