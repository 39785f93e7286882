"""The stored vector index against a look at every vector."""

import math
import random

import pytest

from syllabrook.operators import semantic


def rows(n, kinds, seed):
    rnd = random.Random(seed)
    centres = {k: [[rnd.gauss(0, 5) for _ in range(6)] for _ in range(4)] for k in kinds}
    return [(k := rnd.choice(kinds), i, [x + rnd.gauss(0, 0.5) for x in rnd.choice(centres[k])]) for i in range(n)]


def plain(data, queries, quotas):
    out = []
    for q, v in queries:
        for kind, k in quotas.items():
            near = sorted((round(math.dist(v, w), 6), i) for kk, i, w in data if kk == kind and w is not None)[:k]
            out += [(q, kind, i, d, n + 1) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_lookup_is_exact_and_reads_few_cells(spark, tmp_path):
    data = [*rows(600, ["notes", "scheme"], 1), ("few", 9000, [0.0] * 6), ("notes", 9001, None), *[("notes", 9100 + i, [1.0] * 6) for i in range(30)]]
    index = semantic.build(spark.createDataFrame(data, "kind string, id long, vec array<double>").repartition(3), f"file://{tmp_path}/index", cells=12, least=1)
    queries = [(i, v) for _, i, v in data[:5]] + [(-1, [50.0] * 6), (-2, [1.0] * 6)]
    quotas = {"notes": 15, "scheme": 5, "few": 4, "none": 3}
    got = semantic.lookup(index, spark.createDataFrame(queries, "q_id long, q_vec array<double>"), quotas)
    assert sorted((r["q_id"], r["kind"], r["id"], r["distance"], r["rank"]) for r in got.collect()) == plain(data, queries, quotas)
    one = semantic.lookup(index, spark.createDataFrame(queries[:1], "q_id long, q_vec array<double>"), {"notes": 3})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 3 and all("cell" in line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters: [" in line and "vectors" in line)


def test_small_kinds_have_one_cell(spark, tmp_path):
    index = semantic.build(spark.createDataFrame(rows(50, ["a", "b"], 2), "kind string, id long, vec array<double>"), f"file://{tmp_path}/index")
    assert index.cells.count() == 2


def test_vectors_of_several_lengths_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0, 2.0])], "kind string, id long, vec array<double>")
    with pytest.raises(ValueError, match="of one length"):
        semantic.build(df, f"file://{tmp_path}/index", least=1)
