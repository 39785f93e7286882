import math
import random

import pytest
from pyspark.sql import functions as F

from syllabrook.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(4)
    rows = [(i, [float(f"{rnd.gauss(0, 1):.4f}") for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(300)]  # one vector for a third of all
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [1.0] * 7 + [None]), (2200, [1.0] * 3), (2250, [float("inf")] * 8), (None, [1.0] * 8), (2300, [])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(4)


def valid(table, zero):
    return {r["vec_id"]: r["embedding"] for r in table.collect() if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 8 and all(x is not None and math.isfinite(x) for x in r["embedding"]) and (zero or any(r["embedding"]))}


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_exact_top_k(table):
    v = {i: [math.floor(256 * x) for x in e] for i, e in valid(table, True).items()}
    got = lists(topk.top_k(table, F.col("vec_id") % 50 == 0, shard=128))
    want = {}
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:5]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def test_neighbours(table):
    v = valid(table, False)
    got = lists(ann.nearest(table, F.col("vec_id") % 50 == 0, leaf=32))
    hits = total = 0
    for q in (i for i in v if i % 50 == 0):
        best = sorted((math.dist(v[q], v[i]), i) for i in v if i != q)[:10]
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(s == pytest.approx(math.dist(v[q], v[i])) for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & {i for _, i in best})
        total += 10
    assert hits / total >= 0.9
    # copies of one vector come first, by id, without the query
    assert [i for _, i, _ in got[700]] == [5, *range(701, 710)]


def test_vectors_of_several_sizes_meet_their_own(spark):
    rows = [(i * 100, [float(i), 1.0]) for i in range(5)] + [(i * 100 + 50, [float(i), 1.0, 2.0]) for i in range(4)] + [(7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found, step in ((topk.top_k(df, F.col("vec_id") % 50 == 0), 50), (ann.nearest(df, F.col("vec_id") % 50 == 0), 50)):
        got = lists(found)
        assert got.keys() == {i for i, _ in rows if i % step == 0}
        assert all(len(x) == (4 if q % 100 == 0 else 3) and {i % 100 for _, i, _ in x} == {q % 100} for q, x in got.items())


def test_scores_beyond_doubles(spark):
    rows = [(i, [2.0**20 + i, 2.0**19 - i]) for i in range(0, 200, 10)]
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    for q, found in lists(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, shard=4)).items():
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:5]
        assert found == [(n + 1, i, -s) for n, (s, i) in enumerate(best)] and found[0][2] > 2**53


def test_cells_and_nodes_are_left_out(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 40
    x = np.floor(np.concatenate([c + rng.normal(size=(250, 16)) for c in centres]) * 256)
    tree, seen = topk.ball_tree(x), 0
    for q in x[::500]:
        looked = []
        monkeypatch.setattr(topk, "slack", lambda p, s: looked.append(1) or p + s + 1e-6 * (abs(p) + s) + 1e-3)
        rows, scores = topk.search(tree, x, x, np.ones(len(x), dtype=int), q, q, 6, topk.NONE)
        assert sorted(scores)[-6:] == sorted(x @ q)[-6:]
        seen += len(looked)
    assert seen / len(x[::500]) < 127 / 2  # fewer than half of the nodes


def test_few_and_none(spark, table):
    few = table.filter("vec_id in (0, 50, 3)")
    assert {q: [i for _, i, _ in x] for q, x in lists(topk.top_k(few, F.col("vec_id") % 50 == 0)).items()}.keys() == {0, 50}
    assert all(len(x) == 2 for x in lists(ann.nearest(few, F.col("vec_id") % 50 == 0)).values())
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(empty, F.col("vec_id") % 50 == 0).count() == 0


def repeated(seed):
    """Ids that occur 3 and 14 times, on near vectors and on one vector, queries' own among them."""
    rnd = random.Random(seed)
    near = lambda v: [x + rnd.uniform(-0.01, 0.01) for x in v]
    far = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(far)] + [(7, near(far[0])) for _ in range(14)] + [(100, near(far[0])) for _ in range(3)] + [(0, far[0]), (0, far[0]), (50, far[1]), (50, far[1]), (50, near(far[1]))]
    return [*rows, *[(i, far[2]) for i in (9, 9, 9, 150, 150)]]


def by_row(rows, k, best, is_query):
    """The lists of all query rows, as (id, ids and scores), every other row being a candidate."""
    out = []
    for n, (q, v) in enumerate(rows):
        if is_query(q):
            found = sorted((best(v, w), i) for m, (i, w) in enumerate(rows) if m != n)[:k]
            out.append((q, [(r + 1, i, round(s, 9)) for r, (s, i) in enumerate(found)]))
    return sorted(out)


def told_by_row(df, sign):
    """Lists of queries of one id cannot be told apart, so their rows are compared as they come."""
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(sign * r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_are_rows_of_their_own(spark, seed):
    rows = repeated(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    flat = lambda want: sorted((q, *x) for q, found in want for x in found)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = by_row(whole, 5, lambda v, w: -sum(a * b for a, b in zip(v, w)), lambda q: q % 50 == 0)
    assert told_by_row(topk.top_k(df, F.col("vec_id") % 50 == 0, shard=16), -1) == flat(want)
    want = by_row(rows, 10, math.dist, lambda q: q % 50 == 0)
    assert told_by_row(ann.nearest(df, F.col("vec_id") % 50 == 0), 1) == flat(want)
