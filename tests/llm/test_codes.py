"""Vector codes against whole-number arithmetic that looks at every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from syllabrook.llm import codes, queries

HELD = 1 << 62


def plain(rows):
    """(vec_id, code, error, label_error, digest) of rows of (vec_id, vector, label)."""
    kept = [(i, [max(-HELD, min(HELD, math.floor(x * 4096) if abs(x) < 1e300 else (HELD if x > 0 else -HELD))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(8)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            at = [nearest(cut(v)[p], books[p])[1] for _, v, _ in kept]
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), a in zip(kept, at, strict=True) if a == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    told, by_label = [], {}
    for i, v, label in kept:
        best = [nearest(cut(v)[p], books[p]) for p in range(8)]
        error = sum(d for d, _ in best)
        told.append((i, "".join(f"{e:02x}" for _, e in best), min(error, (1 << 63) - 1), label))
        by_label[label] = by_label.get(label, 0) + told[-1][2]
    return sorted(((i, c, e, min(by_label[label], (1 << 63) - 1), digest) for i, c, e, label in told), key=str)


def vectors(seed, n, dim, spread):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, spread) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rnd.gauss(0, spread / 3) for c in rnd.choice(centres)], rnd.choice([1, 2, None])) for i in range(n)]


CASES = {
    "plain": vectors(1, 120, 16, 0.4),
    "few": vectors(2, 5, 24, 1.0),
    "uneven": [*vectors(3, 40, 13, 1.0), (90, [0.5] * 3, 2), (91, [], 2), (92, [0.0] * 13, None)],
    "repeated": [*vectors(4, 30, 8, 1.0), *[(7, [0.25] * 8, 1)] * 40, *[(None, [0.5, -0.5] * 4, None)] * 20, (5, [0.125] * 8, 3)],
    "odd": [*vectors(5, 20, 8, 1.0), (50, None, 1), (51, [None] * 8, 1), (52, [float("nan")] + [0.0] * 7, 1), (53, [float("inf")] * 8, 1)],
    "large": [*vectors(6, 30, 16, 1e6), *[(60 + i, [3.1e13 * (i + 1), -2.0e15] * 8, 9) for i in range(4)], (70, [1e306] * 16, 9), (71, [-1e308] * 16, 9)],
    "empty": [(1, [], 1), (2, [], 1)],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_query_against_whole_numbers(spark, tmp_path, name):
    df = spark.createDataFrame(CASES[name], "vec_id long, embedding array<double>, label int").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(CASES[name])


@pytest.mark.parametrize("seed", range(20))
def test_annulus_misses_nothing(seed):
    rng = np.random.default_rng(seed)
    width, k = int(rng.integers(1, 6)), int(rng.integers(1, 17))
    book, x = rng.integers(-9, 10, (k, width)), rng.integers(-12, 13, (200, width))
    who, d = codes.nearest(x, book)
    every = ((x[:, None] - book) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()


def test_far_entries_are_not_evaluated(monkeypatch):
    seen = []
    square = codes._square
    monkeypatch.setattr(codes, "_square", lambda x: (seen.append(len(x)), square(x))[1])
    book = np.arange(16)[:, None] * 1000
    codes.nearest(np.arange(16)[:, None] * 1000 + 3, book)
    assert sum(seen) < 16 * 5


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(i, [float(i)] * 8, i % 2, "own") for i in range(20)], "vec_id long, embedding array<float>, label int, code string")
    done = codes.compress(df, keep=("label",))
    assert done.rows.columns == ["vec_id", "label", "code", "error"] and done.rows.count() == 20
