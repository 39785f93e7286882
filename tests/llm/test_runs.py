"""Periodic runs against a search of every start, end and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import DOCS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syllabrook.llm import queries, runs


def plain_runs(w, least):
    """Every stretch with smallest period q that is long enough and cannot be extended."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            smaller = any(all(w[j] == w[j + d] for j in range(s, s + length - d)) for d in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rnd):
    w = []
    while len(w) < 60:
        base = [rnd.randint(0, rnd.choice([1, 3, 40])) for _ in range(rnd.randint(1, 7))]
        w += (base * rnd.randint(1, 6))[: rnd.randint(1, 30)]
    return w


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_periodic_words(seed):
    w = periodic(random.Random(seed))
    for least in (4, 12):
        assert runs.runs_of(np.array(w), least) == plain_runs(w, least)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_words(w):
    assert runs.runs_of(np.array(w, dtype=np.int64), 4) == plain_runs(w, 4)


@pytest.mark.parametrize("levels", [0, 1, 40])
def test_cutting_changes_nothing(monkeypatch, levels):
    monkeypatch.setattr(runs, "LEVELS", levels)
    for seed in range(8):
        w = periodic(random.Random(seed)) + [100 + seed]
        assert runs.runs_of(np.array(w)) == plain_runs(w, 12)


@pytest.mark.parametrize("cost", [1e-9, 0.8, 1e9])
def test_heavy_and_light_words_count_alike(monkeypatch, cost):
    monkeypatch.setattr(runs, "FFT_COST", cost)
    rnd = np.random.default_rng(3)
    ids = np.minimum(rnd.geometric(0.2, 700), 30)
    want = [0] + [int((ids[q:] == ids[:-q]).sum()) for q in range(1, 351)]
    assert runs.lag_counts(ids).tolist() == want


def test_one_word_a_million_times():
    assert runs.runs_of(np.zeros(1_000_000, dtype=np.int64)) == [(0, 1_000_000, 1)]


def plain_report(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def told(df):
    rows = df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(5)
    texts = [" ".join(map(str, periodic(rnd))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "é x " * 13, "a b\n" * 9, "A a " * 8, texts[0], "\x1cw " * 12]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "k " * 15), (None, None), (3, "u v w " * 7), (3, "u v w " * 7)]


def test_query_against_the_plain_version(spark, spoken, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in spoken], DOCS).withColumn("found", F.lit(1)).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = told(queries.op13_periodic_runs(spark, str(tmp_path)))
    assert got == sorted((plain_report(i, t) for i, t in spoken), key=str)
    assert sum(r[1] for r in got) > 30


def test_no_documents(spark, none):
    assert runs.report(runs.find_runs(none)).count() == 0


def test_collapsed_text_and_other_columns(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 6 + "c", "own")], "doc_id long, text string, url string")
    row = runs.find_runs(df).first()
    assert row["url"] == "own" and row["found"]["collapsed"] == "x a b c" and [tuple(r) for r in row["found"]["runs"]] == [(1, 12, 2)]
