"""The scored model: what it tells apart, what it learns from, and how it grows."""

import math
import random

import numpy as np
import pytest
from helpers import DOCS, texts
from pyspark.sql import functions as F

from syllabrook.llm import lm


def test_lines_grow_with_the_training_bytes():
    size = [sum(map(sum, lm.sizes_of(lm.bits_for(1 << b)))) for b in range(20, 40)]
    assert size == sorted(size) and size[-1] > 500 * size[0]
    assert lm.bits_for(0) == lm.BITS


def test_whole_words_are_contexts(spark):
    rnd = random.Random(3)
    word = {"a": "abcdefghijklx", "z": "zbcdefghijkly"}  # the last letter follows from the first, twelve before it
    rows = [(i, " ".join(word[rnd.choice("az")] for _ in range(100)), "en", "a", 0) for i in range(120)]
    got = lm.score(spark.createDataFrame(rows, DOCS), F.col("doc_id") >= 10).filter("doc_id < 10").agg(F.sum("score")).first()[0]
    assert -got / math.log10(2) / 1000 < 1.5  # bits a word, of which the first letter costs one


def test_weights_are_learned_on_all_texts(spark):
    rows = [t for t in texts(5) if t]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)
    tables = [[np.zeros(s, dtype=np.uint32) for s in pair] for pair in lm.SIZES]
    seen = lm._fit(docs, tables, lm.BITS).filter("i = 0").agg(F.sum("n")).first()[0]
    assert seen == sum(len(lm._bytes(t)) + 1 for t in rows)


def test_all_texts_are_counted(spark):
    rows = [t for t in texts(5) if t] * 2
    parts = lm._learn(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3), lm.BITS)
    got = {k: 0 for k in range(2 * len(lm.ORDERS))}
    for r in parts.filter("kind >= 0").collect():
        got[r["kind"] >> 40] += int(lm._received(r["x"])[1].sum())
    assert set(got.values()) == {sum(len(lm._bytes(t)) + 1 for t in rows)}


def test_refinement_looks_at_every_bit():
    """Both halves of each byte: only the first bits are predicted wrongly here, which two of eight would not show."""
    bits = lm.BITS
    tables = [[np.zeros(s, dtype=np.uint32) for s in pair] for pair in lm.SIZES]
    odds = np.zeros((len(lm.ORDERS), 4 * lm.CHUNK, 8), dtype=np.int8)
    odds[0, :, 0] = -40
    model = lm.Model(tables, lm.first_weights(), bits)
    model.odds = lambda lay: odds[:, : len(lay.byte)]
    plain = np.log1p(np.exp(-lm.mixed(odds, np.zeros(odds.shape[1], dtype=int), model.weights))).sum(axis=1)[0] / np.log(10)
    text = b"x" * (4 * lm.CHUNK - 40)
    assert -model.log10([text])[0] < 0.99 * plain * (len(text) + 1)


@pytest.mark.parametrize("n", [1, 5, 60000])
def test_counts_travel(n):
    at = np.sort(np.random.default_rng(n).choice(1 << 16, n, replace=False))
    counts = np.random.default_rng(n).integers(1, 1 << 31, n).astype(np.uint32)
    got = lm._received(lm._sent(at, counts))
    assert np.array_equal(got[0], at) and np.array_equal(got[1], counts)
