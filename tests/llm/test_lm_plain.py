"""The model told again bit by bit in plain Python, and its total against the word baseline on the larger test table."""

import math
import os
import random

import numpy as np
import pytest
from helpers import texts
from pyspark.sql import functions as F

from syllabrook.llm import lm, queries
from syllabrook.llm.common import BASE

M64 = (1 << 64) - 1
MIX = int(lm.MIX)
BLANKS = {0, 32, *range(9, 14)}


def plain_contexts(text, i):
    """Hashes of the contexts of byte i of a text."""
    before = int.from_bytes(bytes(8 - min(i, 8)) + text[max(0, i - 8) : i], "little")
    words = [[]]
    for b in text[:i]:
        if b in BLANKS:
            words.append([])
        else:
            words[-1].append(b)
    value = lambda w: sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(w, 1)) & M64
    earlier = [w for w in words[:-1] if w]
    word = value(words[-1])
    pair = ((value(earlier[-1]) if earlier else 0) * MIX + word) & M64
    last = text[i - 1] if i else 0
    return [last, before >> 48, *[_spread(x) for x in (before >> 32, before >> 16, word, pair)]]


def _spread(x):
    x = x * MIX & M64
    x ^= x >> 32
    return x * MIX & M64


def plain_score(text, model, shares):
    """The log10 probability of a text (with its end sign)."""
    text += b"\x00"
    costs, slope, bend, scale, word_known = [], 0.0, 0.0, 1.0, None
    part = []
    for i, byte in enumerate(text):
        odds = np.zeros((len(lm.ORDERS), 8))
        for k, h in enumerate(plain_contexts(text, i)):
            bits = model.bits[k]
            line = h if k < 2 else h >> (64 - bits[0])
            first = (line << 4) | (byte >> 4)
            second = ((first * MIX & M64) >> (64 - bits[1]) << 4) | (byte & 15)
            for half, cell in enumerate((first, second)):
                odds[k, 4 * half : 4 * half + 4] = np.array([model.tables[k][half][cell]], dtype=np.uint32).view(np.int8)
        last = text[i - 1] if i else 0
        word_known = odds[lm.WORD_SO_FAR, 0] != 0
        gate = int(lm.KIND[last]) + (0 if word_known else 4)
        z = np.clip((odds * model.weights[gate]).sum(axis=0), -40, 40)
        part.append(z)
        costs.append(sum(math.log1p(math.exp(-min(20, max(-20, x * scale)))) for x in z))
        if len(part) == lm.CHUNK:
            for x in np.concatenate(part):
                q = 1 / (1 + math.exp(x))
                slope += q * x
                bend += q * x * (x - q * x)
            part = []
            scale = min(2.0, max(0.5, 1 + slope / (bend + 50.0)))
    return -(sum(costs) - (plain_words(text, costs, shares) if shares is not None else 0.0)) / math.log(10)


def plain_words(text, costs, shares):
    """What the words gain, one after another; the weights are found in three rounds, each from the words before."""
    spans, start = [], None
    for i, b in enumerate(text):
        if b not in BLANKS and start is None:
            start = i
        if b in BLANKS and start is not None:
            spans.append((start, i))
            start = None
    better, seen = [], {}
    for n, ((a, b), share) in enumerate(zip(spans, shares, strict=True)):
        sign = text[b]
        follows = (seen.get(sign, 0) + lm.SIGN_FIRST[sign]) / (n + lm.SIGN_FIRST.sum())
        seen[sign] = seen.get(sign, 0) + 1
        better.append(min(500.0, sum(costs[a : b + 1]) + math.log(share) + math.log(follows)) if share else -math.inf)
    weight = [0.5] * len(better)
    for _ in range(3):
        likely = [w * math.exp(d) / (1 - w + w * math.exp(d)) for w, d in zip(weight, better)]
        weight = [(sum(likely[:n]) + 0.5) / (n + 2) for n in range(len(likely))]
    return sum(math.log(1 - w + w * math.exp(d)) for w, d in zip(weight, better))


def trained(sample):
    lay = lm.Layout(sample)
    counts = [np.zeros(s + 1, dtype=np.int64) for z in lm.SIZES for s in z]
    for k in range(len(lm.ORDERS)):
        for half, at in enumerate(lay.cells(k)):
            at[lay.between()] = lm.SIZES[k][half]
            np.add.at(counts[2 * k + half], at, 1)
    tables = [[lm.packed(counts[2 * k + h][:-1]) for h in (0, 1)] for k in range(len(lm.ORDERS))]
    return lm.Model(tables, lm.fit_weights(tables, sample[:10]))


def test_against_a_plain_model():
    sample = [lm.escaped(t.encode().lower()) for t in texts(1) if t][:40]
    model = trained(sample)
    rnd = random.Random(5)
    cases = [b"", b" ", b"alpha", b"  two\n words\t", lm.escaped(b"\x00 nul \x01"), "é漢".encode(), sample[3], sample[8][:300], b"x" * 1200]
    shares = [np.array([rnd.choice([0, 0, 1e-3, 0.05]) for _ in t.split()]) for t in cases]
    got = model.log10(cases, shares)
    assert got == pytest.approx([plain_score(t, model, s.tolist()) for t, s in zip(cases, shares)], rel=2e-4, abs=1e-3)
    assert model.log10(cases) == pytest.approx([plain_score(t, model, None) for t in cases], rel=2e-4, abs=1e-3)


def test_words_at_hand_are_used():
    model = trained([b"nothing of this"])
    text = b"zebra " * 50
    assert model.log10([text], [np.full(50, 0.5)])[0] > 0.6 * model.log10([text])[0]


def test_what_follows_a_word_sums_to_one():
    assert lm.SIGN_FIRST.sum() == pytest.approx(5.0) and set(np.flatnonzero(lm.SIGN_FIRST)) == BLANKS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_texts_are_predicted_better_than_by_words(spark):
    got = queries.op10_lm_score(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.min("bits_per_byte")).first()
    assert got[0] > got[1] and got[2] > 0
