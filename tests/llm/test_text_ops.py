import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import groups, rows, shingles, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syllabrook.llm import bpe, components, dedup, jaccard, langid, license_scan, lm, suffix
from syllabrook.llm.common import crc_mod


# n-gram Jaccard join
@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5)])
def test_links(docs, percent, k):
    r = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(x[1], k) for x in r]
    first = groups(sets, percent)
    want = Counter((x[0], len(s), r[f][0] if s else x[0]) for x, s, f in zip(r, sets, first))
    assert Counter(tuple(x) for x in jaccard.linked(docs, percent, k).collect()) == want


def test_no_documents_to_link(none):
    assert jaccard.linked(none).count() == 0


def test_prefixes_share_a_token_under_any_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 48, 60).astype(np.uint64))
        b = np.unique(np.concatenate((a[3:], rng.integers(0, 1 << 48, 2).astype(np.uint64))))
        assert len(np.intersect1d(a, b)) >= 0.9 * len(np.union1d(a, b))
        for f in jaccard.ORDERS:
            p, q = (jaccard.permuted_prefix(x, jaccard.prefix_size(len(x), 90), f) for x in (a, b))
            assert len(np.intersect1d(p, q))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(5, 5), (None, 1)], "u long, v long")
    assert sorted(tuple(r) for r in components.components(e).collect()) == [(i, i // 10 * 10) for i in range(41) if i % 10 and i < 40]


# suffix-array dedup
def removed(docs):
    """What goes, told window by window."""
    first = {}
    for i, b in docs:
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(first.get(w, math.inf), math.inf if i is None else i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < (math.inf if i is None else i):
                gone[j : j + 50] = b"\1" * 50
        spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("block", "shard"), [(1 << 22, 1 << 22), (2000, 1500)])
def test_repeats(docs, monkeypatch, block, shard):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "SHARD", shard)
    got = dedup.remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert Counter(tuple(r) for r in got.collect()) == removed([(r[0], (r[1] or "").encode()) for r in rows()])


def test_dedup_keeps_columns(docs, none):
    got = dedup.remove(docs, keep=("lang", "source"))
    assert sorted(map(str, got.select("doc_id", "columns.lang", "columns.source").collect())) == sorted(map(str, docs.select("doc_id", "lang", "source").collect()))
    assert dedup.remove(none).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("ab", min_size=1, max_size=84), min_size=1, max_size=25))
def test_suffix_order(pieces):
    s = np.frombuffer(("\0".join(pieces) + "\0").encode(), dtype=np.uint8).astype(np.uint16)
    sa = suffix.suffix_array(s)
    flat = s.tolist()
    assert sorted(sa) == list(range(len(s)))
    assert all(flat[a : a + 60] <= flat[b : b + 60] for a, b in zip(sa[:-1], sa[1:]))
    starts = np.concatenate(([0], np.flatnonzero(s == 0)[:-1] + 1))
    common = suffix.common_prefixes(s, sa, starts)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = next((k for k in range(50) if a + k >= len(flat) or b + k >= len(flat) or flat[a + k] != flat[b + k] or not flat[b + k]), 50)
        if 0 not in flat[b : b + 50] and b + 50 <= len(flat):
            assert (common[b] >= 50) == (n >= 50)


# BPE
@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    return path, lambda x: t.encode(x, add_special_tokens=False).ids, lambda i: t.decode(i, skip_special_tokens=False)


@settings(deadline=None, max_examples=300)
@given(st.one_of(st.text(max_size=200), st.text("ab ", max_size=400), st.lists(st.sampled_from(["<|endoftext|>", "aa", "  ", "'ll", "é", "\n", "12", "!?", "\x1c"]), max_size=60).map("".join)))
def test_codec_equals_the_library(reference, text):
    path, encode, decode = reference
    c = small(path)
    assert c.encode(text) == encode(text)
    assert sum((c.encode(b) for b in bpe.blocks(text, 30)), []) == encode(text)
    assert c.decode(encode(text)) == decode(encode(text))


_SMALL = {}


def small(path):
    return _SMALL.setdefault(path, bpe.Codec(path, piece=16, window=3))


def test_long_unsplit_text(reference):
    path, encode, _ = reference
    for t in ("ab" * 9000 + "c", "x" * 20000, "".join(chr(97 + i * i % 26) for i in range(30000)), " " * 9000 + "a"):
        assert bpe.codec(path).encode(t) == encode(t)


def test_encode_and_decode(docs, none, reference, monkeypatch):
    path, encode, decode = reference
    monkeypatch.setattr(bpe, "BLOCK", 200)
    got = bpe.encode(docs.withColumn("ids", F.lit(1)), path, decoded="back").collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["back"]) for r in got) == Counter((r[0], tuple(encode(r[1] or "")), decode(encode(r[1] or ""))) for r in rows())
    frame = bpe.encode(docs, path).select("doc_id", "ids", F.col("text").alias("was"))
    assert all(r["text"] == (r["was"] or "") for r in bpe.decode(frame, path).collect())
    assert bpe.encode(none, path).count() == 0


# language ID
def test_languages(spark, none):
    import random

    rnd = random.Random(2)
    kinds = {"en": ["the", "ing", "and", "tion", "wh"], "de": ["sch", "ein", "ung", "ü", "keit"], "fr": ["eau", "é", "que", "tion", "oi"]}
    rows = [(i, " ".join("".join(rnd.choices(kinds[k], k=rnd.randint(1, 4))) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 60)]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "en"), (902, "123 %%% 4", "de"), (903, "the", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d, crc_mod(F.col("doc_id"), 4) != 2).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == k for i, _, k in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d, F.lit(False)).collect()} == {"und"}


def test_binding_is_a_product_of_permuted_letters():
    a, b, c = langid.letter_vectors()
    grams, n = langid.ngrams("ab")
    codes = [(0, 1, 2), (1, 2, 0)]
    assert sorted(grams.tolist()) == sorted(x * langid.SYMBOLS**2 + y * langid.SYMBOLS + z for x, y, z in codes)
    assert np.array_equal(langid.bundle(grams, n), sum(a[x].astype(int) * b[y] * c[z] for x, y, z in codes))


# language-model scoring
def test_baseline_and_model(docs, none):
    d = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    got = lm.score(d, ~F.col("held_out"), frequent=5, keep=("held_out",)).collect()
    tokens = [(*[w.encode() for w in words(r[1])], "end") for r in rows()]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows()]
    c = Counter(t for ts, h in zip(tokens, held) for t in ts if not h)
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], h, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts, h in zip(rows(), tokens, held))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score(none, F.lit(True)).count() == 0
    untaught = lm.score(docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untaught} == {0} and len(untaught) == len(got)


def test_model_is_a_probability_and_learns():
    sample = [t.encode().lower() for t in texts(1) if t]
    lay = lm.Layout(sample)
    counts = [np.zeros(s + 1, dtype=np.int64) for z in lm.SIZES for s in z]
    for k in range(len(lm.ORDERS)):
        for half, at in enumerate(lay.cells(k)):
            at[lay.between()] = lm.SIZES[k][half]
            np.add.at(counts[2 * k + half], at, 1)
    tables = [[lm.packed(counts[2 * k + h][:-1]) for h in (0, 1)] for k in range(len(lm.ORDERS))]
    m = lm.Model(tables, lm.fit_weights(tables, sample[:10]))
    total = 0.0
    for c in range(256):
        one = lm.Layout([b"al" + bytes([c])])
        odds = m.odds(one)
        z = m.mixed(odds, lm.gates(one, odds)).reshape(-1, 8)
        total += math.exp(-np.log1p(np.exp(-z[2].astype(float))).sum())
    assert total == pytest.approx(1)
    fresh = [t.encode().lower() for t in texts(99) if t][:20]
    bits = -m.log10(fresh).sum() / math.log10(2) / sum(map(len, fresh))
    assert bits < 3.5
    assert m.log10(fresh) == pytest.approx(np.concatenate([m.log10([t]) for t in fresh]), rel=1e-4)


# license scan
def test_licenses(spark, none):
    body = " ".join(f"word{i}" for i in range(200))
    cases = {
        1: (f"{body}\nLicensed under the Apache License, Version 2.0.\n{body}", ["Apache-2.0"]),
        2: ("Released under the MIT License. All rights reserved.", ["MIT", "all-rights-reserved"]),
        3: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        4: ("This work was licensed under the GNU General Public License version 3", ["GPL-3.0"]),
        5: ("Licensed under the Apache License, Version 1.1.", []),
        6: ("My driving license is under the seat and all rights are reserved for Rita.", []),
        7: (None, []),
        8: ("", []),
        9: ("Released under the MIT License.\n" * 40, ["MIT"] * 40),
    }
    d = spark.createDataFrame([(k, t, 0) for k, (t, _) in cases.items()], "doc_id long, text string, finds int")
    got = {r["doc_id"]: sorted(f["license"] for f in r["finds"]) for r in license_scan.licenses(d).collect()}
    assert got == {k: w for k, (_, w) in cases.items()}
    assert license_scan.licenses(none).count() == 0


def test_alignment():
    assert license_scan.align(["a", "b", "c"], ["x", "a", "b", "c", "y"])[:3] == (0, 1, 4)
    assert license_scan.align(["a", "b", "c"], ["a", "x", "c"])[0] == 1
