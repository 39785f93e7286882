"""Tables of the scored model beyond what a worker may hold: counted in runs, read from a file that workers share."""

import math
import os
import pickle
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import DOCS, texts
from pyspark.sql import functions as F

from syllabrook.llm import lm

GB6 = lm.bits_for(int(8.6e9))  # 6 GB of documents in Parquet hold about 10 GB of text, six sevenths of which teach


def total(parts):
    got = {}
    for r in parts.filter("kind >= 0").collect():
        at, n = lm._received(bytes(r["x"]))
        for c, m in zip(at.tolist(), n.tolist()):
            got[r["kind"], c] = got.get((r["kind"], c), 0) + m
    return got


@pytest.mark.parametrize("most", [1_000, 6_000_000])
def test_runs_count_what_cells_count(spark, monkeypatch, most):
    bits = [tuple(min(b + 3, m) for b, m in zip(p, lm.ALL_LINES.get(k, (60, 60)))) for k, p in lm.ORDERS.items()]
    docs = spark.createDataFrame([(t,) for t in texts(5) if t] * 2, "text string").repartition(2)
    monkeypatch.setattr(lm, "IN_MEMORY", 1 << 40)
    want = total(lm._learn(docs, bits))
    monkeypatch.setattr(lm, "IN_MEMORY", 0)
    monkeypatch.setattr(lm, "RUNS", most)
    assert total(lm._learn(docs, bits)) == want


def test_counting_does_not_take_the_memory_of_the_tables():
    rnd = random.Random(4)
    sample = [" ".join(str(rnd.randrange(10**6)) for _ in range(200)).encode() for _ in range(60)]
    tracemalloc.start()
    runs, sent = lm.Runs(GB6, 200_000), 0
    for i in range(0, len(sample), 10):
        lay = lm.Layout(sample[i : i + 10], GB6)
        inside = np.ones(len(lay.byte), dtype=bool)
        inside[lay.between()] = False
        for k in range(len(lm.ORDERS)):
            runs.add(k, lay.places(k, inside))
        if runs.full():
            sent += sum(int(n.sum()) for _, _, n in runs.sent())
    sent += sum(int(n.sum()) for _, _, n in runs.sent())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 12 * sum(len(t) + 1 for t in sample)
    assert peak < 64 << 20 < 2 * sum(map(sum, lm.sizes_of(GB6))) // 8


def blocks_of(counts, bits):
    """Compressed blocks of the odds of counts by table, as ``_odds`` makes them."""
    import zstandard

    width, out = lm.block_bits(bits), []
    for k, cells in counts.items():
        size = [s for pair in lm.sizes_of(bits) for s in pair][k]
        for b in sorted({c >> width for c in cells}):
            part = np.zeros(1 << width, dtype=np.int64)
            for c, n in cells.items():
                if c >> width == b:
                    part[c & (len(part) - 1)] = n
            out.append((k << 40 | b, zstandard.ZstdCompressor().compress(lm.nodes_of(lm.packed(part)))))
            assert max(cells) < size
    return out


def test_large_tables_are_one_file_that_workers_map(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    flat = [s for pair in lm.sizes_of(GB6) for s in pair]
    rng = np.random.default_rng(2)
    counts = {k: {int(c): int(n) for c, n in zip(rng.integers(0, s, 3), rng.integers(1, 99, 3))} | {s - 1: 7} for k, s in enumerate(flat)}
    blocks = blocks_of(counts, GB6)
    first = lm.Sent(bits=GB6)
    second, unread = pickle.loads(pickle.dumps(first)), SimpleNamespace(value=list(blocks))  # as another worker has it
    tracemalloc.start()
    with first.opened([SimpleNamespace(value=blocks[:9]), SimpleNamespace(value=blocks[9:])]) as tables, second.opened([unread]) as same:
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(os.listdir(tmp_path)) == 1 and unread.value == blocks
        assert not any(x.flags.writeable for pair in tables for x in pair)
        assert peak < 64 << 20 < 2 * sum(flat) // 8  # bytes of all tables are twice the cells
        for k, cells in counts.items():
            for c in cells:
                line = c & ~15
                want = lm.packed(np.array([cells.get(line + i, 0) for i in range(16)]))[1::2]
                for t in (tables, same):
                    assert np.array_equal(t[k // 2][k % 2][line // 2 : line // 2 + 8], want)
    assert os.listdir(tmp_path) == []
    assert tables[0][0][counts[0].popitem()[0] // 2] is not None  # still mapped without a name


def test_a_file_that_was_left_unfinished_is_made_again(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(lm, "IN_MEMORY", 0)
    sent = lm.Sent(bits=lm.BITS)
    (tmp_path / sent.name).write_bytes(b"\xff" * 1000)
    with sent.opened([SimpleNamespace(value=blocks_of({3: {40: 9}}, lm.BITS))]) as tables:
        assert not tables[0][0].any() and np.array_equal(tables[1][1][16:24], lm.packed(np.eye(16, dtype=int)[8] * 9)[1::2])


def test_half_of_the_cells_tell_the_others():
    sample, rng = [lm.escaped(t.encode().lower()) for t in texts(3) if t][:30], np.random.default_rng(6)
    whole = [[lm.packed(rng.integers(0, 4, s) * rng.integers(0, 300, s)) for s in pair] for pair in lm.SIZES]
    halved = [[lm.halved(lm.nodes_of(x)) for x in pair] for pair in whole]
    assert all(np.array_equal(x[1::2], y) for pair, other in zip(whole, halved) for x, y in zip(pair, other))
    lay = lm.Layout(sample)
    assert np.array_equal(lm.Model(halved, lm.first_weights()).odds(lay), lm.Model(whole, lm.first_weights()).odds(lay))


def test_scores_do_not_depend_on_where_tables_are(spark, monkeypatch):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts(9))]
    docs = spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")
    monkeypatch.setattr(lm, "GROW_FROM", 14)
    monkeypatch.setattr(lm, "SENT", 1 << 16)  # several pieces
    scores = []
    for size in (1 << 40, 0):
        monkeypatch.setattr(lm, "IN_MEMORY", size)
        scores.append({r["doc_id"]: r["score"] for r in lm.score(docs, F.col("doc_id") % 3 > 0).collect()})
    assert len(scores[0]) == len(rows) and all(math.isclose(x, scores[1][i], rel_tol=1e-6) for i, x in scores[0].items())
