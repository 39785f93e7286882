"""What the operators spend on a byte or a window, told in sizes and calls instead of seconds."""

import random
import tracemalloc
from collections import Counter

import numpy as np
from helpers import texts

from syllabrook.llm import license_scan as ls
from syllabrook.llm import lm, suffix


def test_log_odds_are_weighed_without_a_wide_copy():
    n = 1 << 17
    rng = np.random.default_rng(1)
    odds, gate = rng.integers(-127, 128, (len(lm.ORDERS), n, 8), dtype=np.int8), rng.integers(0, lm.GATES, n)
    weights = rng.random((lm.GATES, len(lm.ORDERS), 8), dtype=np.float32) / 64
    tracemalloc.start()
    z = lm.mixed(odds, gate, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(z, np.einsum("knb,nkb->nb", odds, weights[gate]), atol=1e-4)
    assert peak < 64 * n  # eight floats a byte are the result


def test_a_step_follows_the_slope_of_each_gate():
    sample = [lm.escaped(t.encode().lower()) for t in texts(3) if t][:30]
    rng = np.random.default_rng(2)
    tables = [[rng.integers(0, 1 << 32, s, dtype=np.uint32) for s in pair] for pair in lm.SIZES]
    model = lm.Model(tables, lm.first_weights())
    lay = lm.Layout(sample)
    odds, w = model.odds(lay).astype(float), model.weights.astype(float)
    gate = lm.gates(lay, model.odds(lay))
    inside = np.ones(len(gate), dtype=bool)
    inside[lay.between()] = False
    seen = lm.step(model, sample, 0.5)
    for g in range(lm.GATES):
        at = np.flatnonzero(inside & (gate == g))
        assert seen[g] == len(at)
        x = odds[:, at]
        error = 1 / (1 + np.exp(np.clip((x * w[g][:, None]).sum(axis=0), -40, 40)))
        moved = 0.5 * lm.STEP**2 / np.sqrt(max(1, len(at)) * 64.0) * (x * error).sum(axis=1)
        assert np.allclose(model.weights[g], w[g] + moved, rtol=1e-3, atol=1e-4)


def test_words_before_are_of_the_same_text():
    rnd = random.Random(5)
    some = [b"".join(rnd.choice([b"a", b"bc", b" ", b"\n", b"  "]) for _ in range(rnd.randrange(12))) for _ in range(60)]
    whole, at = lm.Layout(some), lm.ORDERS.keys()
    for t, a, n in zip(some, whole.first, whole.size):
        for k in range(len(at)):
            assert np.array_equal(lm.Layout([t]).line[k][:n], whole.line[k][a : a + n])


def test_cells_are_emptied_before_they_are_full():
    cells, full = np.array([0, 250, 3], dtype=np.uint8), {}
    lm._add_up(cells[:2], np.zeros(1000, dtype=np.int64), full)
    assert int(cells[0]) + full[0] == 1000 and cells[1] == 250 and cells[2] == 3


def test_only_templates_that_may_hold_are_compressed_alone(monkeypatch):
    rnd, tried = random.Random(1), []
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) + " Released under the MIT License."

    class Counted:
        def __init__(self, compressor):
            self.compress = lambda raw: tried.append(raw) or compressor.compress(raw)

    all_of_them = [ls.Template(t.license, t.words, t.telling, Counted(t.compressor)) for t in ls._templates()]
    monkeypatch.setattr(ls, "_templates", lambda: all_of_them)
    assert [f.license for f in ls.scan(text)[1]] == ["MIT"]
    assert 0 < len(tried) < len(all_of_them)


def test_windows_beyond_one_call_are_looked_at(monkeypatch):
    monkeypatch.setattr(ls, "TOGETHER", 3)
    text = "Released under the MIT License. " + "so many plain words here " * 60 + "Licensed under CC BY 4.0."
    assert [f.license for f in ls.scan(text)[1]] == ["MIT", "CC-BY-4.0"]


def test_only_what_is_not_settled_is_sorted_again(monkeypatch):
    rng = np.random.default_rng(4)
    plain = np.append(rng.integers(1, 250, 60_000).astype(np.uint16), suffix.SEPARATOR)
    same = np.append(plain[:200], suffix.SEPARATOR).astype(np.uint16)
    count, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: count.append(len(x)) or argsort(x, *a, **k))
    suffix.suffix_array(plain)
    once = sum(count)
    count.clear()
    s = np.concatenate((plain, same))
    sa = suffix.suffix_array(s)
    assert sum(count) < 1.1 * once  # the copy takes more rounds, the rest does not
    flat = s.tolist()
    keys = [flat[i : i + suffix.DEPTH] for i in sa.tolist()]
    assert sorted(sa.tolist()) == list(range(len(s))) and all(a <= b for a, b in zip(keys, keys[1:]))


def test_cells_are_touched_once_for_all_their_places(monkeypatch):
    """Counts of sorted places are those of every place alone, and what is added is told once for equal places."""
    sample, rng, added = [lm.escaped(t.encode().lower()) for t in texts(4) if t], np.random.default_rng(3), []
    lay = lm.Layout(sample)
    inside = np.ones(len(lay.byte), dtype=bool)
    inside[lay.between()] = False
    plain = lm._add_up
    monkeypatch.setattr(lm, "_add_up", lambda cells, at, full, n=None: added.append(len(at)) or plain(cells, at, full, n))
    for k, (pair, bits) in enumerate(zip(lm.SIZES, lm.BITS)):
        before = [rng.integers(0, 100, s).astype(np.uint8) for s in pair]
        cells, full = [c.copy() for c in before], [{}, {}]
        places = lay.places(k, inside)
        lm._count_places(places.copy(), bits[1], cells, full)
        assert added.pop() == len(np.unique(places)) < len(places)
        for half, at in enumerate(lay.cells(k)):
            want, got = before[half].astype(np.int64), cells[half].astype(np.int64)
            np.add.at(want, at[inside], 1)
            for i, n in full[half].items():
                got[i] += n
            assert np.array_equal(got, want)


def test_steps_that_share_a_layout_are_those_of_each_group():
    sample, rng = [lm.escaped(t.encode().lower()) for t in texts(6) if t][:30], np.random.default_rng(4)
    tables = [[rng.integers(0, 1 << 32, s, dtype=np.uint32) for s in pair] for pair in lm.SIZES]
    groups, rates = [sample[:5], sample[5:6], sample[6:]], [0.5, 0.2, 0.1]
    one, all_of_them = lm.Model(tables, lm.first_weights()), lm.Model(tables, lm.first_weights())
    seen = sum(lm.step(one, g, r) for g, r in zip(groups, rates))
    assert np.array_equal(lm.steps(all_of_them, groups, rates), seen)
    assert np.allclose(all_of_them.weights, one.weights, rtol=1e-5, atol=1e-7)


def test_log_odds_of_counts_beyond_the_table():
    counts = np.zeros((3, 16), dtype=np.int64)
    counts[1], counts[2, 3] = np.arange(16) ** 4, 1 << 40
    got = lm.packed(counts).view(np.int8).reshape(3, 16, 4)
    for line, c in enumerate(counts):
        for cell in range(16):
            for bit in range(4):
                node, width = cell >> (4 - bit), 16 >> bit
                a, b = c[node * width : node * width + width // 2].sum(), c[node * width + width // 2 : (node + 1) * width].sum()
                odds = np.clip(np.rint(np.log((b + 0.4) / (a + 0.4)) / lm.STEP), -127, 127)
                assert got[line, cell, bit] == (odds if cell >> (3 - bit) & 1 else -odds)


def test_words_of_texts_are_found_together():
    rnd = random.Random(7)
    some = ["".join(rnd.choice(" \t\n\x0b\x0c\r\x1c\x1f\x00\x85\xa0abcé") for _ in range(rnd.randrange(12))).encode() for _ in range(400)]
    words, n = lm.words_of(some)
    assert words.to_pylist() == [w for t in some for w in t.split()] and n.tolist() == [len(t.split()) for t in some]
    merged, n = lm._merged([(words, np.ones(len(words), dtype=np.int64)), (words[:5], np.full(5, 7))])
    want = Counter([w for t in some for w in t.split()])
    for w in words[:5].to_pylist():
        want[w] += 7
    assert dict(zip(merged.to_pylist(), n.tolist())) == want and len(merged) == len(want)
