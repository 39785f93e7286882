"""Language-model scoring: a bit-wise context-mixing model beside a word-count baseline.

The model predicts each byte of the lower-cased text, and an end sign after it, bit by bit. Six predictors
look up contexts (the last byte, the last two, four and six, the current word so far, and that with the word
before it), each in a line of sixteen counts for either half of the byte; both halves' predictions are log
odds. Mixing weights, chosen by bit position and by the kind of the last byte (a gate), combine them in the
logistic domain, and within a text the mixed log odds are refined: each part of ``CHUNK`` bytes is scaled by
one Newton step from how well the parts before it were predicted. Beside its bytes each whole word is predicted by
its share of all training words, with a weight that follows how well either way did in the text so far. The sum
is the log probability of the text.

Counts come from all training texts, in tables whose lines grow with the bytes of these texts (the contexts
of one and two bytes have all the lines they can use). Tables of up to ``IN_MEMORY`` bytes are counted and kept in
memory by each worker. Beyond that a worker counts in sorted runs, which it sends on before they take more than a
fixed memory, and the workers of an executor read the finished tables from one file on their local disk, which they
map: it is the system that keeps what it can of the file, and no worker's memory grows with the input. The mixing
weights are learned on all training texts as well: texts are dealt in two folds by their hash, and each fold's texts
are predicted from the counts of the other, in one online pass for each partition; the passes are averaged by the
bytes that each gate has seen.

The baseline adds up log10((c + 1) / (N + V + 1)) over words and the end token. Counts of the
``FREQUENT`` most frequent words are at hand in each worker; the rest are looked up by an exact join.

Cases: a null text counts as empty: one token, the end. Repeated rows count as often as they occur. A null
id counts as the empty text when rows are dealt. With no training text N and V are 0. Whole texts are used.
"""

from __future__ import annotations

import fcntl
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.llm.common import MADE, add_row_id, drop, give_back, powers, small_batches, stored

#: Contexts, and as powers of two the least lines for the first and for the second half of a byte.
ORDERS = {"last": (8, 14), "two": (16, 17), "four": (17, 18), "six": (17, 18), "word": (18, 19), "pair": (17, 18)}
BITS = list(ORDERS.values())
#: Lines of a context that has no more; training bytes (a power of two) from which lines double with the bytes.
ALL_LINES, GROW_FROM = {"last": (8, 14), "two": (16, 20)}, 29
#: Cells of a block, as a power of two: more where tables have more lines, up to BLOCK_MORE powers.
BLOCK_BITS, BLOCK_MORE = 16, 4
#: Bytes of tables, or of their cells while they are counted, that a worker has in its own memory; places with counts that it has at most beyond that.
IN_MEMORY, RUNS = 160 << 20, 12_000_000
#: Log odds are kept as whole numbers from -127 to 127 of this size.
STEP = 1 / 16
#: Bytes of a part that is refined, of a step of the mixing weights and of a round of work; words at hand.
CHUNK, PIECE, ROUND, FREQUENT = 512, 1 << 14, 1 << 15, 1 << 18
#: Places of a context that are sorted before they are counted, so that a cell is touched once for all of them.
SORTED = 1 << 20
#: Rows that are weighed at a time: few enough to stay in a core's cache.
ROWS = 1 << 13
#: The longest word at hand; words that a task counts before it sends them; counts of a block that are added in one place.
AT_HAND, WORDS, ADDED = 64, 250_000, 64
#: Steps of the mixing weights whose texts are laid out together.
STEPS = 4
#: Blocks of counts that a task sends at once; bytes of blocks from which a piece of the tables is broadcast.
TOGETHER_SENT, SENT = 32, 8 << 20
#: Bytes that are scored together, so that arrays stay in a core's cache.
TOGETHER = 1 << 16
#: No word has white space in it.
END = b" end"
PAD = b"\x00" * 8
MIX = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, *range(9, 14), 0]] = True
#: How often each sign counts as having followed a word before the first one: the end, white space (fixed values).
SIGN_FIRST = np.zeros(256)
SIGN_FIRST[[32, 10, 0, 9, 11, 12, 13]] = (4, 0.5, 0.1, 0.1, 0.1, 0.1, 0.1)
#: The gate: white space or start, letter (a byte over 127 too), digit, other.
KIND = np.full(256, 3, dtype=np.int64)
GATES = 8
WORD_SO_FAR = list(ORDERS).index("word")
KIND[BLANK] = 0
KIND[[*range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
#: For each byte the signs of its bits' log odds where those of the last bit of either half are told in favour of a one.
LAST_BIT = np.ones((256, 8), dtype=np.int8)
LAST_BIT[(np.arange(256) & 16) == 0, 3] = LAST_BIT[(np.arange(256) & 1) == 0, 7] = -1


class Layout:
    """Texts one after another with zeros between them, and the contexts of every place.

    Place i of the arrays is byte i + 8 of the buffer; ``first`` and ``last_at`` bound each text with its end sign.
    """

    def __init__(self, texts: list[bytes], bits: list[tuple[int, int]] = BITS) -> None:
        self.bits = bits
        raw = PAD + PAD.join(texts) + PAD
        buf = np.frombuffer(raw, dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(size + 8) - size - 8
        self.size = size + 1  # with the end sign
        self.byte, self.last = buf[8:], buf[7:-1]
        # The eight bytes before each place; the last is the highest.
        before = np.ndarray(shape=(len(buf) - 8,), dtype="<u8", buffer=raw, strides=(1,)).copy()
        word, pair = self._words(buf)
        pair = pair[7:-1] * MIX + word[7:-1]
        line = [self.last.astype(np.uint64), before >> np.uint64(48)]
        for k, x in enumerate((before >> np.uint64(32), before >> np.uint64(16), word[7:-1], pair), 2):
            x = x * MIX
            x ^= x >> np.uint64(32)
            x *= MIX
            line.append(x >> np.uint64(64 - bits[k][0]))
        self.line = line

    def _words(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the whole word so far at each byte of the buffer (0 after white space), and of the word before it in the text."""
        at = np.flatnonzero(BLANK[buf])  # each begins a stretch: white space alone, or with the word after it
        n = np.diff(np.append(at, len(buf)))
        up, back = powers(len(buf))  # all modulo 2**64
        sums = np.cumsum(up * (buf + np.uint64(1)))
        word = sums - np.repeat(sums[at], n)
        word *= np.repeat(back[at], n)
        # The last stretch with a word before each one, if it is of the same text.
        stretch = np.arange(len(at))
        earlier = np.concatenate(([-1], np.maximum.accumulate(np.where(n > 1, stretch, -1))[:-1]))
        text = np.zeros(len(at), dtype=np.int64)
        first = np.searchsorted(at, self.first + 7)  # a text comes after white space
        text[first] = first
        text = np.maximum.accumulate(text)
        before = np.where(earlier >= text, word[(at + n - 1)[earlier]], np.uint64(0))
        return word, np.repeat(before, n)

    def cells(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where both halves of each byte are counted for context k."""
        return cells_of(self.line[k], self.byte, self.bits[k][1])

    def places(self, k: int, inside: np.ndarray) -> np.ndarray:
        """Line and byte as one number for context k, in as few bytes as hold it."""
        x = self.line[k] << np.uint64(8)
        x |= self.byte
        return x.astype(np.uint32 if self.bits[k][0] <= 24 else np.uint64)[inside]

    def between(self) -> np.ndarray:
        """Places after the end sign of a text, before the next one or the end."""
        return ((self.first + self.size)[:, None] + np.arange(7)).reshape(-1) if len(self.first) else np.zeros(0, dtype=np.int64)


def cells_of(line: np.ndarray, byte: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where both halves of each byte are counted, the second in one of 2**bits lines."""
    first = (line << np.uint64(4)) | (byte >> 4)
    second = first * MIX
    second >>= np.uint64(64 - bits)
    second <<= np.uint64(4)
    second |= byte & 15
    return first.view(np.int64), second.view(np.int64)


def sizes_of(bits: list[tuple[int, int]]) -> list[list[int]]:
    return [[1 << (b + 4) for b in pair] for pair in bits]


SIZES = sizes_of(BITS)


def bits_for(size: int) -> list[tuple[int, int]]:
    """The lines of each context for so many training bytes."""
    more = max(0, round(np.log2(max(size, 1))) - GROW_FROM)
    return [tuple(min(b + more, m) for b, m in zip(pair, ALL_LINES.get(name, (60, 60)))) for name, pair in ORDERS.items()]


def in_memory(bits: list[tuple[int, int]]) -> bool:
    """Whether tables of so many lines are counted in memory, with two bytes a cell; as log odds they take as much."""
    return 2 * sum(map(sum, sizes_of(bits))) <= IN_MEMORY


def block_bits(bits: list[tuple[int, int]]) -> int:
    """Cells of a block, as a power of two, for tables of so many lines."""
    return BLOCK_BITS + min(max(0, bits[WORD_SO_FAR][0] - BITS[WORD_SO_FAR][0]), BLOCK_MORE)


def packed(counts: np.ndarray) -> np.ndarray:
    """For each cell the log odds of its four bits, in favour of the bits that lead there, as four bytes."""
    c = counts.reshape(-1, 16)
    some = np.flatnonzero(c.any(axis=1))  # the rest are even
    out, c = np.zeros((len(c), 16), dtype=np.uint32), np.ascontiguousarray(c[some].T, dtype=np.int64)
    odds = np.empty((len(some), 16, 4), dtype=np.int8)
    for bit in range(3, -1, -1):
        logs = logs_of(c)
        width = 8 >> bit
        for node in range(1 << bit):
            x = np.clip(np.rint((logs[2 * node + 1] - logs[2 * node]) / STEP), -127, 127).astype(np.int8)
            odds[:, 2 * node * width : (2 * node + 1) * width, bit] = -x[:, None]
            odds[:, (2 * node + 1) * width : (2 * node + 2) * width, bit] = x[:, None]
        c = c[::2] + c[1::2]  # counts of the nodes above
    out[some] = odds.view(np.uint32)[:, :, 0]
    return out.reshape(-1)


#: Of the fifteen log odds of a line, in favour of ones, those of each second cell, and their signs there.
NODES = np.array([[0, 1 + (j >> 2), 3 + (j >> 1), 7 + j] for j in range(8)])
SIGNS = np.array([[1 if j & 4 else -1, 1 if j & 2 else -1, 1 if j & 1 else -1, 1] for j in range(8)], dtype=np.int8)


def nodes_of(cells: np.ndarray) -> bytes:
    """The fifteen log odds of each line, of which ``packed`` makes its cells."""
    x = cells.view(np.int8).reshape(-1, 16, 4)
    return np.concatenate((x[:, 9:10, 0], x[:, 5::8, 1], x[:, 3::4, 2], x[:, 1::2, 3]), axis=1).tobytes()


def halved(nodes: bytes) -> np.ndarray:
    """Each second cell from the log odds of lines."""
    x = np.frombuffer(nodes, dtype=np.int8).reshape(-1, 15).take(NODES, axis=1)
    x *= SIGNS
    return x.view(np.uint32).reshape(-1)


#: Logarithms of counts below so many.
LOGS = np.log(np.arange(1 << 12) + 0.4)


def logs_of(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts and 0.4."""
    out = LOGS.take(counts, mode="clip")
    large = counts >= len(LOGS)
    out[large] = np.log(counts[large] + 0.4)
    return out


class Model:
    """Tables of log odds for each cell, or for each second one: cells that differ in the last bit differ in its sign alone."""

    def __init__(self, tables: list[list[np.ndarray]], weights: np.ndarray, bits: list[tuple[int, int]] = BITS) -> None:
        self.tables, self.weights, self.bits = tables, weights, bits
        self.halved = len(tables[0][0]) < sizes_of(bits)[0][0]

    def odds(self, lay: Layout) -> np.ndarray:
        """(contexts, bytes, 8): log odds in favour of the bits that the text has; a byte's lie side by side."""
        out = np.empty((len(ORDERS), len(lay.byte), 2), dtype=np.uint32)
        for k in range(len(ORDERS)):
            for half, at in enumerate(lay.cells(k)):
                if self.halved:
                    at >>= 1
                out[k, :, half] = self.tables[k][half].take(at, mode="wrap")  # all are inside: spares the check
        odds = out.view(np.int8)
        if self.halved:
            odds *= LAST_BIT[lay.byte]
        return odds

    def log10(self, texts: list[bytes], words: list[np.ndarray] | None = None) -> np.ndarray:
        """The log10 probability of each text; ``words`` holds the share that each of its words has of all words, 0 if it is not at hand."""
        out, i = np.zeros(len(texts)), 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) < TOGETHER:
                size += len(texts[j])
                j += 1
            out[i:j] = self._log10(texts[i:j], words[i:j] if words is not None else None)
            i = j
        return out

    def _log10(self, texts: list[bytes], words: list[np.ndarray] | None) -> np.ndarray:
        lay = Layout(texts, self.bits)
        odds = self.odds(lay)
        z = self.mixed(odds, gates(lay, odds))
        # One Newton step for the scale of each part from all parts before it.
        q = np.exp(z)
        q += 1
        np.reciprocal(q, out=q)
        parts = -(-lay.size // CHUNK)
        own = np.repeat(np.arange(len(parts)), parts)
        begin = np.cumsum(parts) - parts
        cut = lay.first[own] + (np.arange(len(own)) - begin[own]) * CHUNK
        end = np.minimum(cut + CHUNK, (lay.first + lay.size)[own])
        ends = 8 * np.stack((cut, np.minimum(end, len(lay.byte) - 1)), axis=1).reshape(-1)
        q *= z
        slope = np.add.reduceat(q, ends)[::2].astype(np.float64)
        q *= z - q
        bend = np.add.reduceat(q, ends)[::2].astype(np.float64)
        total = lambda x: (c := np.cumsum(x) - x) - c[begin[own]]
        scale = np.clip(1 + total(slope) / (total(bend) + 50.0), 0.5, 2.0).astype(np.float32)
        z *= np.repeat(scale, 8 * np.diff(np.append(cut, len(lay.byte))))
        # 1 / p of each bit; four of them stay within the range of a float.
        np.clip(z, -20, 20, out=z)
        np.exp(np.negative(z, out=z), out=z)
        z += 1
        z = z[::2] * z[1::2]
        z = np.log(z[::2] * z[1::2])
        cost = np.append((z[::2] + z[1::2]).astype(np.float64), 0.0)
        bounds = np.stack((lay.first, lay.first + lay.size), axis=1).reshape(-1)
        total = -np.add.reduceat(cost, bounds)[::2]
        return (total + by_words(lay, cost, words) if words is not None else total) / np.log(10)

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The weighted log odds of all bits in a row."""
        return mixed(odds, gate, self.weights).reshape(-1)


def by_words(lay: Layout, cost: np.ndarray, shares: list[np.ndarray]) -> np.ndarray:
    """What each text gains, as a natural logarithm, where whole words are predicted by their share of all words beside their bytes.

    Both ways predict a word with the sign after it. Their weights follow from the words of the text so far, as does
    the share of each such sign in the second way; a word that is not at hand has its bytes alone.
    """
    blank = BLANK[lay.byte]
    start, end = np.flatnonzero(~blank[1:] & blank[:-1]) + 1, np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    if len(lay.byte) and not blank[0]:
        start = np.concatenate(([0], start))
    n = np.array([len(x) for x in shares], dtype=np.int64)
    first = np.cumsum(n) - n
    if not n.sum():
        return np.zeros(len(n))
    share = np.concatenate(shares)
    text = np.repeat(np.arange(len(n)), n)
    before = np.arange(len(share)) - first[text]
    # The sign after the word: how often it has followed words of this text, and all signs.
    sign = lay.byte[end].astype(np.int64)
    key = text * 256 + sign
    key = key.astype(np.uint16) if len(n) <= 256 else key  # short numbers are sorted faster
    order = np.argsort(key, kind="stable")
    key = key[order]
    run = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    seen = np.empty(len(share), dtype=np.int64)
    seen[order] = np.arange(len(share)) - np.repeat(run, np.diff(np.append(run, len(share))))
    follows = (seen + SIGN_FIRST[sign]) / (before + SIGN_FIRST.sum())
    sums = np.concatenate(([0.0], np.cumsum(cost)))
    bytes_ = sums[end + 1] - sums[start]
    with np.errstate(divide="ignore"):
        better = np.minimum(bytes_ + np.log(share) + np.log(follows), 500.0)  # minus infinity without the word
    weight = np.full(len(share), 0.5)
    for _ in range(3):  # each from what came before alone
        likely = 1 / (1 + (1 / weight - 1) * np.exp(-better))
        so_far = np.cumsum(likely) - likely
        weight = (so_far - so_far[first[text]] + 0.5) / (before + 2)
    return np.bincount(text, weights=np.log(1 - weight + weight * np.exp(better)), minlength=len(n))


def gates(lay: Layout, odds: np.ndarray) -> np.ndarray:
    """The set of weights for each byte: the kind of the last byte, and whether the word so far is known."""
    return KIND[lay.last] + 4 * (odds[WORD_SO_FAR][:, 0] == 0)


def mixed(odds: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(bytes, 8): the weighted log odds, kept within what floats can tell from 0 and 1."""
    z, by_context = np.zeros((len(gate), 8), dtype=np.float32), np.ascontiguousarray(weights.transpose(1, 0, 2))
    for a in range(0, len(gate), ROWS):
        g, out = gate[a : a + ROWS], z[a : a + ROWS]
        for x, w in zip(odds, by_context):
            own = w.take(g, axis=0, mode="clip")
            own *= x[a : a + ROWS]
            out += own
        np.clip(out, -40, 40, out=out)
    return z


def first_weights() -> np.ndarray:
    return np.full((GATES, len(ORDERS), 8), STEP * 1.2 / len(ORDERS), dtype=np.float32)


def step(model: Model, texts: list[bytes], rate: float) -> np.ndarray:
    """One online step of the model's weights (gate, context, bit), which follow the error on these texts; the bytes of each gate."""
    return steps(model, [texts], [rate])


def steps(model: Model, groups: list[list[bytes]], rates: list[float]) -> np.ndarray:
    """A step for each group of texts, which are laid out together; the bytes of each gate."""
    lay = Layout([t for g in groups for t in g], model.bits)
    odds = model.odds(lay)
    gate = gates(lay, odds).astype(np.int8)
    gate[lay.between()] = GATES  # not part of a text
    ends = np.append(lay.first, len(gate))[np.cumsum([len(g) for g in groups])]
    return sum((_step(model, odds[:, a:b], gate[a:b], rate) for a, b, rate in zip([0, *ends], ends, rates)), np.zeros(GATES, dtype=np.int64))


def _step(model: Model, odds: np.ndarray, gate: np.ndarray, rate: float) -> np.ndarray:
    n = np.bincount(gate, minlength=GATES + 1)
    # The places in the order of their gates, so that a gate's are one run.
    order = np.argsort(gate, kind="stable")[: len(gate) - n[GATES]]
    gate, rows = gate[order].astype(np.int64), np.empty((len(ORDERS), len(order)), dtype=np.uint64)
    for x, out in zip(odds.view(np.uint64)[:, :, 0], rows):
        x.take(order, out=out, mode="clip")
    odds = rows.view(np.int8).reshape(len(ORDERS), len(order), 8)
    error = mixed(odds, gate, model.weights)
    np.exp(error, out=error)
    error += 1
    np.reciprocal(error, out=error)
    slope, ends = np.zeros((len(ORDERS), GATES, 8), dtype=np.float32), np.cumsum(n)
    one = np.ones(ROWS, dtype=np.float32)
    for g in np.flatnonzero(n[:GATES]):
        for a in range(ends[g] - n[g], ends[g], ROWS):
            b = min(a + ROWS, ends[g])
            for k in range(len(ORDERS)):
                slope[k, g] += one[: b - a] @ (error[a:b] * odds[k, a:b])
    for g in np.flatnonzero(n[:GATES]):
        model.weights[g] += (rate * STEP * STEP / np.sqrt(n[g] * 64.0) * slope[:, g]).astype(np.float32)
    return n[:GATES]


def fit_weights(tables: list[list[np.ndarray]], texts: list[bytes], bits: list[tuple[int, int]] = BITS) -> np.ndarray:
    """Online logistic mixing on a few texts, again and again."""
    model = Model(tables, first_weights(), bits)
    for rate in (0.1, 0.05, 0.02, 0.01):
        for i in range(0, len(texts), 4):
            step(model, texts[i : i + 4], rate)
    return model.weights


def _fit(texts: DataFrame, tables: "Sent | list[list[np.ndarray]]", bits: list[tuple[int, int]]) -> DataFrame:
    """(g, i, n, w): each partition's weights after an online pass over all its texts, and the bytes that each gate has seen."""
    tables = tables if isinstance(tables, Sent) else Sent(tables)
    sent, pieces = texts.sparkSession.sparkContext.broadcast(tables), tables.pieces

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sent.value.opened(pieces) as tables:
            yield from passed(batches, tables)
        give_back()

    def passed(batches: Iterator[pd.DataFrame], tables: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
        model = Model(tables, first_weights(), bits)
        seen, groups, size, done = np.zeros(GATES, dtype=np.int64), [[]], 0, 0

        def learn() -> None:
            nonlocal groups, done, seen
            if done == 0:  # the first texts more often, for partitions with few of them
                for rate in (0.1, 0.05):
                    for i in range(0, len(groups[0]), 4):
                        step(model, groups[0][i : i + 4], rate)
            groups = [g for g in groups if g]
            seen = seen + steps(model, groups, [max(0.01, 0.1 / (1 + (done + i) / 25)) for i in range(len(groups))])
            done += len(groups)
            groups = [[]]

        for df in batches:
            for text in df["text"]:
                groups[-1].append(escaped(_bytes(text)))
                size += len(groups[-1][-1])
                if size >= PIECE:
                    size = 0
                    if len(groups) == STEPS:
                        learn()
                    else:
                        groups.append([])
        if groups[0]:
            learn()
        for g in np.flatnonzero(seen):
            w = model.weights[g].reshape(-1).astype(float)
            yield pd.DataFrame({"g": int(g), "i": np.arange(len(w)), "n": int(seen[g]), "w": w})

    out = stored(texts.select("text").mapInPandas(run, "g int, i int, n long, w double"))
    for x in (sent, *pieces):
        x.destroy()
    return out


def _averaged(fits: DataFrame) -> np.ndarray:
    """Weights of all partitions' passes, averaged by bytes."""
    w = first_weights().reshape(GATES, -1)
    for r in fits.groupBy("g", "i").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w")).collect():
        w[r["g"], r["i"]] = r["w"]
    return w.reshape(GATES, len(ORDERS), 8)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8").lower() if text else b""


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after another, and how many each text has."""
    found = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    n, words = np.diff(found.offsets.to_numpy()), found.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # none before or after white space at an end
    at = np.cumsum(n)
    kept = np.concatenate(([0], np.cumsum(real)))
    return words.filter(pa.array(real)).cast(pa.large_binary()), kept[at] - kept[at - n]


def _merged(counted: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Each word once, with the sum of its counts."""
    if not counted:
        return pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64)
    words = pa.concat_arrays([w for w, _ in counted]).dictionary_encode()
    n = np.zeros(len(words.dictionary), dtype=np.int64)
    np.add.at(n, words.indices.to_numpy().astype(np.int64), np.concatenate([n for _, n in counted]))
    return words.dictionary, n


def escaped(text: bytes) -> bytes:
    """What the model reads of a text: the zero byte is the end sign alone, so it and the escape sign are spelled with two bytes."""
    return text.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x03") if b"\x00" in text or b"\x01" in text else text


def _learn(train: DataFrame, bits: list[tuple[int, int]]) -> DataFrame:
    """(kind, word, n, x) of the training texts: counts of words, and of context cells in compressed blocks."""
    width, sizes, at_most = block_bits(bits), sizes_of(bits), RUNS
    block, dense = 1 << width, in_memory(bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[tuple[pa.Array, np.ndarray]] = []
        cells = [np.zeros(s, dtype=np.uint16) for pair in sizes for s in pair] if dense else []
        runs = Runs(bits, at_most)
        full: list[dict[int, int]] = [{} for _ in cells]  # what the cells could not hold
        waiting: list[bytes] = []
        places: list[list[np.ndarray]] = [[] for _ in ORDERS]
        size = found = n_words = n_texts = 0

        def add_words(texts: list[bytes]) -> None:
            nonlocal n_words, n_texts
            counted = pc.value_counts(words_of(texts)[0])
            words.append((counted.field("values"), counted.field("counts").to_numpy()))
            n_words, n_texts = n_words + len(counted), n_texts + len(texts)
            if n_words > 2 * WORDS:
                words[:] = [_merged(words)]
                n_words = len(words[0][0])

        def add(last: bool = False) -> None:
            nonlocal found
            if waiting:
                lay = Layout(waiting, bits)
                inside = np.ones(len(lay.byte), dtype=bool)
                inside[lay.between()] = False
                for k, some in enumerate(places):
                    some.append(lay.places(k, inside))
                found += len(some[-1])
                waiting.clear()
            if found >= SORTED or last and found:
                for k, some in enumerate(places):
                    at = np.concatenate(some)
                    some.clear()
                    if dense:
                        _count_places(at, bits[k][1], cells[2 * k : 2 * k + 2], full[2 * k : 2 * k + 2])
                    else:
                        runs.add(k, at)
                found = 0

        def spill() -> pd.DataFrame:
            nonlocal n_words, n_texts
            if n_texts:
                words.append((pa.array([END], pa.large_binary()), np.array([n_texts])))
            word, n = _merged(words)
            words.clear()
            n_words = n_texts = 0
            return pd.DataFrame({"kind": -1, "word": word.to_pandas(), "n": n, "x": None})

        def held() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for k, (c, more) in enumerate(zip(cells, full)):
                more_at = np.array(sorted(more), dtype=np.int64)
                for b in range(0, len(c), block):
                    part = c[b : b + block]
                    beyond = more_at[slice(*np.searchsorted(more_at, (b, b + len(part))))].tolist()
                    if beyond:
                        part = part.astype(np.int64)
                    for at in beyond:
                        part[at - b] += more[at]
                    at = np.flatnonzero(part)
                    yield k, at + b, part[at]

        for df in batches:
            texts = [_bytes(t) for t in df["text"]]
            add_words(texts)
            for t in texts:
                waiting.append(escaped(t))
                size += len(t)
                if size > ROUND:
                    add()
                    size = 0
                    if runs.full():
                        yield from _blocks(runs.sent(), width)
            if len(words) == 1 and n_words > WORDS:
                yield spill()
        add(last=True)
        yield spill()
        yield from _blocks(runs.sent() if not dense else held(), width)
        give_back()

    return train.select("text").mapInPandas(count, "kind long, word binary, n long, x binary")


def _count_places(places: np.ndarray, bits: int, cells: list[np.ndarray], full: list[dict[int, int]]) -> None:
    """Counts places of a context (line and byte as one number) in the cells of both halves."""
    places, n = _counted(places)
    first, second = cells_of((places >> 8).astype(np.uint64), places.astype(np.uint8), bits)
    start = _starts(first)  # sorted as the places are
    _add_once(cells[0], first[start], full[0], np.add.reduceat(n, start))
    _add_up(cells[1], second, full[1], n)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each value of sorted ones begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _counted(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place once, in order, and how often it occurs; ``places`` are sorted where they lie."""
    places.sort()
    start = _starts(places)
    return places[start], np.diff(start, append=len(places))


def _summed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, in order, and the sum of its counts."""
    order = np.argsort(at, kind="stable")  # made for runs that are sorted
    at = at[order]
    start = _starts(at)
    return at[start], np.add.reduceat(n[order], start, dtype=np.int64)


class Runs:
    """Places of each context with their counts (four bytes), as sorted runs in a memory that does not follow the size of the tables."""

    def __init__(self, bits: list[tuple[int, int]], most: int) -> None:
        self.bits, self.most, self.size, self.read = bits, most, 0, 0
        self.runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in bits]

    def add(self, k: int, places: np.ndarray) -> None:
        at, n = _counted(places)
        self.runs[k].append((at, n.astype(np.uint32)))
        self.size += len(at)
        self.read += int(n.sum())
        if self.size > self.most:
            for some in self.runs:
                if len(some) > 1:
                    at, n = _summed(*map(np.concatenate, zip(*some)))
                    some[:] = [(at, n.astype(np.uint32))]
            self.size = sum(len(at) for some in self.runs for at, _ in some)

    def full(self) -> bool:
        """Whether merging makes too little room, or a count may come to have more than four bytes."""
        return self.size > self.most * 3 // 4 and all(len(some) < 2 for some in self.runs) or self.read >= 1 << 31

    def sent(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, cells, counts) of all runs, which are given up."""
        for k, some in enumerate(self.runs):
            if not some:
                continue
            places, n = _summed(*map(np.concatenate, zip(*some)))
            some.clear()
            first, second = cells_of((places >> 8).astype(np.uint64), places.astype(np.uint8), self.bits[k][1])
            del places
            start = _starts(first)
            yield 2 * k, first[start], np.add.reduceat(n, start, dtype=np.int64)
            del first, start
            yield 2 * k + 1, *_summed(second, n)
        self.size = self.read = 0


def _blocks(counted: Iterator[tuple[int, np.ndarray, np.ndarray]], width: int) -> Iterator[pd.DataFrame]:
    """Rows for the blocks of so many cells (a power of two) that sorted cells of a table fall into, several at a time."""
    kinds: list[int] = []
    sent: list[bytes] = []

    def some() -> pd.DataFrame:
        out = pd.DataFrame({"kind": kinds, "word": None, "n": 0, "x": sent})
        kinds.clear(), sent.clear()
        return out

    for k, at, n in counted:
        if not len(at):
            continue
        block = at >> width
        start = _starts(block)
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(at)]):
            kinds.append(k << 40 | int(block[a]))
            sent.append(_sent(at[a:b] & ((1 << width) - 1), n[a:b]))
            if len(sent) == TOGETHER_SENT:
                yield some()
    if sent:
        yield some()


def _add_once(cells: np.ndarray, at: np.ndarray, full: dict[int, int], n: np.ndarray) -> None:
    """``n`` more for places that are all different; cells that are more than half full are emptied into ``full``."""
    n = n + cells[at]
    large = n > int(np.iinfo(cells.dtype).max) // 2
    for k, m in zip(at[large].tolist(), n[large].tolist(), strict=True):
        full[k] = full.get(k, 0) + m
    n[large] = 0
    cells[at] = n


def _add_up(cells: np.ndarray, at: np.ndarray, full: dict[int, int], n: np.ndarray | None = None) -> None:
    """``n`` more (or one) for each place; cells that are more than half full are emptied into ``full``."""
    half = int(np.iinfo(cells.dtype).max) // 2
    n = np.ones(len(at), dtype=np.int64) if n is None else n
    large = n > half
    if large.any():
        for k, m in zip(at[large].tolist(), n[large].tolist(), strict=True):
            full[k] = full.get(k, 0) + m
        at, n = at[~large], n[~large]
    total, n, i = np.cumsum(n), n.astype(cells.dtype), 0
    while i < len(at):  # as many as cannot overflow a cell, even if all are its own
        j = int(np.searchsorted(total, half + (total[i - 1] if i else 0), side="right"))
        part = at[i:j]
        np.add.at(cells, part, n[i:j])
        for k in set(part[cells[part] > half].tolist()):
            full[k] = full.get(k, 0) + int(cells[k])
            cells[k] = 0
        i = j


def _sent(at: np.ndarray, n: np.ndarray) -> bytes:
    """Cells of a block and their counts: distances and counts byte by byte, most of which are small."""
    import zstandard

    far = np.diff(at, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(at), -1).T).tobytes() for x in (far, n.astype("<u8"))))


def _received(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8).reshape(12, -1)
    far, n = np.ascontiguousarray(planes[:4].T).view("<u4"), np.ascontiguousarray(planes[4:].T).view("<u8")
    return np.cumsum(far.reshape(-1), dtype=np.int64), n.reshape(-1).astype(np.int64)


def _added(parts: DataFrame, width: int = BLOCK_BITS, once: bool = False) -> DataFrame:
    """(kind, fold, x): counts of a block added up in rounds (``once``: one at least), so that no task reads what all tasks have sent for one."""
    before: list[str] = []

    def add(at: tuple, df: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << width, dtype=np.int64)
        for x in df["x"]:
            cells, n = _received(x)
            total[cells] += n
        cells = np.flatnonzero(total)
        return pd.DataFrame({"kind": [at[0]], "fold": [at[1]], "x": [_sent(cells, total[cells])]})

    while (most := parts.groupBy("kind", "fold").count().agg(F.max("count")).first()[0] or 0) > ADDED or once:
        some = F.pmod(F.xxhash64("x"), F.lit(max(1, -(-most * 2 // ADDED))))
        parts, once = stored(parts.groupBy("kind", "fold", some).applyInPandas(lambda at, df: add(at, df), "kind long, fold int, x binary")), False
        drop(parts.sparkSession, before)
        before = MADE[-1:]
    return parts


def _added_fold(parts: DataFrame, fold: int, width: int) -> DataFrame:
    """What the tasks of a fold have sent, added up and stored, while theirs is deleted: it is much more, and the other fold has as much."""
    spark, sent = parts.sparkSession, MADE[-1:]
    words = stored(parts.filter("kind = -1").groupBy(F.lit(-1).cast("long").alias("kind"), "word").agg(F.sum("n").alias("n")))
    cells = _added(parts.filter("kind >= 0").select("kind", F.lit(fold).alias("fold"), "x"), width, once=True)
    drop(spark, sent)
    _sweep(spark)
    return words.unionByName(cells.drop("fold"), allowMissingColumns=True)


def _sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffles of what is stored by now, which it does once the driver's JVM has collected their plans."""
    spark._jvm.System.gc()


def _odds(parts: DataFrame, width: int) -> DataFrame:
    """(kind, fold0, fold1, both): the log odds of each block's lines, from the counts of either fold and from all."""

    def add(at: tuple, df: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        total = np.zeros((2, 1 << width), dtype=np.int64)
        for fold, x in zip(df["fold"], df["x"], strict=True):
            cells, n = _received(x)
            total[fold, cells] += n
        odds = [zstandard.ZstdCompressor(level=1).compress(nodes_of(packed(c))) for c in (total[0], total[1], total[0] + total[1])]
        return pd.DataFrame({"kind": [at[0]], "fold0": odds[:1], "fold1": odds[1:2], "both": odds[2:]})

    return parts.groupBy("kind").applyInPandas(add, "kind long, fold0 binary, fold1 binary, both binary")


class Sent:
    """Tables whose compressed blocks travel in pieces and are unpacked where they are used, large ones into a file that is mapped.

    The file is made by the first worker of an executor that needs it, while the others wait for its lock and then read
    no piece. It loses its name when a worker's first use ends and lasts as long as someone maps it.
    """

    def __init__(self, tables: list[list[np.ndarray]] | None = None, bits: list[tuple[int, int]] = BITS, pieces: list[Broadcast] | None = None) -> None:
        self.unpacked, self.bits, self.pieces, self.path = tables, bits, pieces or [], ""
        self.sizes = [[s // 2 for s in pair] for pair in sizes_of(bits)]
        self.name = "" if in_memory(bits) else f"syllabrook-{uuid.uuid4().hex}"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": []}  # broadcast each by itself

    @contextmanager
    def opened(self, pieces: list[Broadcast]) -> Iterator[list[list[np.ndarray]]]:
        try:
            if self.unpacked is None:
                self.unpacked = self._split(self._mapped(pieces) if self.name else self._in_memory(pieces))
            yield self.unpacked
        finally:
            if self.path:
                with suppress(FileNotFoundError):
                    os.unlink(self.path)
                self.path = ""

    def _split(self, whole: np.ndarray) -> list[list[np.ndarray]]:
        ends = np.cumsum([s for pair in self.sizes for s in pair])
        tables = np.split(whole, ends[:-1])
        return [tables[i : i + 2] for i in range(0, len(tables), 2)]

    def _parts(self, pieces: list[Broadcast]) -> Iterator[tuple[int, np.ndarray]]:
        """Where each block begins, counted in entries of all tables, and its entries; one piece is in memory at a time."""
        import zstandard

        flat = [s for pair in self.sizes for s in pair]
        first, width = np.cumsum([0, *flat]).tolist(), block_bits(self.bits) - 1
        for piece in pieces:
            for kind, x in piece.value:
                k, b = divmod(kind, 1 << 40)
                yield first[k] + (b << width), halved(zstandard.ZstdDecompressor().decompress(x))[: flat[k] - (b << width)]
            vars(piece).pop("_value", None)  # is read again where it is needed again

    def _in_memory(self, pieces: list[Broadcast]) -> np.ndarray:
        whole = np.zeros(sum(map(sum, self.sizes)), dtype=np.uint32)
        for at, x in self._parts(pieces):
            whole[at : at + len(x)] = x
        return whole

    def _mapped(self, pieces: list[Broadcast]) -> np.ndarray:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # of this executor; Spark removes it
        self.path = os.path.join(folder if os.path.isdir(folder) else tempfile.gettempdir(), self.name)
        size = 4 * sum(map(sum, self.sizes))
        with os.fdopen(os.open(self.path, os.O_RDWR | os.O_CREAT, 0o600), "r+b") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            if os.fstat(f.fileno()).st_size <= size:  # one byte more says that it is whole
                f.truncate(0)  # nothing stays of what an ended worker has left
                f.truncate(size)
                for at, x in self._parts(pieces):
                    f.seek(4 * at)
                    f.write(x)
                f.flush()
                f.truncate(size + 1)
            whole = np.asarray(np.memmap(f, dtype=np.uint32, mode="r", shape=(size // 4,)))
            fcntl.flock(f, fcntl.LOCK_UN)  # a mapping keeps the file open, and so its lock
        return whole


def _tables(blocks: DataFrame, which: str, bits: list[tuple[int, int]]) -> Sent:
    """The blocks of one kind of table; only their compressed form passes through the driver, which holds a piece at a time."""
    spark, pieces = blocks.sparkSession, list[Broadcast]()
    some: list[tuple[int, bytes]] = []
    size = 0
    for r in blocks.select("kind", which).toLocalIterator():
        some.append((r["kind"], bytes(r[which])))
        size += len(some[-1][1])
        if size > SENT:
            pieces.append(spark.sparkContext.broadcast(some))
            some, size = [], 0
    pieces.append(spark.sparkContext.broadcast(some))
    del some
    if not in_memory(bits):  # the driver keeps nothing of what has passed through it
        give_back()
        _sweep(spark)
    return Sent(bits=bits, pieces=pieces)


def _most_frequent(words: DataFrame, limit: int) -> dict[bytes, int]:
    """The ``limit`` most frequent words, of equal counts the smaller ones; only words of the least count are sorted."""
    total, least = 0, None
    for n, count in sorted(words.groupBy("n").count().collect(), reverse=True):  # counts that occur are few
        total += count
        if total >= limit:
            least = n
            break
    out = {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") > (least or 0)).toLocalIterator()}
    if least is not None:
        out |= {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") == least).orderBy("word").limit(limit - len(out)).toLocalIterator()}
    return out


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row; rows with ``learn`` teach."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (doc_id, *keep)]).alias("row"), F.col(f"`{text}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    train = rows.filter("learn").withColumn("fold", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).cast("int"))  # equal texts in one fold
    bits = bits_for(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    folds = [train.filter(F.col("fold") == f) for f in (0, 1)]
    made = len(MADE)
    width, parts = block_bits(bits), []
    for f, d in enumerate(folds):
        part = stored(_learn(d, bits))
        parts.append((part if in_memory(bits) else _added_fold(part, f, width)).withColumn("fold", F.lit(f)))
    done_with = MADE[made:]
    parts = parts[0].unionByName(parts[1])

    words = stored(parts.filter("kind = -1").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = spark.sparkContext.broadcast(_most_frequent(words.filter(F.length("word") <= AT_HAND), frequent))
    blocks = stored(_odds(_added(parts.filter("kind >= 0").select("kind", "fold", "x"), width), width))
    drop(spark, done_with)
    fits = [_fit(folds[1 - f], _tables(blocks, f"fold{f}", bits), bits) for f in (0, 1)]
    weights = _averaged(fits[0].unionByName(fits[1]))
    both = _tables(blocks, "both", bits)
    model, pieces = spark.sparkContext.broadcast((both, weights)), both.pieces
    space = float(total + kinds + 1)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sent, w = model.value
        with sent.opened(pieces) as tables:
            yield from scored(batches, Model(tables, w, bits))
        give_back()

    def scored(batches: Iterator[pd.Series], scorer: Model) -> Iterator[pd.DataFrame]:
        get = top.value.get
        for some in batches:
            texts = [_bytes(t) for t in some]
            words, n = words_of(texts)
            words = words.dictionary_encode()
            kinds = [*words.dictionary.to_pylist(), END]
            count = np.fromiter(map(get, kinds, repeat(-1)), dtype=np.int64, count=len(kinds))
            word = np.insert(words.indices.to_numpy(), np.cumsum(n), len(kinds) - 1)  # with the ends
            n = n + 1
            text = np.repeat(np.arange(len(n)), n)
            c = count[word]
            shares = [x[:-1] for x in np.split(np.maximum(c, 0) / max(total, 1), np.cumsum(n)[:-1])]
            rare, times = np.unique((text * len(kinds) + word)[c < 0], return_counts=True)
            ends = np.searchsorted(rare, np.arange(1, len(n) + 1) * len(kinds)).tolist()
            rare, times = [kinds[w] for w in (rare % len(kinds)).tolist()], times.tolist()
            out = pd.DataFrame(
                {
                    "n_bytes": [len(t) for t in texts],
                    "n_tokens": n,
                    "n_known": np.bincount(text, c > 0, len(n)).astype(np.int64),
                    "base_score": np.bincount(text, np.where(c < 0, 0.0, np.log10((np.maximum(c, 0) + 1) / space)), len(n)),
                    "rare": [rare[a:b] for a, b in zip([0, *ends], ends)],
                    "times": [times[a:b] for a, b in zip([0, *ends], ends)],
                }
            )
            out["score"] = scorer.log10([escaped(t) for t in texts], shares) if texts else []
            yield out

    found = F.pandas_udf(run, "n_bytes long, n_tokens long, n_known long, base_score double, rare array<binary>, times array<int>, score double")
    done = stored(add_row_id(rows, "key").select("key", "row", found("text").alias("f")).select("key", "row", "f.*"))
    for x in (model, *pieces, top):
        x.destroy()
    rare = done.filter(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rare = rare.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(space))).alias("b"))
    out = done.join(rare, "key", "left")
    kept = [F.col("row").getField(c).alias("doc_id" if c == doc_id else c) for c in (doc_id, *keep)]
    return out.select(
        *kept,
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
