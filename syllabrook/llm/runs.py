"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that can hold a run.

A run is a stretch of words with smallest period q that cannot be extended, of at least ``least`` words and at least 2 * q.
It is an island of consecutive places i where word i equals word i + q, of at least max(least - q, q) places. So for each
lag the places that match are counted, and only lags with enough of them are scanned for islands:

* a frequent word (heavy) adds the exact autocorrelation of its places, by FFT, rounded to whole numbers;
* a rare word (light) adds the differences of all pairs of its places.

What is frequent is where both cost the same, so n words take about n ** 1.5 steps. Two things keep lags few, and lose
nothing. Each word of a run stands in it twice, so words that occur once in a stretch cut it, and the pieces are cut again.
And lags rise: matches of a lag within a run that was found with a divisor of it are no new run's (a new run shares less than a
period with it), so they are taken off first; in a text of one word only the lag 1 is scanned.

The work is a map over documents: nothing is shuffled, and a document's words and spectra (some 100 bytes a word) are
what a task holds. Cases: a null or empty text has no words and no run; nothing is collapsed then. Words are compared as bytes,
case included. Repeated rows, null ids and other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import give_back, small_batches

#: Words of a run at least.
LEAST = 12
#: Steps of an FFT of one place and level for one pair of places.
FFT_COST = 0.8
LEVELS = 40


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    number = count()
    return np.fromiter((seen[w] if w in seen else seen.setdefault(w, next(number)) for w in words), dtype=np.int64, count=len(words))


def pieces(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of ``least`` words or more, such that no run crosses their ends.

    A word that occurs once in a stretch cuts it, again and again, but not more than LEVELS times: what then remains is searched as it is.
    """
    todo, done = [(0, len(ids), 0)], []
    while todo:
        a, b, level = todo.pop()
        if b - a < least:
            continue
        _, back, n = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        single = np.flatnonzero(n[back] == 1)
        if not len(single) or level == LEVELS:
            done.append((a, b))
            continue
        edges = np.concatenate(([-1], single, [b - a])) + a
        long = np.flatnonzero(np.diff(edges) > least)
        todo += [(int(edges[i]) + 1, int(edges[i + 1]), level + 1) for i in long]
    return sorted(done)


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """For each lag up to half of the length: how many places i have ids[i] == ids[i + lag]."""
    n, most = len(ids), len(ids) // 2
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
    sizes = np.diff(np.append(starts, n))
    width = 1 << int(np.ceil(np.log2(n + most + 1)))
    heavy = sizes > max(8.0, (2 * FFT_COST * width * np.log2(width)) ** 0.5)
    found = np.zeros(most + 1, dtype=np.int64)
    if heavy.any():
        power = np.zeros(width // 2 + 1)
        for a, size in zip(starts[heavy].tolist(), sizes[heavy].tolist(), strict=True):
            here = np.zeros(width)
            here[order[a : a + size]] = 1
            spectrum = np.fft.rfft(here)
            power += spectrum.real**2 + spectrum.imag**2
        found += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    # Places of rare words, those of the more frequent first: the step-th next place exists for a beginning of them only.
    each = np.repeat(np.where(heavy, 0, sizes), sizes)
    first = np.argsort(-each, kind="stable")
    at, word, each = order[first], sorted_ids[first], -each[first]
    step = 1
    while (upto := int(np.searchsorted(each, -step))) > step:
        gaps = (at[step:upto] - at[: upto - step])[word[step:upto] == word[: upto - step]]
        found += np.bincount(gaps[gaps <= most], minlength=most + 1)
        step += 1
    found[0] = 0
    return found


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found = []
    for a, b in pieces(ids, least):
        found += [(a + s, n, q) for s, n, q in _runs(ids[a:b], least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _runs(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    left = lag_counts(ids)
    lag = np.arange(len(left))
    needed = np.maximum(least - lag, lag)
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    for q in np.flatnonzero((left >= needed) & (lag > 0)).tolist():
        if left[q] < needed[q]:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long = end - start >= needed[q]
        for s, n in zip(start[long].tolist(), (end - start)[long].tolist(), strict=True):
            if (s, n + q) in seen:  # its smallest period is a divisor of q
                continue
            seen.add((s, n + q))
            found.append((s, n + q, q))
            multiples = np.arange(q, min(n + q, len(left)), q)
            left[multiples] -= n + q - multiples
    return found


def repeated_words(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether a run holds a word after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


#: Makes other words of those of a text: place of the original word for each place; gets the number of words and a key.
Change = Callable[[int, int], np.ndarray | None]


def finder(least: int, change: Change | None) -> callable:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            out = []
            for text, key in zip(texts, keys, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                places = change(len(words), int(key)) if change else None
                ids = word_ids(words)
                if places is not None:
                    words, ids = [words[i] for i in places.tolist()], ids[places]
                found = runs_of(ids, least)
                kept = words if not found else [w for w, gone in zip(words, repeated_words(found, len(words)).tolist(), strict=True) if not gone]
                out.append((found, b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame({"runs": [[{"start": s, "length": n, "period": q} for s, n, q in found] for found, _ in out], "collapsed": [c for _, c in out]})
        give_back()

    return run


RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, change: Change | None = None, key: str | None = None) -> DataFrame:
    """``docs`` with the struct ``found``: all runs of the text by start, then period, and the text without their repetitions.

    Words of the collapsed text are joined by one blank. ``change`` looks for runs among other words: it gets the number of
    words and the value of the whole-number column ``key`` (0 where null), and returns the places to take words from.
    """
    small_batches(docs.sparkSession)
    with_key = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long")) if key else F.lit(0).cast("long")
    return docs.withColumn("found", F.pandas_udf(finder(least, change), RUNS)(F.col(f"`{text}`"), with_key))


def planted(n: int, h: int) -> np.ndarray | None:
    """Places after which the words of a tenth of all texts (by the hash h of their id) repeat with a period."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def report(docs: DataFrame) -> DataFrame:
    """Of ``docs`` with ``found``: number of runs, the longest of them, and digests of all runs and of the collapsed text."""
    runs, long = F.col("found.runs"), "struct<length: bigint, start: bigint, period: bigint>"
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))).cast(long)
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = docs.withColumns({"best": best, "n_runs": F.size(runs).cast("long"), "runs_sha256": F.sha2(lines, 256), "collapsed_sha256": F.sha2(F.col("found.collapsed"), 256)})
    return out.withColumns({"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period")}).withColumn("exponent_milli", F.expr("1000 * length div period"))
