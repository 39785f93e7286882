"""Similarity join of texts by the Jaccard index of their word n-grams, with several global orders.

Two sets with Jaccard index t or more share a token among the first n - ceil(t n) + 1 of each (their
*prefixes*), whatever order all tokens are in, so long as it is the same for all sets. Candidates therefore
have to share a prefix token under three orders at once. The first puts rare tokens first: a sketch of
fixed size counts those with a low hash over all documents, and tokens that it shows to be unique are not
even listed. The other two orders are permutations of the hashes; the prefixes under them travel with the
listed tokens, and a pair must overlap in both before it is verified.

Links are wanted as components and not as pairs, so no pair ever becomes a row. Equal sets are one class from
the start. The sets that share a token meet in one place, in which matrices of sizes, positions and shared
tokens tell all candidates at once; long lists are dealt in parts, each two of which meet. A pair is looked
at where its first common token is. Only sets with a candidate are fetched, once for each cluster of candidates, and verification is one product
of the group's incidence matrix with itself, of which the links that tie the group together are kept. All
pairs that pass the filters are verified, so the result is complete.

Tokens are 48-bit hashes: two different n-grams of a pair of documents are taken for equal with a chance
of about size squared over 2**48.

Cases: null or empty texts have no tokens and are linked with nothing; a text with fewer words than the
n-gram has its whole sequence as one token. Repeated rows and ids fall in one class. A component's id is its
smallest document id (null if all are null). Very long texts are whole. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.llm.common import LOWER_BYTES, Packed, give_back, small_batches, stored, word_hashes
from syllabrook.llm.components import components

BITS = 48
#: Tokens are counted if their hash is in the lowest share, which exceeds that of a prefix by this; counters of the sketch.
SPARE, SKETCH_BITS, BLOCK_BITS = 0.12, 26, 18
#: Bits of the filter of classes with candidates; rows of a part of a token's list; columns of a part of a matrix.
CLASS_BITS, PART, COLUMNS = 24, 1024, 1024
#: Tokens of all sets of a part, rows of a matrix that are tested at a time, and tokens that are matched at a time.
PART_TOKENS, ROWS, MATCHED = 4 << 20, 256, 1 << 21
#: So many tokens of a set tell whether a pair has met before.
BEFORE = 16
MASK = (1 << BITS) - 1
#: Odd factors: hashes of words and n-grams, and the two permutations (fixed values).
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ORDERS = (0x5851F42D4C957F2D, 0xD6E8FEB86659FD93)


def tokens_of(text: str | None, words: int) -> tuple[np.ndarray, bytes]:
    """Sorted distinct n-gram hashes of a text, and the digest that names its class.

    A set of one n-gram is named by the words themselves: it can only be linked with its equals, and there
    may be so many of these that short hashes would meet by chance.
    """
    import xxhash

    raw = text.encode("utf-8").translate(LOWER_BYTES) if text else b""
    h = word_hashes(raw)
    if not len(h):
        return h, b""
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out ^= h[i : len(h) - k + 1 + i]
        out *= np.uint64(FACTORS[0])
        out ^= out >> np.uint64(29)
    out *= np.uint64(FACTORS[2])
    out ^= out >> np.uint64(32)
    out = out & np.uint64(MASK)
    out.sort()
    out = out[np.concatenate(([True], out[1:] != out[:-1]))]
    return out, xxhash.xxh3_128_digest(out.tobytes() if len(out) > 1 else b" ".join(raw.split()[:k]))


def lowest(percent: int) -> int:
    """Tokens below this hash are counted."""
    return int((1 << BITS) * min(1.0, (100 - percent) / 100 + SPARE))


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def permuted_prefix(tokens: np.ndarray, p: int, factor: int) -> np.ndarray:
    """The first p tokens under a permutation of all hashes, cut to 32 bits."""
    x = (tokens * np.uint64(factor)) & np.uint64(MASK)
    x = np.partition(x, p - 1)[:p] if p < len(x) else x
    return (x >> np.uint64(BITS - 32)).astype(np.uint32).view(np.int32)


def _slot(c: bytes) -> int:
    return int.from_bytes(c[:4], "big") >> (32 - CLASS_BITS)


def linked(docs: DataFrame, percent: int = 90, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    limit = lowest(percent)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s, c = tokens_of(t, words)
                n = len(s)
                if not n:
                    rows.append((0, None, None))
                    continue
                p = prefix_size(n, percent)
                low = int(np.searchsorted(s, np.uint64(limit)))
                rows.append((n, c, s[: max(low, p)].astype(np.int64)))
            yield pd.DataFrame(rows, columns=["n", "c", "tokens"])
        give_back()

    # Ids never pass through Python, where nulls among them would turn whole numbers into floats.
    read_docs = texts.withColumn("s", F.pandas_udf(read, "n long, c binary, tokens array<long>")("text"))
    read_docs = stored(read_docs.select("doc_id", "s.n", "s.c", "s.tokens"))
    sketch = spark.sparkContext.broadcast(Packed([_sketch(read_docs, limit)]))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sketch.value.arrays[0]
        for df in batches:
            rows = []
            for c, n, tokens in zip(df["c"], df["n"], df["tokens"], strict=True):
                p = prefix_size(n, percent)
                low = int(np.searchsorted(tokens, limit))
                count = counts[tokens[:low] & ((1 << SKETCH_BITS) - 1)]
                order = np.lexsort((tokens[:low], count))[:p]
                first = np.concatenate((tokens[:low][order], tokens[low : low + p - len(order)]))
                count = np.concatenate((count[order], np.full(len(first) - len(order), 2, dtype=count.dtype)))
                at = np.flatnonzero(count > 1)
                if len(at):
                    rows.append((c, n, first[at], at.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["c", "n", "token", "i"])
        give_back()

    once = W.partitionBy("c").orderBy("n")
    # One n-gram alone has half of no larger set: such classes need no candidates.
    several = read_docs.filter("n > 1" if percent > 50 else "n > 0").select("c", "n", "tokens")
    lists = several.mapInPandas(listed, "c binary, n long, token array<long>, i array<int>")
    lists = lists.withColumn("k", F.row_number().over(once)).filter("k = 1").drop("k")
    lists = stored(lists.select("c", "n", F.explode(F.arrays_zip("token", "i")).alias("t")).select("c", "n", "t.token", "t.i"))
    sketch.destroy()
    shared = lists.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).filter("m > 1")
    shared = shared.select("token", F.floor(F.greatest(F.col("m") / PART, F.col("tokens") / PART_TOKENS) + 1).cast("int").alias("parts"))
    lists = stored(lists.join(shared, "token"))
    needed = stored(_dealt(lists).mapInPandas(_candidates(percent), "g long, c binary, n long, i int, b int, one boolean"))
    sets = stored(_sets(texts, needed, words, percent))
    groups = needed.join(sets.select("c", "p2", "p3"), "c").repartition("g").sortWithinPartitions("g")
    needed = stored(groups.mapInPandas(_meeting(percent), "g long, c binary, n long, i int, b int, one boolean"))
    groups = _homes(needed).join(sets.select("c", "set"), "c").repartition("g").sortWithinPartitions("g")
    links = stored(groups.mapInPandas(_verify(percent), "u binary, v binary"))
    parts = components(links)
    heads = read_docs.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id")).join(parts.withColumnsRenamed({"u": "c", "v": "root"}), "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = heads.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = heads.select("c", "root").join(names, "root").select("c", "component_id")
    return read_docs.select("doc_id", F.col("n").alias("n_shingles"), "c").join(names, "c", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sketch(read_docs: DataFrame, limit: int) -> np.ndarray:
    """How many documents have a token of each counter, over all documents; cut at 255."""
    blocks = 1 << (SKETCH_BITS - BLOCK_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for df in batches:
            t = np.concatenate([np.zeros(0, dtype=np.int64), *df["tokens"]])
            slots = (t[t < limit] & ((1 << SKETCH_BITS) - 1)).astype(np.uint32)
            slots.sort()
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(slots)), dtype=bool), slots[1:] != slots[:-1])))
            n = np.diff(np.append(first, len(slots)))
            at = slots[first]
            total[at] = np.minimum(total[at].astype(np.int64) + n, 255).astype(np.uint8)
        for b, part in enumerate(total.reshape(blocks, -1)):
            if part.any():
                yield pd.DataFrame({"b": [b], "x": [zlib.compress(part.tobytes(), 1)]})

    def add(at: tuple, df: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, dtype=np.int64)
        for x in df["x"]:
            total += np.frombuffer(zlib.decompress(x), dtype=np.uint8)
        return pd.DataFrame({"b": [at[0]], "x": [zlib.compress(np.minimum(total, 255).astype(np.uint8).tobytes(), 1)]})

    parts = read_docs.filter("n > 0").select("tokens").mapInPandas(count, "b int, x binary")
    out = np.zeros((blocks, 1 << BLOCK_BITS), dtype=np.uint8)
    for r in parts.groupBy("b").applyInPandas(add, "b int, x binary").collect():  # 64 MB before compression
        out[r["b"]] = np.frombuffer(zlib.decompress(r["x"]), dtype=np.uint8)
    return out.reshape(-1)


def _sets(texts: DataFrame, lists: DataFrame, words: int, percent: int) -> DataFrame:
    """(c, tokens as 6 bytes each, prefixes under the other two orders) of the classes that have candidates; a filter of fixed size spares the others the shuffle."""
    slot = F.conv(F.substring(F.hex("c"), 1, 8), 16, 10).cast("long")
    slot = F.shiftright(slot, 32 - CLASS_BITS)
    bits = lists.select(F.floor(slot / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int")).alias("b"))
    held = np.zeros(1 << (CLASS_BITS - 5), dtype=np.uint64)
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most 2**19 rows
        held[r["w"]] = r["b"]
    held = texts.sparkSession.sparkContext.broadcast(held)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bit = held.value
        for df in batches:
            rows = {}
            for t in df["text"]:
                s, c = tokens_of(t, words)
                if len(s) and int(bit[(k := _slot(c)) >> 5]) >> (k & 31) & 1:
                    rows[c] = s
            yield pd.DataFrame([(c, len(s), np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), *[permuted_prefix(s, prefix_size(len(s), percent), f) for f in ORDERS]) for c, s in rows.items()], columns=["c", "n", "set", "p2", "p3"])
        give_back()

    found = texts.select("text").mapInPandas(pick, "c binary, n long, set binary, p2 array<int>, p3 array<int>")
    return found.withColumn("k", F.row_number().over(W.partitionBy("c").orderBy("n"))).filter("k = 1").select("c", "set", "p2", "p3")


def _dealt(lists: DataFrame) -> DataFrame:
    """The rows of each token together, sorted by a key g; of a long list, each two of its parts together.

    ``before`` holds the first few listed tokens that come before this one in the set's order.
    """
    own = lists.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("i", "token"))), 1, BEFORE).alias("own"))
    rows = lists.join(own, "c").withColumn("before", F.transform(F.filter("own", lambda x: x["i"] < F.col("i")), lambda x: x["token"])).drop("own")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("b", "j"), F.greatest("b", "j")
    rows = rows.select(F.xxhash64("token", low, high).alias("g"), "c", "n", "i", "b", (low == high).alias("one"), "before")
    return rows.repartition("g").sortWithinPartitions("g")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each g, which arrive one after another."""
    rest = None
    for df in batches:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        g = df["g"].to_numpy()
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
        for a, b in zip(cut, cut[1:]):
            if b - a > 1:
                yield df.iloc[a:b]
        rest = df.iloc[cut[-1] :]
    if rest is not None and len(rest) > 1:
        yield rest


def _possible(df: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of rows (above the diagonal) fit by size and by the room that their common token leaves."""
    n, i, b = (df[x].to_numpy().astype(np.int64) for x in ("n", "i", "b"))
    out, one = np.zeros((len(n), len(n)), dtype=bool), bool(df["one"].iat[0])
    for a in range(0, len(n), ROWS):  # a few rows at a time: the matrices of numbers are larger than that of the answers
        own = slice(a, min(a + ROWS, len(n)))
        small, large = np.minimum(n[own, None], n), np.maximum(n[own, None], n)
        room = np.minimum((n - i)[own, None], n - i)
        fit = (small * 100 >= large * percent) & (room * (100 + percent) >= percent * (small + large))
        out[own] = np.triu(fit, 1 + a) if one else np.triu(fit, 1 + a) & (b[own, None] != b)
    return out


def _meet(rows: list[np.ndarray]) -> np.ndarray:
    """How many values each two rows (of distinct values) have in common."""
    m = len(rows)
    out = np.zeros((m, m), dtype=np.float32)
    sizes = np.array([len(r) for r in rows])
    if not sizes.sum():
        return out
    parts = int(-(-sizes.sum() // MATCHED))
    if parts == 1:
        _count_common(rows, out)
    for k in range(parts if parts > 1 else 0):  # values by their remainder, so that each is in one part
        _count_common([r[r.astype(np.uint64) % np.uint64(parts) == k] for r in rows], out)
    return out


def _count_common(rows: list[np.ndarray], out: np.ndarray) -> None:
    m, sizes = len(rows), np.array([len(r) for r in rows])
    value, at, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m, dtype=np.int32), sizes)
    keep = count[at] > 1  # what one row has alone meets nothing
    at, row = (np.cumsum(count > 1) - 1)[at[keep]], row[keep]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, int((count > 1).sum()), COLUMNS):
        x, y = np.searchsorted(at, (low, low + COLUMNS))
        part = np.zeros((m, COLUMNS), dtype=np.float32)
        part[row[x:y], at[x:y] - low] = 1
        out += part @ part.T


ROW = ["g", "c", "n", "i", "b", "one"]


def _kept(batches: Iterator[pd.DataFrame], test: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows of which the test leaves a pair."""
    held, size = [], 0
    for df in _runs(batches):
        fit = test(df)
        need = fit.any(axis=0) | fit.any(axis=1)
        if need.any():
            held.append(df.loc[need, ROW])
            size += len(held[-1])
        if size > 2000:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
    give_back()


def _candidates(percent: int) -> Callable:
    """Rows that some pair needs here: one that fits and has no common token before this one."""

    def test(df: pd.DataFrame) -> np.ndarray:
        fit = _possible(df, percent)
        return fit & (_meet(df["before"].tolist()) == 0) if fit.any() else fit

    return lambda batches: _kept(batches, test)


def _meeting(percent: int) -> Callable:
    """Rows that some pair needs which shares prefix tokens under both other orders, too."""

    def test(df: pd.DataFrame) -> np.ndarray:
        fit = _possible(df, percent)
        for p in ("p2", "p3"):
            if fit.any():
                fit &= _meet(df[p].tolist()) > 0
        return fit

    return lambda batches: _kept(batches, test)


def _homes(needed: DataFrame) -> DataFrame:
    """The rows with one group for each cluster of sets that meet, directly or by others, so that a set travels once.

    Clusters of more than PART sets or PART_TOKENS tokens stay in the groups of their tokens.
    """
    key = F.concat(F.lit("g").cast("binary"), F.hex("g").cast("binary"))  # no digest has this form
    tied = components(needed.select(F.col("c").alias("u"), key.alias("v")))
    home = tied.withColumnsRenamed({"u": "c", "v": "root"})
    rows = needed.join(home, "c", "left").withColumn("root", F.coalesce("root", "c"))
    small = rows.select("root", "c", "n").distinct().groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    small = small.filter((F.col("m") <= PART) & (F.col("tokens") <= PART_TOKENS)).select("root", F.lit(True).alias("small"))
    rows = rows.join(small, "root", "left")
    at_home = rows.filter("small").select(F.xxhash64("root").alias("g"), "c", "n").distinct()
    at_home = at_home.withColumns({"i": F.lit(0), "b": F.lit(0), "one": F.lit(True)})
    return stored(at_home.unionByName(rows.filter("small is null").select(*ROW)))


def _verify(percent: int) -> Callable:
    """Links of each group of rows, as many as tie its linked sets together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for df in _runs(batches):
            n = df["n"].to_numpy()
            linked = _possible(df, percent)
            if linked.any():
                same = _meet([_unpack(x) for x in df["set"]])
                for a in range(0, len(n), ROWS):
                    own = slice(a, a + ROWS)
                    linked[own] &= 100 * same[own] >= percent * (n[own, None] + n - same[own])
            c, top = df["c"].tolist(), list(range(len(df)))
            for a, b in zip(*np.nonzero(linked)):
                a, b = _top(top, int(a)), _top(top, int(b))
                if a != b:
                    top[max(a, b)] = min(a, b)
                    held.append((c[a], c[b]))
            if len(held) > 2000:
                yield pd.DataFrame(held, columns=["u", "v"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["u", "v"])
        give_back()

    return run


def _top(top: list[int], i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)
