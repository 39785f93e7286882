"""Removal of repeated passages with suffix arrays of shards of the corpus.

Every window of ``WINDOW`` bytes belongs to one shard, that of the smallest hash of a ``SEED``-byte string in
it; equal windows meet wherever they are. Neighbouring windows with the same smallest hash travel together
as one *piece* of text. The corpus is packed in blocks of two megabytes:

1. each block sends its hashes to their shards, which mark those that more than one document has
   (exact copies count here, which marks a few hashes too many and is of no harm);
2. each block sends the distinct pieces of marked hashes, with the smallest document id that has each;
3. each shard sorts the suffixes of its distinct pieces by induced sorting and finds, from the permuted
   common prefixes, runs of equal windows and the smallest document of each run;
4. each block removes the bytes that these windows cover in documents with a larger id.

A passage that a third of all documents hold costs a shard one piece for each block. Exact copies of whole
documents are known by their digest and send nothing.

Cases: a null text counts as empty. Texts below a window's size lose nothing. Documents with equal ids do not
remove from each other; a null id comes after all others. Long texts are whole. Repeated rows each get a row.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import give_back, small_batches, stored
from syllabrook.llm.suffix import common_prefixes, suffix_array

WINDOW, SEED = 50, 16
#: Seeds of a window; bytes of a block and of the corpus for each shard; bytes of a sent hash.
SEEDS = WINDOW - SEED + 1
BLOCK, SHARD, SENT = 2 << 20, 4 << 20, 5
NO_ID = (1 << 63) - 1
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b)


def _unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


class Block:
    """Texts one after another, cut into pieces: where each starts, its windows, its smallest hash, its document."""

    def __init__(self, data: bytes, sizes: np.ndarray, copies: np.ndarray) -> None:
        self.data, self.sizes, self.copy = data, sizes, np.zeros(len(sizes), dtype=bool)
        self.copy[copies] = True
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        whole = len(data) - WINDOW + 1
        if whole < 1:
            self.start = self.windows = self.doc = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        h = words[: len(data) - SEED + 1] * A
        h ^= h >> np.uint64(31)
        h += words[8 : len(data) - SEED + 9]
        h *= B
        h ^= h >> np.uint64(29)
        h *= A
        width = 1
        while width * 2 <= SEEDS:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < SEEDS:
            h = np.minimum(h[: len(h) - (SEEDS - width)], h[SEEDS - width :])
        # Windows within one document that take part, and runs of them with one hash.
        end = np.zeros(whole + 1, dtype=np.int32)
        wide = sizes >= WINDOW
        np.add.at(end, self.first[wide], 1)
        np.add.at(end, self.first[wide] + sizes[wide] - WINDOW + 1, -1)
        good = np.cumsum(end[:-1]) > 0
        new = np.ones(whole, dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (good[1:] != good[:-1])
        new[self.first[wide]] = True
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, whole))
        kept = good[at]
        at, n = at[kept], n[kept]
        # Long runs (one seed over and over) in parts, of which most are equal.
        parts = -(-n // SEEDS)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(at, parts) + k * SEEDS
        self.windows = np.minimum(np.repeat(n, parts) - k * SEEDS, SEEDS)
        self.hash = h[np.repeat(at, parts)]
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1

    def shards(self, n: int) -> np.ndarray:
        return ((self.hash >> np.uint64(40)) % np.uint64(n)).astype(np.int64)

    def of_shard(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """The pieces of each shard, in the order of the text."""
        s = self.shards(n)
        order = np.argsort(s, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], s[order][1:] != s[order][:-1]))) if len(s) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(s))):
            yield int(s[order[a]]), order[a:b]


def _block(r: pd.Series) -> Block:
    sizes = np.asarray(r["sizes"], dtype=np.int64)
    copies = r.get("copies")
    return Block(_unpack(r["data"]), sizes, np.asarray([] if copies is None else copies, dtype=np.int64))


def _shared(b: Block, pieces: np.ndarray, bits: bytes) -> np.ndarray:
    """Those of a shard's pieces whose hash more than one document has, here or elsewhere, but for exact copies."""
    hashes, at = np.unique(b.hash[pieces], return_inverse=True)
    marked = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(hashes)).astype(bool)
    return pieces[marked[at] & ~b.copy[b.doc[pieces]]]


def _distinct(b: Block, pieces: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct texts of pieces in order of appearance, and the number of each piece's text."""
    seen: dict[bytes, int] = {}
    data = b.data
    number = [seen.setdefault(data[s : s + n], len(seen)) for s, n in zip(b.start[pieces].tolist(), (b.windows[pieces] + WINDOW - 1).tolist(), strict=True)]
    return list(seen), np.array(number, dtype=np.int64)


def _ids(r: pd.Series) -> np.ndarray:
    """The documents' ids; one that is null (``no_id``) comes after all others."""
    return np.asarray(r["ids"], dtype=np.int64)


def packed(texts: DataFrame) -> DataFrame:
    """Blocks of (doc_id as text, text, extra): ids, sizes and digests of the texts, and their compressed bytes.

    Ids come as text, since nulls beside them would turn whole numbers into floats.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def out() -> pd.DataFrame:
            ids, texts, extras = zip(*held, strict=True)
            row = [uuid.uuid4().int >> 65, [NO_ID if i is None else int(i) for i in ids], [i is None for i in ids], list(extras), [len(t) for t in texts], [hashlib.md5(t).digest() for t in texts], _pack(b"".join(texts))]
            held.clear()
            return pd.DataFrame([row], columns=["block", "ids", "no_id", "extras", "sizes", "digests", "data"])

        for df in batches:
            for i, t, x in zip(df["doc_id"], df["text"], df["extra"], strict=True):
                t = (t or "").encode("utf-8")
                held.append((i, t, x))
                size += len(t)
                if size >= BLOCK:
                    yield out()
                    size = 0
        if held:
            yield out()
        give_back()

    return texts.mapInPandas(run, "block long, ids array<long>, no_id array<boolean>, extras array<string>, sizes array<long>, digests array<binary>, data binary")


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def _rows(f: Callable[[pd.Series], pd.DataFrame]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for k in range(len(df)):
                yield f(df.iloc[k])
        give_back()

    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of the corpus (with the numbers of exact copies and the marks), what shards found for each, and the shards."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"), (F.to_json(F.struct(*[_named(k) for k in keep])) if keep else F.lit(None).cast("string")).alias("extra"))
    blocks = stored(packed(texts))
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(8, -(-size // SHARD))

    each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests", "sizes")).alias("k", "d")).select("block", "k", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest"), F.col("d.sizes").alias("size")).filter(F.col("size") >= WINDOW)
    first = each.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    copies = stored(each.join(first, "digest").filter(F.col("id") > F.col("first")).groupBy("block").agg(F.sort_array(F.collect_list("k")).alias("copies")))

    def send_hashes(r: pd.Series) -> pd.DataFrame:
        b, out = _block(r), []
        for s, pieces in b.of_shard(shards):
            order = np.lexsort((b.doc[pieces], b.hash[pieces]))
            h, d = b.hash[pieces][order], b.doc[pieces][order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            several = np.maximum.reduceat(d, at) > np.minimum.reduceat(d, at)
            raw = h[at].view(np.uint8).reshape(-1, 8)[:, :SENT]
            out.append((s, int(r["block"]), np.ascontiguousarray(raw).tobytes(), np.packbits(several).tobytes()))
        return pd.DataFrame(out, columns=["shard", "block", "hashes", "several"])

    def mark(at: tuple, df: pd.DataFrame) -> pd.DataFrame:
        raws = [np.frombuffer(x, dtype=np.uint8).reshape(-1, SENT) for x in df["hashes"]]
        n = np.array([len(x) for x in raws])
        wide = np.zeros((int(n.sum()), 8), dtype=np.uint8)
        wide[:, :SENT] = np.concatenate(raws)
        h = wide.view("<u8").reshape(-1)
        order = np.argsort(h)
        x = h[order]
        twice = np.zeros(len(x), dtype=bool)
        same = x[1:] == x[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        found = np.zeros(len(x), dtype=bool)
        found[order] = twice
        out = []
        for part, several, block in zip(np.split(found, np.cumsum(n)[:-1]), df["several"], df["block"], strict=True):
            bits = part | np.unpackbits(np.frombuffer(several, dtype=np.uint8), count=len(part)).astype(bool)
            if bits.any():
                out.append((int(block), int(at[0]), np.packbits(bits).tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "bits"])

    hashes = blocks.mapInPandas(_rows(send_hashes), "shard int, block long, hashes binary, several binary")
    marks = hashes.groupBy("shard").applyInPandas(mark, "block long, shard int, bits binary")
    marks = marks.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("marks"))
    # Narrow; the texts themselves are shuffled once for the pieces and once for the cut.
    marked = blocks.join(stored(marks.join(copies, "block", "full_outer")), "block", "left")

    def send_pieces(r: pd.Series) -> pd.DataFrame:
        if r["marks"] is None:
            return pd.DataFrame(columns=["shard", "block", "texts", "sizes", "low", "high"])
        b, out, bits = _block(r), [], {m["shard"]: m["bits"] for m in r["marks"]}
        ids = _ids(r)
        for s, pieces in b.of_shard(shards):
            if s in bits and len(pieces := _shared(b, pieces, bits[s])):
                texts, number = _distinct(b, pieces)
                low, high = np.full(len(texts), NO_ID), np.full(len(texts), -(1 << 63))
                np.minimum.at(low, number, ids[b.doc[pieces]])
                np.maximum.at(high, number, ids[b.doc[pieces]])
                sizes = np.array([len(t) for t in texts], dtype=np.uint8)
                out.append((s, int(r["block"]), _pack(b"".join(texts)), sizes.tobytes(), low.tobytes(), high.tobytes()))
        return pd.DataFrame(out, columns=["shard", "block", "texts", "sizes", "low", "high"])

    pieces = marked.mapInPandas(_rows(send_pieces), "shard int, block long, texts binary, sizes binary, low binary, high binary")
    found = pieces.groupBy("shard").applyInPandas(_compare, "block long, shard int, spans binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("shard", "spans")).alias("found"))
    return marked, found, shards


def _compare(at: tuple, df: pd.DataFrame) -> pd.DataFrame:
    """For each block the runs of windows that a smaller document has: piece, first window, windows, that id."""
    seen: dict[bytes, int] = {}
    numbers, lows = [], []
    for texts, sizes, low in zip(df["texts"], df["sizes"], df["low"], strict=True):
        data, ends = _unpack(texts), np.cumsum(np.frombuffer(sizes, dtype=np.uint8).astype(np.int64))
        numbers.append(np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], dtype=np.int64))
        lows.append(np.frombuffer(low, dtype=np.int64))
    least = np.full(len(seen), NO_ID)
    np.minimum.at(least, np.concatenate(numbers), np.concatenate(lows))
    size = np.array([len(t) for t in seen], dtype=np.int64)
    n = size - WINDOW + 1
    smallest = _smallest(b"".join(seen), size, least)  # for each window of each distinct piece
    offset = np.cumsum(n) - n
    out = []
    for number, high, block in zip(numbers, df["high"], df["block"], strict=True):
        k = n[number]
        piece = np.repeat(np.arange(len(number)), k)
        window = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        low = smallest[offset[number][piece] + window]
        keep = np.flatnonzero(low < np.frombuffer(high, dtype=np.int64)[piece])
        if not len(keep):
            continue
        piece, window, low = piece[keep], window[keep], low[keep]
        new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (low[1:] != low[:-1]) | (window[1:] != window[:-1] + 1)))
        first = np.flatnonzero(new)
        spans = np.stack((piece[first], window[first], np.diff(np.append(first, len(piece))), low[first]))
        out.append((int(block), int(at[0]), _pack(spans.tobytes())))
    return pd.DataFrame(out, columns=["block", "shard", "spans"])


def _smallest(data: bytes, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document id of each window of the pieces, from the suffix array of all of them."""
    ends = np.cumsum(size)
    piece = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    raw = np.frombuffer(data, dtype=np.uint8)
    s = np.zeros(len(data) + len(size), dtype=np.uint16 if (raw == 255).any() else np.uint8)  # UTF-8 has no such byte
    starts = ends - size + np.arange(len(size))
    text = np.ones(len(s), dtype=bool)
    text[starts + size] = False
    s[text] = raw.astype(s.dtype) + 1
    whole = np.zeros(len(s), dtype=bool)  # where windows start
    n = size - WINDOW + 1
    whole[np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = True
    sa = suffix_array(s)
    common = common_prefixes(s, sa, starts)
    sa = sa[whole[sa]]
    new = (common < WINDOW)[sa]
    new[:1] = True
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(least[piece[sa]], first) if len(first) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(s), dtype=np.int64)
    out[sa] = np.repeat(low, np.diff(np.append(first, len(sa))))
    return out[whole]


def spans_of(r: pd.Series, shards: int) -> np.ndarray:
    """Which bytes of a block go."""
    sizes, ids = np.asarray(r["sizes"], dtype=np.int64), _ids(r)
    gone = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
    first = np.cumsum(sizes) - sizes
    if r["copies"] is not None:
        k = np.asarray(r["copies"], dtype=np.int64)
        np.add.at(gone, first[k], 1)
        np.add.at(gone, first[k] + sizes[k], -1)
    if r["found"] is not None and r["marks"] is not None:
        b, bits, found = _block(r), {m["shard"]: m["bits"] for m in r["marks"]}, {m["shard"]: m["spans"] for m in r["found"]}
        for s, pieces in b.of_shard(shards):
            if s not in found:
                continue
            pieces = _shared(b, pieces, bits[s])
            _, number = _distinct(b, pieces)
            piece, window, n, low = np.frombuffer(_unpack(found[s]), dtype=np.int64).reshape(4, -1)
            # Every occurrence of the piece in this block, in documents with a larger id.
            order = np.argsort(number, kind="stable")
            a, z = np.searchsorted(number[order], piece), np.searchsorted(number[order], piece, side="right")
            times = z - a
            which = np.repeat(np.arange(len(piece)), times)
            at = pieces[order[np.repeat(a, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]]
            later = ids[b.doc[at]] > low[which]
            start = b.start[at[later]] + window[which[later]]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + n[which[later]] + WINDOW - 1, -1)
    return np.cumsum(gone[:-1]) > 0


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_text, columns): a row for each document.

    kept holds the bytes that stay, kept_text the letters of these (a letter that is cut in two goes), and
    ``columns`` is a struct of the columns named in ``keep``, whatever their names.
    """
    marked, found, shards = repeats(docs, doc_id, text, keep)

    def cut(r: pd.Series) -> pd.DataFrame:
        gone, data = spans_of(r, shards), np.frombuffer(_unpack(r["data"]), dtype=np.uint8)
        out, at = [], 0
        for x, n in zip(r["extras"], r["sizes"], strict=True):
            g, d = gone[at : at + n], data[at : at + n]
            at += n
            removed = int(g.sum())
            spans = int(g[:1].sum() + (g[1:] > g[:-1]).sum())
            left = (d[~g] if removed else d).tobytes()
            out.append((x, n, removed, spans, left, left.decode("utf-8", "ignore")))
        df = pd.DataFrame(out, columns=["extra", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])
        df.insert(0, "no_id", np.asarray(r["no_id"], dtype=bool))
        df.insert(0, "id", _ids(r))
        return df

    done = marked.join(found, "block", "left").mapInPandas(_rows(cut), "id long, no_id boolean, extra string, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string")
    columns = F.from_json("extra", docs.select(*[_named(k) for k in keep]).schema) if keep else F.lit(None)
    return done.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_text", columns.alias("columns"))
