"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

Texts fall apart into pieces by the tokenizer's pattern, and most pieces are short. A piece longer than
``PIECE`` bytes (a run of letters, signs or white space without a break) is encoded as a tree: its halves
are encoded on their own, down to leaves of ``PIECE`` bytes, and joined pairwise. At a join, a window
around it is encoded anew and grown until its tokens agree with the left half's at some boundary and
with the right half's at another. A token sequence is the encoding of its bytes if and only if every two
neighbouring tokens are the encoding of their own bytes (each merge makes a token of its own); agreement
on a whole token on either side of the seam therefore makes the joined sequence exact.

Long texts are cut into blocks before that, at white space that follows other text, where the pattern
always starts a new piece; the blocks go through the cluster as rows of their own and meet again by
document, so that one very long text does not keep one task busy.

Cases: a null text counts as empty and gives no tokens. Repeated ids and rows are documents of their own.
The strings of special tokens in a text give these tokens. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import add_row_id, give_back, small_batches, stored

#: Bytes of a leaf of the tree, bytes of the first window on each side, characters of a block and of the texts whose ids are held together.
PIECE, WINDOW, BLOCK, TOGETHER = 4096, 64, 1 << 17, 1 << 20
#: The split pattern of the byte-level tokenizer files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encodes and decodes as the tokenizer in ``path`` (a JSON file of the tokenizers library, or ranks)."""

    def __init__(self, path: str, piece: int = PIECE, window: int = WINDOW) -> None:
        import regex
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        to_byte = {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        ranks = {b: i for i, b in self.bytes_of.items()}
        self.plain = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        # A run without a break in which a piece longer than the limit can lie.
        self.long_run = regex.compile(r"\p{L}{%d,}|\p{N}{%d,}|[^\s\p{L}\p{N}]{%d,}|\s{%d,}" % ((max(8, piece // 4),) * 4))
        self.pieces = regex.compile(PATTERN)
        self.piece, self.window = piece, window

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(t in text for t in self.special):
            return self._ordinary(text)
        out: list[int] = []
        for k, part in enumerate(self.split_special.split(text)):
            out += [self.special[part]] if k % 2 else self._ordinary(part)
        return out

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < self.piece // 4 or not self.long_run.search(text):
            return self.plain.encode_ordinary(text)
        out: list[int] = []
        done = 0
        for m in self.pieces.finditer(text):
            if (m.end() - m.start()) * 4 > self.piece:
                out += self.plain.encode_ordinary(text[done : m.start()]) if m.start() > done else []
                out += self.tree(m[0].encode())
                done = m.end()
        return out + (self.plain.encode_ordinary(text[done:]) if done < len(text) else [])

    def tree(self, piece: bytes) -> list[int]:
        """The encoding of one unsplit piece: leaves, then joins upwards, level by level."""
        with ThreadPoolExecutor(2) as pool:  # the encoder works outside the interpreter's lock
            level = list(pool.map(self._leaf, (piece[i : i + self.piece] for i in range(0, len(piece), self.piece))))
            while len(level) > 1:
                pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
                level = list(pool.map(lambda p: self.join(*p) if len(p) == 2 else p[0], pairs))
        return level[0] if level else []

    def _leaf(self, piece: bytes) -> list[int]:
        return self.plain._encode_single_piece(piece) if piece else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, which are the encodings of neighbouring parts of one piece."""
        if not left or not right:
            return left + right
        size = self.window
        while True:
            a, taken_a = len(left), 0
            while a and taken_a < size:
                a -= 1
                taken_a += len(self.bytes_of[left[a]])
            b, taken_b = 0, 0
            while b < len(right) and taken_b < size:
                taken_b += len(self.bytes_of[right[b]])
                b += 1
            old_left, old_right = left[a:], right[:b]
            new = self._leaf(b"".join(self.bytes_of[t] for t in old_left + old_right))
            head = self._agree(old_left, new, a == 0)
            tail = self._agree(old_right[::-1], new[::-1], b == len(right))
            if head is not None and tail is not None and head + tail <= len(new):
                # Both runs of equal tokens end where the other does or before: the middle is the window's.
                return left[:a] + new + right[b:]
            size *= 4

    @staticmethod
    def _agree(old: list[int], new: list[int], whole: bool) -> int | None:
        """How many tokens at the outer edge agree; at least one is needed unless the edge is the piece's own."""
        n = 0
        for x, y in zip(old, new):
            if x != y:
                break
            n += 1
        return n if n or whole else None

    def decode(self, ids: list[int]) -> str:
        get = self.bytes_of
        return b"".join([get[i] for i in ids]).decode("utf-8", "replace")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    key = f"{os.getpid()} {path}"
    if key not in _CODECS:
        _CODECS[key] = Codec(path)
    return _CODECS[key]


def blocks(text: str, size: int | None = None) -> list[str]:
    """The text in blocks that the pattern splits apart in any case: each starts with a white space after another sign."""
    size = size or BLOCK
    if len(text) <= size:
        return [text]
    out, start = [], 0
    safe = re.compile(r"(?<=\S)[ \n\t]")
    while len(text) - start > size:
        m = safe.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def _cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(blocks)


def encode(docs: DataFrame, path: str, text: str = "text", tokens: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text (``ids``: array of int) and, if named, their decoded text.

    Texts of up to a block are encoded where they are. Longer ones are cut into blocks that are dealt
    over the cluster and gathered by document; only these rows are shuffled.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(tokens, *([decoded] if decoded else []))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            size = texts.str.len().fillna(0).to_numpy(dtype=np.int64)
            part = (np.cumsum(size) - size) // TOGETHER
            for _, some in texts.groupby(part):
                rows = []
                for t in some:  # a list of ids takes nine times the bytes of its array
                    ids = c.encode(t or "")
                    rows.append((np.array(ids, dtype=np.int32), c.decode(ids)))
                yield pd.DataFrame(rows, columns=["ids", "decoded"])
            give_back()

    # Only the texts pass through Python; the other columns stay as they are.
    coded = F.pandas_udf(run, "ids array<int>, decoded string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    length = F.coalesce(F.length("t"), F.lit(0))
    short = rows.filter(length <= BLOCK).select("row", coded("t").alias("c")).select("row", "c.ids", "c.decoded")
    long = stored(add_row_id(rows.filter(length > BLOCK), "k"))  # stored: the key has to be the same for both readers
    parts = long.select("k", F.posexplode(F.pandas_udf(_cut, "array<string>")("t")).alias("i", "t")).repartition("k", "i")
    parts = parts.select("k", "i", coded("t").alias("c"))
    whole = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "c.ids", "c.decoded"))).alias("p"))
    whole = whole.select("k", F.flatten("p.ids").alias("ids"), F.array_join("p.decoded", "").alias("decoded"))
    out = short.unionByName(long.join(whole, "k").select("row", "ids", "decoded"))
    names = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*names, F.col("ids").alias(tokens), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(frame: DataFrame, path: str, tokens: str = "ids", out: str = "text") -> DataFrame:
    """``frame`` with the text of its token ids (null ids: empty)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for s in batches:
            yield pd.Series([c.decode(list(i)) if i is not None else "" for i in s])

    return frame.withColumn(out, F.pandas_udf(run, "string")(F.col(tokens)))


__all__: list[str] = ["Codec", "blocks", "codec", "decode", "encode"]
