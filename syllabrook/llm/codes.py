"""Vector code compression: integer k-means in each part of a vector, nearest entries by annular norm pruning.

A vector is cut into ``PARTS`` equal parts, and each part is replaced by the index of the nearest of ``ENTRIES``
entries of that part's codebook. Entries lie sorted by norm. The first guess is the entry whose norm is nearest to
the part's; the distance found so far allows only norms within that distance of the part's own norm, an interval
found by binary search, and only entries in this annulus, its ends included, are evaluated, in whole numbers. Every
better entry narrows the annulus.

Vectors are read from a stored table in each round; a task returns the sums of its parts by entry, as many numbers
as a codebook has, and Spark adds them up. Only codebooks travel through the driver: ``ENTRIES`` vectors.

Cases: vectors that are null or hold null or non-finite components take no part; empty ones and zeros do. Where
vectors differ in length or their length is no multiple of the parts, all are filled up with zeros to the smallest
common multiple that holds the longest. With fewer vectors than entries, codebooks have as many entries as there are
vectors. The start takes the smallest ids (null last, equal ids by the vector's components). Repeated rows count each.
Floors beyond 2**62 are held there, and errors beyond 2**63 - 1 at that. Other columns stay as they are; without rows
there are no codes and all codebooks are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import add_totals, give_back, small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest floor of a component, largest error that is told, and below what number distances are exact in 64 bits.
HELD, MOST, NEAR = 1 << 62, (1 << 63) - 1, 1 << 62
SUMS = "at int, high long, low long, n long"


@dataclass
class Coded:
    """rows: the columns kept, code and error; books: the components of all entries, [part][entry][position]."""

    rows: DataFrame
    books: list[list[list[int]]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.books for entry in part for c in entry).encode()).hexdigest()


def finite(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1) if x.shape[1] else np.zeros(len(x), dtype=x.dtype)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` (ties: the lower one) and the squared distance, for each row of ``x``."""
    if book.shape[1] * (int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))) ** 2 >= NEAR:
        x, book = x.astype(object), book.astype(object)
    squares = _square(book)
    order = np.argsort(squares.astype(np.float64), kind="stable")
    entries, norms = book[order], np.sqrt(squares[order].astype(np.float64))
    length = np.sqrt(_square(x).astype(np.float64))
    right = np.clip(np.searchsorted(norms, length), 1, max(1, len(norms) - 1))
    first = np.where(np.abs(norms[right - 1] - length) <= np.abs(norms[np.minimum(right, len(norms) - 1)] - length), right - 1, np.minimum(right, len(norms) - 1))
    best, who = _square(x - entries[first]), order[first]
    low, high = _annulus(norms, length, best)
    for step in range(1, len(norms)):
        if not ((first - step >= low) | (first + step < high)).any():
            break
        for at in (first - step, first + step):
            rows = np.flatnonzero((at >= low) & (at < high))
            if not len(rows):
                continue
            d, entry = _square(x[rows] - entries[at[rows]]), order[at[rows]]
            better = (d < best[rows]) | ((d == best[rows]) & (entry < who[rows]))
            rows = rows[better]
            best[rows], who[rows] = d[better], entry[better]
            low[rows], high[rows] = _annulus(norms, length[rows], best[rows])
    return who, best


def _annulus(norms: np.ndarray, length: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all entries whose norm a distance of at most sqrt(best) allows; rounding only widens it."""
    reach = np.sqrt(best.astype(np.float64))
    reach = reach + 1e-9 * (reach + length) + 1e-9
    return np.searchsorted(norms, length - reach, "left"), np.searchsorted(norms, length + reach, "right")


def _parts(v: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow batch as [row, part, position]."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(v), PARTS, width)


def part_sums(books: np.ndarray) -> callable:
    """Sums and counts of the parts that each entry is nearest to, in two halves of 32 bits, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        high, low = np.zeros((2, parts, entries, width), dtype=np.int64)
        n = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = _parts(batch.column(0), width)
            for p in range(parts):
                who, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(who, minlength=entries)
                np.add.at(high[p], who, x[:, p] >> 32)
                np.add.at(low[p], who, x[:, p] & 0xFFFFFFFF)
        if n.any() and width:
            every = [np.arange(books.size, dtype=np.int32), high.ravel(), low.ravel(), np.repeat(n.ravel(), width)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in every], ["at", "high", "low", "n"])
        give_back()

    return run


def coder(books: np.ndarray) -> callable:
    """Code and error of each vector."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts, _, width = books.shape
        for v in batches:
            x = np.stack(v.to_numpy()).astype(np.int64).reshape(len(v), parts, width) if len(v) else np.zeros((0, parts, width), dtype=np.int64)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            code = np.stack([who for who, _ in found], axis=1).astype(np.uint8)
            error = sum(d.astype(object) for _, d in found)
            yield pd.DataFrame({"code": [c.tobytes().hex() for c in code], "error": np.array([min(int(e), MOST) for e in error], dtype=np.int64)})
        give_back()

    return run


def compress(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ("label",)) -> Coded:
    """Codes and errors of all vectors, and the codebooks that ``ROUNDS`` rounds lead to; ``keep`` names columns that stay beside the id."""
    spark = table.sparkSession
    small_batches(spark)
    held = F.lit(HELD).cast("long")
    whole = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.greatest(-held, F.least(held, F.floor(x * SCALE))))
    rows = table.select(F.struct(*[F.col(f"`{c}`") for c in (id_col, *keep)]).alias("kept"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("raw"), whole.alias("v"))
    rows = stored(rows.filter(finite(F.col("raw"))).drop("raw"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is None:
        return Coded(rows.select("kept.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [[] for _ in range(PARTS)])
    width = -(-most // PARTS)
    if least < PARTS * width:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(PARTS * width) - F.size("v"))))
    start = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    books = np.array(start, dtype=np.int64).reshape(len(start), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        sums = rows.select("v").mapInArrow(part_sums(books), SUMS).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")])
        flat = books.ravel().copy()
        for r in sums.filter("n > 0").collect():  # as many as codebooks have components
            flat[r["at"]] = ((r["high"] << 32) + r["low"]) // r["n"]
        books = flat.reshape(books.shape)
    coded = rows.withColumn("c", F.pandas_udf(coder(books), "code string, error long")("v"))
    return Coded(coded.select("kept.*", "c.code", "c.error"), books.tolist())


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``label_error``: the errors of all rows of equal label (null is a label, too) added up."""
    return add_totals(coded, F.col(f"`{label}`"), F.col("error"), "label_error", MOST)
