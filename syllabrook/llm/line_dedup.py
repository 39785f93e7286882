"""Reversible line dedup: sharded cuckoo filters of repeated lines, backed by exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least ``min_length`` code points
count. An index holds three tables:

* references: one row for each document and key in it, with the numbers of the lines (keys travel as digests of 128 bits);
* counts: exact numbers of documents by key, combined before they are shuffled;
* filters: a cuckoo filter for each shard of the keys, with those keys that ``min_docs`` documents or more hold.

``insert`` adds documents: counts are added up, and keys that have reached ``min_docs`` enter the filter of their shard.
``delete`` takes documents out again: keys that fall below it leave the filter. A shard whose filter gets too full is
built anew from the exact counts. ``drops`` sends references past the filters of their shards (a shard is dealt out in
pieces, each of which gets the filter), and only what passes is held against the exact counts; so the few false finds of
a filter change nothing. Of a key that ``min_docs`` documents hold, all lines go except those in the largest doc_id.
Every step is an ordinary DataFrame job over stored tables; no text, key or reference travels through the driver.

Cases: a null or empty text is one empty line. Each row is a document, also where ids repeat: rows of equal id count each,
and all rows of the largest id keep their lines. A null id is smaller than all others; if only null ids hold a key, all
keep it. ``delete`` takes all rows with a given id. Lines split at \\n only; the last line may be empty. Without rows there are no
lines. Columns named in ``keep`` stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.llm.common import HOT_SHARE, add_row_id, give_back, small_batches, stored
from syllabrook.llm.cuckoo import FULL, SLOTS, Cuckoo

MIN_LENGTH, MIN_DOCS = 20, 3
BLANKS = b" \t\n\x0b\x0c\r"
#: Keys of a shard's filter, references of a piece of a shard, rows that a task sends on at once.
SHARD_KEYS, PIECE, CHUNK = 1 << 17, 1 << 21, 1 << 13
REFERENCES = "row long, key binary, lines array<int>"
FILTERS = "shard int, n long, buckets int, cells binary, spare binary"


def keyed_lines(text: str | None, min_length: int) -> dict[bytes, list[int]]:
    """Digest of each key of the text: numbers of the lines that have it."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(BLANKS).lower()
        if len(key) >= min_length and (key.isascii() or len(key) >= 4 * min_length or len(key.decode("utf-8", "surrogatepass")) >= min_length):
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
    return found


def line_keys(min_length: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, lines = [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                for key, at in keyed_lines(text.as_py(), min_length).items():
                    rows.append(row)
                    keys.append(key)
                    lines.append(at)
                    if len(rows) == CHUNK:
                        yield _references(rows, keys, lines)
                        rows, keys, lines = [], [], []
            yield _references(rows, keys, lines)
        give_back()

    return run


def _references(rows: list, keys: list, lines: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], ["row", "key", "lines"])


def _digests(keys: pa.Array) -> np.ndarray:
    """Keys of an Arrow batch as rows of two numbers."""
    raw = b"".join(k for k in keys.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 2)


def _stored_filter(shard: int, c: Cuckoo) -> tuple:
    return shard, c.n, len(c.cells), c.cells.tobytes(), np.array(c.spare, dtype=np.int64).reshape(-1, 2).tobytes()


def _loaded(n: int, buckets: int, cells: bytes, spare: bytes) -> Cuckoo:
    return Cuckoo(buckets, np.frombuffer(cells, dtype=np.uint16).reshape(buckets, -1).copy(), np.frombuffer(spare, dtype=np.int64).reshape(-1, 2), n)


def _by_shard(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(shard, kind, part of a batch), from rows that are sorted by these columns."""
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            if b > a:
                yield *(int(x) for x in at[:, a]), batch.slice(a, b - a)


#: Kinds of rows that reach a shard, in this order: its filter, how large a new one has to be, keys to delete, to insert.
OLD, NEW, OUT, IN = range(4)


def changed_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters after the changes: rows of a shard come as OLD or NEW, then OUT, then IN."""
    shard, now = None, None
    for at, kind, part in _by_shard(batches, ("shard", "kind")):
        if at != shard:
            if now:
                yield _filter_batch([_stored_filter(shard, now)])
            shard, now = at, None
        if kind == OLD:
            r = part.to_pylist()[0]
            now = _loaded(r["n"], r["buckets"], r["cells"], r["spare"])
        elif kind == NEW:
            now = Cuckoo(part.to_pylist()[0]["buckets"])
        elif kind == OUT:
            now.delete(_digests(part.column("key")))
        else:
            now.insert(_digests(part.column("key")))
    if now:
        yield _filter_batch([_stored_filter(shard, now)])
    give_back()


def _filter_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["shard", "n", "buckets", "cells", "spare"])


def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References whose key the filter of their shard may hold; a piece of a shard starts with the filter."""
    piece, now = None, None
    for shard, number, is_reference, part in _by_shard(batches, ("shard", "piece", "is_reference")):
        if (shard, number) != piece:
            piece, now = (shard, number), None
        if not is_reference:
            r = part.to_pylist()[0]
            now = _loaded(r["n"], r["buckets"], r["cells"], r["spare"])
        elif now and now.n:
            good = pa.array(now.has(_digests(part.column("key"))))
            yield part.select(["row", "key", "lines"]).filter(good)
    give_back()


@dataclass
class LineIndex:
    """documents: row, doc_id; references, counts, filters: see above; shards: of the keys, fixed when the index is made."""

    documents: DataFrame
    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_length: int
    min_docs: int

    TABLES = ("documents", "references", "counts", "filters")

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, id_type: str = "long", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> LineIndex:
        make = lambda schema: spark.createDataFrame([], schema)
        return cls(make(f"row long, doc_id {id_type}"), make(REFERENCES), make("key binary, n long"), make(FILTERS), shards, min_length, min_docs)

    def insert(self, rows: DataFrame) -> LineIndex:
        """With the documents of ``rows`` (row, doc_id, text); a row number must not be in the index yet."""
        small_batches(rows.sparkSession)
        added = stored(rows.select("row", "text").mapInArrow(line_keys(self.min_length), REFERENCES))
        delta = added.groupBy("key").agg(F.count("*").alias("n"))
        return self._changed(self.documents.unionByName(rows.select("row", "doc_id")), self.references.unionByName(added), delta)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents whose id is in ``ids`` (doc_id)."""
        ids = ids.select(F.col("doc_id").alias("gone")).distinct()
        gone = stored(self.documents.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("row"))
        delta = self.references.join(gone, "row", "left_semi").groupBy("key").agg((-F.count("*")).alias("n"))
        return self._changed(self.documents.join(gone, "row", "left_anti"), self.references.join(gone, "row", "left_anti"), delta)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _changed(self, documents: DataFrame, references: DataFrame, delta: DataFrame) -> LineIndex:
        both = self.counts.select("key", F.col("n").alias("before"), F.lit(0).cast("long").alias("change")).unionByName(delta.select("key", F.lit(0).cast("long").alias("before"), F.col("n").alias("change")))
        merged = stored(both.groupBy("key").agg(F.sum("before").alias("before"), (F.sum("before") + F.sum("change")).alias("n")).filter("before > 0 or n > 0").withColumn("shard", self._shard()))
        enough = F.lit(self.min_docs)
        live = merged.filter(F.col("n") >= enough)
        # One row a shard: what it has to hold, and whether the filter that is there has room for it.
        need = live.groupBy("shard").agg(F.count("*").alias("need")).join(self.filters.select("shard", "buckets"), "shard", "full")
        need = need.withColumn("need", F.coalesce("need", F.lit(0)))
        room = F.coalesce(F.col("buckets") >= _buckets(F.col("need")), F.lit(False))
        stays, grows = need.filter(room).select("shard"), need.filter(~room).select("shard", _buckets(F.col("need")).alias("buckets"))
        blank = {"kind": F.lit(NEW), "key": F.lit(None).cast("binary"), "n": F.lit(0).cast("long"), "cells": F.lit(None).cast("binary"), "spare": F.lit(None).cast("binary")}
        order = ["shard", "kind", "key", "n", "buckets", "cells", "spare"]
        keys = lambda df, kind: df.select("shard", "key").withColumns({**{c: blank[c] for c in ("n", "cells", "spare")}, "kind": F.lit(kind), "buckets": F.lit(None).cast("int")}).select(*order)
        inputs = [
            self.filters.join(stays, "shard", "left_semi").withColumns({"kind": F.lit(OLD), "key": blank["key"]}).select(*order),
            grows.withColumns(blank).select(*order),
            keys(merged.filter((F.col("before") >= enough) & (F.col("n") < enough)).join(stays, "shard", "left_semi"), OUT),
            keys(live.filter(F.col("before") < enough).join(stays, "shard", "left_semi"), IN),
            keys(live.join(grows.select("shard"), "shard", "left_semi"), IN),
        ]
        every = inputs[0]
        for df in inputs[1:]:
            every = every.unionByName(df)
        filters = stored(every.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(changed_filters, FILTERS))
        return LineIndex(documents, references, merged.filter("n > 0").select("key", "n"), filters, self.shards, self.min_length, self.min_docs)

    def repeated(self) -> DataFrame:
        """(row, key, lines): references whose key passes the filter of its shard."""
        pieces = max(1, -(-self.references.count() // (3 * PIECE)))
        refs = self.references.withColumns({"shard": self._shard(), "piece": F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int"), "is_reference": F.lit(1)})
        filters = self.filters.filter("n > 0").withColumns({"piece": F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))), "is_reference": F.lit(0)})
        every = refs.unionByName(filters, allowMissingColumns=True)
        columns = [*refs.columns, "n", "buckets", "cells", "spare"]
        return every.select(*columns).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "is_reference").mapInArrow(passing, REFERENCES)

    def drops(self) -> DataFrame:
        """(row, drop): for each document that loses lines, their numbers, ascending."""
        found = stored(self.repeated().join(self.documents, "row"))
        counts = found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest")).filter(F.col("n") >= self.min_docs)
        counts = stored(counts)
        hot_from = HOT_SHARE * (counts.agg(F.sum("n")).first()[0] or 0)
        hot, rest = F.broadcast(counts.filter(F.col("n") > hot_from)), counts.filter(F.col("n") <= hot_from)
        lost = found.join(hot, "key").unionByName(found.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key"))
        lost = lost.filter(F.col("doc_id").isNull() & F.col("largest").isNotNull() | (F.col("doc_id") < F.col("largest")))
        return lost.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("drop"))

    def save(self, path: str) -> None:
        """Writes the index; ``path`` must not exist."""
        for t in self.TABLES:
            getattr(self, t).write.parquet(f"{path}/{t}")
        self.documents.sparkSession.createDataFrame([(self.shards, self.min_length, self.min_docs)], "shards int, min_length int, min_docs int").coalesce(1).write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        s = spark.read.parquet(f"{path}/settings").first()
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in cls.TABLES], s["shards"], s["min_length"], s["min_docs"])


def _buckets(n: Column) -> Column:
    """The smallest power of two, at least 4, with room for n keys."""
    return F.element_at(F.filter(F.array(*[F.lit(1 << i) for i in range(2, 29)]), lambda b: b >= n / F.lit(FULL * SLOTS)), 1)


def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The text without the dropped lines, and numbers of lines."""
    for texts, drops in batches:
        kept, n, dropped = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            lines = (text or "").split("\n")
            n.append(len(lines))
            gone = [] if drop is None else drop.tolist()
            dropped.append(len(gone))
            for i in gone:
                lines[i] = None
            kept.append("\n".join(line for line in lines if line is not None))
        yield pd.DataFrame({"n_lines": np.array(n, dtype=np.int64), "n_dropped": np.array(dropped, dtype=np.int64), "kept": kept})
    give_back()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, columns, n_lines, n_dropped, kept) of every document, from an index into which all of them are inserted."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).cast("string").alias("none")]).alias("columns")
    rows = stored(add_row_id(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), kept), "row"))
    # No more keys than this can count, however texts are cut into lines.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (min_length * SHARD_KEYS)))
    index = LineIndex.empty(spark, shards, rows.schema["doc_id"].dataType.simpleString(), min_length, min_docs).insert(rows)
    done = rows.join(index.drops(), "row", "left").withColumn("c", F.pandas_udf(cut, "n_lines long, n_dropped long, kept string")("text", "drop"))
    return done.select("doc_id", "columns", "c.n_lines", "c.n_dropped", "c.kept")
