"""Tables that writes persist in: Parquet files, and a numbered commit that says which of them make up each table.

A table is dealt into buckets by the hash of its key. A write rewrites the buckets that its rows fall into and no others, as new
files; nothing is changed in place. A change gathers writes to any number of tables, reads its own writes, and becomes visible with
one file, ``commits/<number>.json``, which can be made once only: of two changes that want the same number one has to look
again. It goes on if the other one has touched none of its buckets, and is refused with ``Conflict`` if it has. A change that
ends before its commit leaves the tables as they are, and files that no commit names, which ``expire`` removes.

Rows never pass through the driver; it reads and writes commits, whose size grows with the number of buckets and appended parts.
The folder has to be one that all executors and the driver share. A commit relies on making a file that must not exist: a hard link on
a local disk, a rename elsewhere (HDFS refuses to rename onto a file; object stores that overwrite are not suited).

Reads are of one version (the newest, or any that was not expired). Conflicts are told for what a change writes, not for what it reads.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bucket of rows that are appended to a table without a key.
BUCKET, ANY = "__bucket", 0


class Conflict(RuntimeError):
    """Another change has written what this one wants to write."""


@dataclass(frozen=True)
class Table:
    """parts: for each bucket that has rows, the folders that hold them."""

    schema: T.StructType
    key: tuple[str, ...] = ()
    buckets: int = 1
    parts: dict[int, tuple[str, ...]] = field(default_factory=dict)

    def told(self) -> dict:
        return {"schema": self.schema.jsonValue(), "key": list(self.key), "buckets": self.buckets, "parts": {str(b): list(p) for b, p in self.parts.items()}}

    @classmethod
    def of(cls, told: dict) -> Table:
        return cls(T.StructType.fromJson(told["schema"]), tuple(told["key"]), told["buckets"], {int(b): tuple(p) for b, p in told["parts"].items()})

    def shape(self) -> tuple:
        return self.schema, self.key, self.buckets


@dataclass(frozen=True)
class Snapshot:
    """What a commit says; streams: the last batch of each stream that wrote."""

    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    note: str = ""
    at: str = ""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest commit, or the one of this number; without any commit there are no tables."""
        have = self.versions()
        if version is None and not have:
            return Snapshot()
        at = have[-1] if version is None else version
        if at not in have:
            raise KeyError(f"version {at} is not kept; the oldest is {have[0] if have else 'none'}")
        stream = self._fs.open(self._path(self._commit(at)))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(at, {n: Table.of(t) for n, t in told["tables"].items()}, told["streams"], told["note"], told["at"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.rows(self.snapshot(version).tables[name])

    def rows(self, table: Table, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table; columns that were added after a file was written are null."""
        paths = [f"{self.root}/{p}" for b, parts in sorted(table.parts.items()) if buckets is None or b in buckets for p in parts]
        return self.spark.read.schema(table.schema).parquet(*paths) if paths else self.spark.createDataFrame([], table.schema)

    def begin(self) -> Change:
        return Change(self, self.snapshot())

    def history(self) -> DataFrame:
        """(version, note, at) of the commits that are kept."""
        rows = [(s.version, s.note, s.at) for s in map(self.snapshot, self.versions())]
        return self.spark.createDataFrame(rows, "version int, note string, at string")

    def expire(self, keep: int = 30, idle_hours: float = 24.0) -> int:
        """Forgets all but the newest ``keep`` commits, and deletes folders that none of these names; returns how many folders went.

        Folders that were made less than ``idle_hours`` ago stay: a change may be about to commit them.
        """
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(self._commit(v)), False)
        named = {p.split("/")[1] for v in self.versions() for t in self.snapshot(v).tables.values() for parts in t.parts.values() for p in parts}
        folder = self._path(f"{self.root}/data")
        oldest = (dt.datetime.now(dt.UTC).timestamp() - idle_hours * 3600) * 1000
        gone = [s.getPath() for s in (self._fs.listStatus(folder) if self._fs.exists(folder) else []) if s.getPath().getName() not in named and s.getModificationTime() <= oldest]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def _commit(self, version: int) -> str:
        return f"{self.root}/commits/{version:010d}.json"

    def _publish(self, s: Snapshot) -> bool:
        """Makes the commit, unless one of its number is there already."""
        told = {"tables": {n: t.told() for n, t in s.tables.items()}, "streams": s.streams, "note": s.note, "at": s.at}
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(self._commit(s.version))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        else:
            done = not self._fs.exists(final) and self._fs.rename(draft, final)
        self._fs.delete(draft, False)
        return done


class Change:
    """Writes that become visible together. Files are written at once, tables of the store change with ``commit``."""

    def __init__(self, store: Store, base: Snapshot) -> None:
        self.store, self.base = store, base
        self.tables, self.streams = dict(base.tables), dict(base.streams)
        self._rewritten: dict[str, set[int]] = {}
        self._added: dict[str, dict[int, tuple[str, ...]]] = {}
        self._reshaped: set[str] = set()
        self._batches: set[str] = set()
        self._writes = 0
        self._folder = f"data/{uuid.uuid4().hex}"

    def read(self, name: str) -> DataFrame:
        """The table as this change has it so far."""
        return self.store.rows(self.tables[name])

    def create(self, name: str, schema: T.StructType | str, key: tuple[str, ...] = (), buckets: int = 16) -> bool:
        """A new table, unless there is one of that name. Without a key it can be appended to only."""
        if name in self.tables:
            return False
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.tables[name] = Table(schema, tuple(key), buckets if key else 1)
        self._reshaped.add(name)
        return True

    def add_column(self, name: str, column: str, kind: str) -> bool:
        """Adds a column that is null in all rows, unless the table has one of that name."""
        t = self.tables[name]
        if column in t.schema.names:
            return False
        self.tables[name] = replace(t, schema=T.StructType([*t.schema.fields, T.StructField(column, T.StructType.fromDDL(f"x {kind}")[0].dataType)]))
        self._reshaped.add(name)
        return True

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a table without a key."""
        t = self.tables[name]
        if t.key:
            raise ValueError(f"{name} has a key; use insert or replace")
        path = self._next()
        self._typed(t, rows).write.parquet(f"{self.store.root}/{path}")
        self.tables[name] = replace(t, parts=t.parts | {ANY: (*t.parts.get(ANY, ()), path)})
        own = self._added.setdefault(name, {})
        own[ANY] = (*own.get(ANY, ()), path)

    def insert(self, name: str, rows: DataFrame, order: list[Column]) -> None:
        """Adds rows whose key is new, the first of each key; a row that is there stays."""
        key = list(self.tables[name].key)
        self._merged(name, self._one_each(name, rows, order), lambda old, new: old.unionByName(new.join(old.select(*key), key, "left_anti")))

    def replace(self, name: str, rows: DataFrame, order: list[Column]) -> None:
        """Rows take the place of those with the same key; of rows with one key the first in the order."""
        key = list(self.tables[name].key)
        self._merged(name, self._one_each(name, rows, order), lambda old, new: old.join(new.select(*key), key, "left_anti").unionByName(new))

    def merge(self, name: str, rows: DataFrame, order: list[Column], matched: dict[str, Column]) -> None:
        """Adds rows whose key is new; a row that is there gets the columns ``matched``, told from ``old.`` and ``new.`` columns."""
        t = self.tables[name]
        others = [c for c in t.schema.names if c not in t.key]

        def both(old: DataFrame, new: DataFrame) -> DataFrame:
            a, b = old.alias("old"), new.alias("new")
            on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in t.key]
            is_new, is_old = F.col(f"old.{t.key[0]}").isNull(), F.col(f"new.{t.key[0]}").isNull()
            cell = lambda c: F.when(is_new, F.col(f"new.{c}")).when(is_old, F.col(f"old.{c}")).otherwise(matched.get(c, F.col(f"old.{c}"))).alias(c)
            return a.join(b, on, "full").select(*[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in t.key], *[cell(c) for c in others])

        self._merged(name, self._one_each(name, rows, order), both)

    def update(self, name: str, values: dict[str, Column], where: Column) -> None:
        """Sets columns of the rows for which ``where`` holds; only their buckets are rewritten."""
        hit = F.coalesce(where, F.lit(False))
        self._rewrite(name, self.read(name).filter(hit), lambda old: old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, name: str, where: Column) -> None:
        hit = F.coalesce(where, F.lit(False))
        self._rewrite(name, self.read(name).filter(hit), lambda old: old.filter(~hit))

    def delete_keys(self, name: str, keys: DataFrame) -> None:
        """Takes away the rows whose key is among ``keys``."""
        t = self.tables[name]
        self._rewrite(name, keys, lambda old: old.join(keys.select(*t.key).distinct(), list(t.key), "left_anti"))

    def batch(self, stream: str, number: int) -> bool:
        """Notes a batch of a stream with this change; false if that batch was committed before."""
        if self.streams.get(stream, -1) >= number:
            return False
        self.streams[stream] = number
        self._batches.add(stream)
        return True

    def commit(self, note: str = "") -> int:
        """Makes all writes visible at once and returns the new version."""
        while True:
            now = self.store.snapshot()
            if now.version == self.base.version:
                tables, streams = self.tables, self.streams
            else:
                tables, streams = self._carried(now), now.streams | {s: self.streams[s] for s in self._batches}
            s = Snapshot(now.version + 1, tables, streams, note, dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))
            if self.store._publish(s):
                return s.version

    def _carried(self, now: Snapshot) -> dict[str, Table]:
        """The tables of a later commit with this change's writes, if that one has left alone what this one writes."""
        for s in self._batches:
            if now.streams.get(s) != self.base.streams.get(s):
                raise Conflict(f"stream {s} has committed another batch")
        out = dict(now.tables)
        for name in {*self._rewritten, *self._added, *self._reshaped}:
            before, theirs, mine = self.base.tables.get(name), now.tables.get(name), self.tables[name]
            if (before and before.shape()) != (theirs and theirs.shape()):
                raise Conflict(f"the columns of {name} have changed")
            parts = dict(theirs.parts) if theirs else {}
            for b in self._rewritten.get(name, ()):
                if parts.get(b, ()) != (before.parts.get(b, ()) if before else ()):
                    raise Conflict(f"bucket {b} of {name} was written by version {now.version} or one before it")
                parts[b] = mine.parts.get(b, ())
            for b, paths in self._added.get(name, {}).items():
                parts[b] = (*parts.get(b, ()), *paths)
            out[name] = replace(mine, parts={b: p for b, p in parts.items() if p})
        return out

    def _next(self) -> str:
        self._writes += 1
        return f"{self._folder}/{self._writes}"

    def _typed(self, t: Table, rows: DataFrame) -> DataFrame:
        """The columns of the table; those that rows lack are null."""
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema])

    def _bucket(self, t: Table) -> Column:
        return F.pmod(F.xxhash64(*t.key), F.lit(t.buckets)).cast("int")

    def _one_each(self, name: str, rows: DataFrame, order: list[Column]) -> DataFrame:
        """The first row of each key, kept as files since it is read twice."""
        t = self.tables[name]
        if not t.key:
            raise ValueError(f"{name} has no key; use append")
        first = rows.withColumn("__n", F.row_number().over(W.partitionBy(*t.key).orderBy(*order))).filter("__n = 1")
        path = f"{self.store.root}/{self._next()}"
        self._typed(t, first).dropna(subset=list(t.key)).write.parquet(path)
        return self.store.spark.read.schema(t.schema).parquet(path)

    def _merged(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self._rewrite(name, rows, lambda old: merge(old, rows))

    def _rewrite(self, name: str, touching: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """New files for the buckets that ``touching`` falls into, from what ``make`` makes of their rows."""
        t = self.tables[name]
        if not t.key:
            raise ValueError(f"{name} has no key and can only be appended to")
        buckets = sorted(r[0] for r in touching.select(self._bucket(t).alias("b")).distinct().collect())  # as many as buckets at most
        if not buckets:
            return
        path = self._next()
        made = self._typed(t, make(self.store.rows(t, buckets))).withColumn(BUCKET, self._bucket(t))
        made.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.root}/{path}")
        have = {b: f"{path}/{BUCKET}={b}" for b in buckets if self.store._fs.exists(self.store._path(f"{self.store.root}/{path}/{BUCKET}={b}"))}
        parts = {b: p for b, p in t.parts.items() if b not in buckets} | {b: (p,) for b, p in have.items()}
        self.tables[name] = replace(t, parts=parts)
        self._rewritten.setdefault(name, set()).update(buckets)
