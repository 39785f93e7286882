"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that they share every folder."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


#: Folders that executors were seen to share with the driver, by application.
SHARED: set[tuple[str, str]] = set()


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only on a single machine, and only where it
    is unset (tests), a temporary folder takes its place; anywhere else a missing setting is an error, since
    executors would write to disks of their own and what the others read would silently be short.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="syllabrook-")
        spark.conf.set("spark.checkpoint.dir", base)
    base = f"{base.rstrip('/')}/syllabrook"
    at = (spark.sparkContext.applicationId, base)
    if at not in SHARED and not on_one_machine(spark):
        _seen_by_all(spark, f"{base}/{uuid.uuid4().hex}")
    SHARED.add(at)
    return f"{base}/{uuid.uuid4().hex}"


def _seen_by_all(spark: SparkSession, path: str) -> None:
    """Raises unless every row that the executors write to ``path`` can be read again."""
    n = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, n, 1, n)
    rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path).count()
    drop(spark, [path])
    if found != n:
        raise RuntimeError(f"{path} is not shared by all executors: {found} of {n} rows were read again")


#: Paths of the tables that ``stored`` has written, for those who know when none of them is read any more.
MADE: list[str] = []


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables; whatever was derived from them must have been written elsewhere."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in MADE:
            MADE.remove(p)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what lies before, and whoever reads the
    result twice does not compute it twice.
    """
    spark = df.sparkSession
    path = scratch(spark)
    MADE.append(path)
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there):
        raise RuntimeError(f"nothing of what was written to {path} can be read: the folder is not shared")
    return spark.read.schema(df.schema).parquet(path)


class Packed:
    """Arrays that are compressed whenever they are sent or kept on disk, for broadcasting."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.arrays = arrays

    def __getstate__(self) -> list[tuple]:
        return [(zlib.compress(a, 1), a.dtype.str) for a in self.arrays]

    def __setstate__(self, state: list[tuple]) -> None:
        self.arrays = []
        while state:
            raw, kind = state.pop(0)
            self.arrays.append(np.frombuffer(zlib.decompress(raw), dtype=kind))


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds: rows and bytes of an Arrow batch, unless the session sets them."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(2 << 20))):
        if spark.conf.get(key, usual) in (usual, "9223372036854775807", "-1", "2147483647"):
            spark.conf.set(key, value)


def give_back() -> None:
    """Returns freed memory of this Python worker, which lives on between stages, to the system (where the C library can).

    Arrow and the C library each keep a pool of their own.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: ASCII white space, and the lower case of each byte.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: An odd factor and its inverse modulo 2**64, and their powers as far as any text has needed, up to KEPT_POWERS of them.
BASE = 0xD6E8FEB86659FD93
KEPT_POWERS = 1 << 17
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    made = _POWERS
    if not made or len(made[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        made = [np.cumprod(np.full(size, x, dtype=np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64))]
        if size <= KEPT_POWERS:
            _POWERS[:] = made
    return made[0][:n], made[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8 text: a polynomial of its bytes, mixed."""
    buf = np.frombuffer(text, dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([1], BLANK[buf], [1])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(buf) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(up[:-1] * (buf + np.uint64(1)))))
    h = (sums[end] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc32_of(doc_id: Column) -> Column:
    """crc32 of the id as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc_mod(doc_id: Column, n: int) -> Column:
    return crc32_of(doc_id) % n


def add_row_id(df: DataFrame, name: str = "__row") -> DataFrame:
    """A key for each row, also where ids repeat or are null. It depends on the input's partitions only."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: A key with more than this share of all rows is hot; there are fewer hot keys than one by it.
HOT_SHARE = 0.001


def add_totals(df: DataFrame, key: Column, value: Column, name: str, most: int) -> DataFrame:
    """``df`` with the sum of ``value`` (at most ``most``) over all rows of equal key, null being a key.

    Sums are combined before they are shuffled. They come back to the rows of hot keys, fewer than 1 / HOT_SHARE,
    by broadcast, and to all others by a join in which no key holds more than HOT_SHARE of the rows.
    """
    rows = stored(df.withColumn("__key", F.coalesce(F.sha2(key.cast("string").cast("binary"), 256), F.lit(""))))
    total = F.least(F.sum(value.cast("decimal(38,0)")), F.lit(most).cast("decimal(38,0)")).cast("long")
    totals = stored(rows.groupBy("__key").agg(total.alias(name), F.count("*").alias("__n")))
    hot_from = HOT_SHARE * (totals.agg(F.sum("__n")).first()[0] or 0)
    hot = F.broadcast(totals.filter(F.col("__n") > hot_from).drop("__n"))
    rest = totals.filter(F.col("__n") <= hot_from).drop("__n")
    cold = rows.join(F.broadcast(hot.select("__key")), "__key", "left_anti").join(rest, "__key")
    return rows.join(hot, "__key").unionByName(cold).drop("__key")
