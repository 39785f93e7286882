"""A walk over folders that reads each file once: new files come as a stream, contents that are known are not passed on.

The stream's checkpoint knows the paths that were read, so a later run opens new files only. The table ``kb_contents`` of the store has the
first path of each content, ``kb_paths`` every path with its content, size and time. Files that were rewritten in place, which the
stream does not see, are found by size and time (a listing, no content is read) and read with the files that are newer than the last walk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.sources.store import Change, Store
from syllabrook.streaming.logs import Write, once

CONTENTS, PATHS = "kb_contents", "kb_paths"
BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
FILES = "path STRING, content_hash STRING, length BIGINT, modified TIMESTAMP, walk BIGINT"

#: Makes records of the files (path, content) of new contents.
Extract = Callable[[DataFrame], DataFrame]


def make_registry(store: Store, records: str | None = None, schema: str | None = None, buckets: int = 16) -> None:
    """The registry's tables, and a log for records where one is named."""
    change = store.begin()
    made = [change.create(CONTENTS, FILES, ("content_hash",), buckets), change.create(PATHS, FILES, ("path",), buckets)]
    if records:
        made.append(change.create(records, schema))
    if any(made):
        change.commit("registry of files")


def walk(store: Store, roots: list[str], checkpoint: str, glob: str = "*", extract: Extract | None = None, records: str | None = None, files_at_a_time: int = 1000) -> None:
    """Reads what is new below the roots, then what was rewritten; ``extract`` turns new contents into rows of ``records``, in the same commit."""
    stream(store, roots, checkpoint, glob, lambda c, b, n: registered(c, b, n, extract, records), files_at_a_time)
    rewritten(store, roots, glob, extract, records)


def stream(store: Store, roots: list[str], checkpoint: str, glob: str, write: Write, files_at_a_time: int = 1000) -> None:
    """Hands the files that were not read yet to ``write``, some at a time, each batch with one commit."""
    reader = lambda r: store.spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_a_time).option("maxFileAge", "36500d").load(r)
    files = reduce(DataFrame.unionByName, [reader(r) for r in roots])
    files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(once(store, CONTENTS, write)).trigger(availableNow=True).start().awaitTermination()


def registered(change: Change, files: DataFrame, number: int, extract: Extract | None = None, records: str | None = None) -> None:
    """Files of a batch in the registry, and records of those contents that it did not have."""
    told = files.select("path", F.sha2("content", 256).alias("content_hash"), "length", F.col("modificationTime").alias("modified"), F.lit(number).cast("long").alias("walk"))
    change.replace(PATHS, told, [F.asc("path")])
    # From here on the hashes that were written are read, not the files again.
    seen = change.read(PATHS).filter(F.col("walk") == number).join(files.select("path"), "path", "left_semi")
    first = seen.groupBy("content_hash").agg(F.min("path").alias("path"))
    new = first.join(change.read(CONTENTS).select("content_hash"), "content_hash", "left_anti")
    fresh = change.store.spark.createDataFrame([], "path string") if extract is None else new.select("path")
    if extract is not None and records is not None:
        change.append(records, extract(files.join(fresh, "path", "left_semi").select("path", "content")))
    change.insert(CONTENTS, seen, [F.asc("path")])


def rewritten(store: Store, roots: list[str], glob: str = "*", extract: Extract | None = None, records: str | None = None) -> int:
    """Reads the files of the registry again whose size or time has changed; returns how many there were."""
    spark = store.spark
    found = changed(spark, roots, store.read(PATHS), glob)
    since = found.agg(F.count("*"), F.min("modified")).first()
    if not since[0]:
        return 0
    # The time narrows the listing, so only files that are as new as the oldest of the changed ones are opened.
    parts = [spark.read.schema(BINARY).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(r).filter(F.col("modificationTime") >= F.lit(since[1])) for r in roots]
    files = reduce(DataFrame.unionByName, parts).dropDuplicates(["path"]).join(found.select("path"), "path", "left_semi")
    change = store.begin()
    registered(change, files, -change.base.version - 1, extract, records)
    change.commit(f"{since[0]} rewritten files")
    return since[0]


def changed(spark: SparkSession, roots: list[str], known: DataFrame, glob: str = "*") -> DataFrame:
    """(path, modified): known files whose size or time is another one now. Contents are not read."""
    parts = [spark.read.schema(BINARY).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(r).select("path", "length", F.col("modificationTime").alias("modified")) for r in roots]
    now = reduce(DataFrame.unionByName, parts).dropDuplicates(["path"]).alias("now")
    both = now.join(known.alias("known"), F.col("now.path") == F.col("known.path"))
    return both.filter((F.col("now.length") != F.col("known.length")) | (F.col("now.modified") != F.col("known.modified"))).select("now.path", "now.modified")


def copies(paths: DataFrame) -> DataFrame:
    """(path, original): files whose content another path has had before, told from ``kb_paths``."""
    first = F.first("path").over(W.partitionBy("content_hash").orderBy("walk", "path"))
    return paths.withColumn("original", first).filter(F.col("path") != F.col("original")).select("path", "original")
