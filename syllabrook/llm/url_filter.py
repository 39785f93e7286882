"""URL filter: a blocked Bloom filter in front of an exact hash join.

Rules name a host and a path prefix. A url can match a rule only through one of few *candidate keys*: a
suffix of its host with as many labels as some rule's host, followed by a prefix of its path as long as
that rule's path; all of a page's keys come from one expression, however many such shapes the rules have.
The blocked Bloom filter holds the keys of all rules; candidates that it lets pass go to an exact hash join
with the rules, which removes the false positives. Only distinct addresses with a possible hit are joined, so
a host that holds a third of all pages costs one row for each of its paths. Rules of up to ``BROADCAST`` bytes
are sent to every task; more are shuffled, each key dealt to ``SALTS`` places by the address that asks for it.

Cases: a null url, or one without ``://``, has empty host and path and matches nothing. Repeated pages
each get a row. An empty rule table gives every page the default verdict. Columns of the input named as
an output column are replaced. Two rules of the same host and path: ``block`` wins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabrook.llm.common import lower_ascii

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"
#: Bits of a filter block, and the bits set in each of its four words for a key.
BLOCK_WORDS, BITS_PER_WORD = 4, 2
#: A block for so many keys; the filter never exceeds max_blocks (32 bytes each), beyond which only the
#: share of false positives rises, which the join removes.
KEYS_PER_BLOCK = 16
#: Bytes of all rules up to which they are broadcast, and places of a key beyond that.
BROADCAST, SALTS = 8 << 20, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _mask(key: Column, word: int) -> Column:
    """The bits of one 64-bit word of the key's block."""
    h, out = F.xxhash64(key, F.lit(7)), F.lit(0).cast("long")
    for i in range(BITS_PER_WORD):
        bit = F.shiftright(h, 6 * (word * BITS_PER_WORD + i)).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def build_filter(rules: DataFrame, max_blocks: int = 1 << 20) -> np.ndarray:
    """The blocked Bloom filter of the rules' keys: an array (blocks, 4) of 64-bit words.

    Words of a block are or-ed where the rules are; at most ``max_blocks`` rows reach the driver.
    """
    n = rules.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n and blocks < max_blocks:
        blocks *= 2
    words = np.zeros((blocks, BLOCK_WORDS), dtype=np.uint64)
    key = F.col("key")
    found = (
        rules.select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).alias("block"), *[_mask(key, w).alias(f"w{w}") for w in range(BLOCK_WORDS)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(BLOCK_WORDS)])
    )
    for r in found.toLocalIterator():
        words[r["block"]] = np.array([r[f"w{w}"] for w in range(BLOCK_WORDS)], dtype=np.int64).view(np.uint64)
    return words


def may_contain(words: np.ndarray, block_hash: np.ndarray, bit_hash: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; the arguments are the two 64-bit hashes of the keys."""
    block = np.mod(block_hash.astype(np.int64), np.int64(len(words)))
    found = np.ones(len(block), dtype=bool)
    h = bit_hash.astype(np.int64)
    for w in range(BLOCK_WORDS):
        mask = np.zeros(len(block), dtype=np.uint64)
        for i in range(BITS_PER_WORD):
            mask |= np.uint64(1) << ((h >> np.int64(6 * (w * BITS_PER_WORD + i))) & np.int64(63)).astype(np.uint64)
        found &= (words[block, w] & mask) == mask
    return found


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_blocks: int = 1 << 20) -> DataFrame:
    """``pages`` with host, path, rule and verdict; the longest rule that fits wins."""
    spark = pages.sparkSession
    rules = rules.filter("host is not null and path is not null").select(F.concat("host", "path").alias("key"), "host", "path", "verdict")
    rules = rules.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("verdict").alias("verdict"))
    # As many shapes as pairs of label count and path length among the rules: a few thousand at most.
    shapes = [{"k": r[0], "n": r[1]} for r in rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect()]
    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    words = spark.sparkContext.broadcast(build_filter(rules, max_blocks))

    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blocks, bits in batches:
            n = blocks.str.len().to_numpy(dtype=np.int64)
            if not n.sum():
                yield pd.Series([[] for _ in n])
                continue
            hit = may_contain(words.value, np.concatenate(blocks.to_numpy()), np.concatenate(bits.to_numpy()))
            yield pd.Series(np.split(hit, np.cumsum(n)[:-1]))

    probe_udf = F.pandas_udf(probe, T.ArrayType(T.BooleanType()))
    labels = F.size(F.split("host", r"\."))
    told = F.from_json(F.lit(json.dumps(shapes)), "array<struct<k:int,n:int>>")  # one constant
    fits = F.filter(told, lambda s: (labels >= s["k"]) & (F.length("path") >= s["n"]))
    suffix = lambda s: F.call_function("substring_index", F.col("host"), F.lit("."), -s["k"])
    keys = F.transform(fits, lambda s: F.concat(suffix(s), F.substring(F.col("path"), F.lit(1), s["n"])))
    hits = (
        pages.select("host", "path")
        .distinct()
        .withColumn("keys", keys)
        .withColumn("hit", probe_udf(F.transform("keys", lambda x: F.xxhash64(x, F.lit(1))), F.transform("keys", lambda x: F.xxhash64(x, F.lit(7)))))
        .select("host", "path", F.explode(F.arrays_zip("keys", "hit")).alias("c"))
        .filter("c.hit")
        .select("host", "path", F.col("c.keys").alias("key"))
        .transform(lambda hits: _exact(hits, rules))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return pages.join(hits, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _exact(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits (host, path, key) whose key is a rule's, with its verdict."""
    rules = rules.select("key", "verdict")
    size = rules.agg(F.sum(F.octet_length("key") + F.octet_length(F.coalesce("verdict", F.lit(""))) + 64)).first()[0] or 0
    if size <= BROADCAST:
        return hits.join(F.broadcast(rules), "key")
    salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")
    return hits.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, RULE_SCHEMA)
