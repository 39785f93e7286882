"""Parsers over lines of a text: header state that carries on, numbered items, words on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, n, line): one row for each line, numbered from 0."""
    return df.select(*key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def carry(df: DataFrame, key: list[str], name: str, value: Column) -> DataFrame:
    """Adds ``name``: the last value that was not null, up to and with each line."""
    w = W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def blocks(df: DataFrame, key: list[str], starts: Column) -> DataFrame:
    """(key, block, text): lines joined from one start to the next; what stands before the first goes."""
    w = W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = df.withColumn("block", F.sum(starts.cast("int")).over(w)).filter("block > 0")
    b = b.groupBy(*key, "block").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return b.select(*key, "block", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def pages(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, page, body): a text cut at its ``[Page n …]`` marks; without any it is page 1."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\[Page \d+[^\]]*\]")
    marks = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[Page (\d+)[^\]]*\]"), F.lit(1)), lambda x: x.cast("int"))
    body = F.when(F.size(marks) == 0, F.arrays_zip(F.array(F.lit(1)).alias("page"), parts.alias("body"))).otherwise(F.arrays_zip(marks.alias("page"), F.slice(parts, 2, F.size(parts)).alias("body")))
    return df.select(*key, F.explode(body).alias("p")).select(*key, F.col("p.page").alias("page"), F.trim("p.body").alias("body"))


def page_range(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, first, last): the first page that matches ``start``, and the page before the first later match of ``end``, else the last page."""
    first = df.groupBy(key).agg(F.min(F.when(F.col("body").rlike(start), F.col("page"))).alias("first"), F.max("page").alias("most"))
    stop = df.join(first, key).filter(F.col("body").rlike(end) & (F.col("page") > F.col("first"))).groupBy(key).agg((F.min("page") - 1).alias("stop"))
    return first.join(stop, key, "left").select(key, "first", F.when(F.col("first").isNotNull(), F.coalesce("stop", "most")).alias("last"))


def page_of(offsets: DataFrame, page_lengths: DataFrame, key: str) -> DataFrame:
    """(key, at, page): the page on which each offset of the joined text lies (as-of join by one sorted union)."""
    w = W.partitionBy(key).orderBy("page")
    starts = page_lengths.withColumn("at", F.sum(F.col("length") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.select(key, F.coalesce("at", F.lit(0)).cast("long").alias("at"), "page", F.lit(0).alias("__k"))
    both = starts.unionByName(offsets.select(key, F.col("at").cast("long").alias("at"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("__k")))
    w = W.partitionBy(key).orderBy("at", "__k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("page", F.last("page", ignorenulls=True).over(w)).filter("__k = 1").drop("__k")


def word_lines(words: DataFrame, key: list[str], left: float, right: float, gap: float = 3.0) -> DataFrame:
    """(key, line, y, text): words within a band, in lines wherever y jumps by more than ``gap``."""
    w = W.partitionBy(*key).orderBy("y", "x")
    b = words.filter(F.col("x").between(left, right)).withColumn("__new", F.coalesce(F.col("y") - F.lag("y").over(w) > gap, F.lit(True)))
    b = b.withColumn("line", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    b = b.groupBy(*key, "line").agg(F.min("y").alias("y"), F.array_sort(F.collect_list(F.struct("x", "word"))).alias("w"))
    return b.select(*key, "line", "y", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def gutter(spans: DataFrame, key: str, low: int = 230, high: int = 320) -> DataFrame:
    """(key, middle, width): the widest run of whole x in the band that no span (x0, x1) covers; ties: the left one."""
    a = F.greatest(F.floor("x0"), F.lit(low)).cast("int")
    b = F.greatest(F.least(F.floor("x1"), F.lit(high)), F.greatest(F.floor("x0"), F.lit(low))).cast("int")
    size = high - low + 1
    words = [m.alias(f"__{i}") for i, m in enumerate(_masks(a - low, b - low, size))]
    # A key's spans are or-ed to a bit for each x, so a key has one row of fixed size however many spans it has.
    bits = spans.select(key, *words).groupBy(key).agg(*[F.bit_or(f"__{i}").alias(f"__{i}") for i in range(len(words))])
    drawn = F.substring(F.concat(*[F.rpad(F.reverse(F.bin(f"__{i}")), 64, "0") for i in range(len(words))]), 1, size)
    runs = bits.select(key, drawn.alias("__x")).withColumn("width", F.array_max(F.transform(F.split("__x", "1+"), F.length)).cast("long"))
    left = F.instr(F.col("__x"), F.repeat(F.lit("0"), F.col("width").cast("int"))) - 1 + low
    return runs.filter("width > 0").select(key, (left + (F.col("width") - 1) / 2).alias("middle"), "width")


def _masks(a: Column, b: Column, size: int) -> list[Column]:
    """Whole numbers from ``a`` to ``b`` as bits of as many words of 64 as ``size`` asks for."""
    out = []
    for start in range(0, size, 64):
        first, last = F.greatest(a - start, F.lit(0)), F.least(b - start, F.lit(63))
        ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 63 - (last - first))
        out.append(F.when(first <= last, F.call_function("shiftleft", ones, first)).otherwise(F.lit(0).cast("long")))
    return out


def choice_questions(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, number, stem, options): numbered items with all of (A) to (D), numbers rising by 1 to 6 each."""
    ls = lines(df, key, text)
    number = F.regexp_extract("line", r"^\s*(\d{1,3})[.)]\s+\S", 1).try_cast("int")
    ls = ls.withColumn("__q", number)
    kept = ls.filter("__q is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", F.col("__q").alias("q")))).alias("c"))
    start = F.struct(F.array().cast("array<struct<n:int,q:int>>").alias("kept"), F.lit(0).alias("last"))
    fold = lambda s, x: F.when((x["q"] > s["last"]) & (x["q"] <= s["last"] + 6), F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), x["q"].alias("last"))).otherwise(s)
    kept = kept.select(*key, F.explode(F.aggregate("c", start, fold)["kept"]).alias("k")).select(*key, F.col("k.n").alias("n"), F.col("k.q").alias("q"))
    ls = carry(ls.drop("__q").join(kept, [*key, "n"], "left"), key, "number", F.col("q")).filter("number is not null")
    ls = carry(ls, [*key, "number"], "option", F.nullif(F.regexp_extract("line", r"^\s*\(([A-D])\)", 1), F.lit("")))
    parts = ls.groupBy(*key, "number", "option").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    parts = parts.withColumn("t", F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), " "), r"^\s*(\d{1,3}[.)]|\([A-D]\))\s*", "")))
    out = parts.groupBy(*key, "number").agg(
        F.max(F.when(F.col("option").isNull(), F.col("t"))).alias("stem"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("option").isNotNull(), F.struct("option", "t"))))).alias("options"),
    )
    return out.filter(F.size("options") == 4)


def counters(df: DataFrame, key: list[str], group: list[str], order: str, name: str) -> DataFrame:
    """Adds how often the group has occurred up to and with each row."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key, *group).orderBy(order)))


def next_line(df: DataFrame, key: list[str]) -> DataFrame:
    """Adds the line after each, null for the last of a text."""
    return df.withColumn("next_line", F.lead("line").over(W.partitionBy(*key).orderBy("n")))


def ahead(df: DataFrame, key: list[str], most: int = 20) -> DataFrame:
    """Adds the text from each line on, as far as the ``most`` lines after it."""
    rows = F.collect_list("line").over(W.partitionBy(*key).orderBy("n").rowsBetween(0, most))
    return df.withColumn("ahead", F.array_join(rows, " "))
