"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in shuffled order, gets a virtual finish time: the words of its source up to
and with it, divided by the source's target. A source whose target exceeds its size is gone through
again, up to ``max_epochs`` times, with its words counted on. All copies are then ranged over virtual time
and taken in that order until the total budget is used up; the copy that crosses it is cut.

Running sums never gather a source in one task: a source is cut into ``BUCKETS`` ranges of the shuffle
key, whose sums give each range its start. The end of the budget is found from a histogram over virtual
time (in which words lie evenly by construction) and an exact sort of the one range that holds it.

Cases: a null text has size 0; a null source is a source of its own, the last. Documents of size 0 get
taken 0. Repeated rows are documents of their own. With no words at all every target is 0. The order is
that of a keyed digest of doc_id, so reruns agree. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
#: Ranges of the shuffle key for each source (three hexadecimal digits of it), and ranges of virtual time.
KEY_DIGITS, TIME_RANGES = 3, 16384


@dataclass
class Mix:
    """documents: doc_id, source, kept, size, source_size, target, upto (words of the source up to and with it)."""

    documents: DataFrame
    epochs: int
    cutoff: tuple | None  # finish, source_rank, position and words taken of the copy that crosses the budget

    def taken(self, epoch: int) -> Column:
        """Words that the mix takes of a document's copy of this epoch."""
        end, finish = position(epoch), finish_time(epoch)
        if self.cutoff is None:
            return F.when(F.col("target") > 0, F.when(finish <= 1, F.col("size")).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")
        at, rank, place, words = self.cutoff
        here, there = F.struct(finish.alias("a"), F.col("source_rank").alias("b"), end.alias("c")), F.struct(F.lit(at).alias("a"), F.lit(rank).alias("b"), F.lit(place).cast("long").alias("c"))
        return F.when(F.col("target") <= 0, F.lit(0)).when(here < there, F.col("size")).when(here == there, F.least(F.lit(words), F.col("size"))).otherwise(F.lit(0)).cast("long")


def position(epoch: int) -> Column:
    return F.lit(epoch).cast("long") * F.col("source_size") + F.col("upto")


def finish_time(epoch: int) -> Column:
    return F.when(F.col("target") > 0, position(epoch).cast("double") / F.col("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, source_rank, target) of (source, source_size): one row for each source.

    Shares of the total by weight; no target exceeds max_epochs times its source. Sources by their limit
    over weight: those that stop at it come first, so the level of the rest follows from running sums.
    """
    by_name, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy(F.lit(0))
    s = sizes.withColumn("source_rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("source_rank") - 1) % len(weights) + 1))
    s = s.withColumn("most", F.lit(max_epochs).cast("long") * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), "source_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "rest": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0)),
        "shares": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    s = s.withColumn("level", F.col("rest").cast("double") / F.col("shares").cast("double"))
    s = s.withColumn("stops", F.col("most").cast("double") < F.col("level") * F.col("weight"))
    level = F.min_by("level", F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"), F.col("source_rank")))).over(all_rows)
    s = s.withColumn("target", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(level * F.col("weight")))
    return s.select("source", "source_size", "source_rank", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = "", doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> Mix:
    """The mix of ``docs``; its documents keep doc_id, source and, in the struct ``kept``, the columns named in ``keep``."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).alias("none")]).alias("kept"), word_count(F.col(text)).alias("size"))
    sized = stored(sized)  # the texts are read once
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    keyed = keyed.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit("")), "bucket": F.substring("key", 1, KEY_DIGITS)})
    group = ["no_source", "name", "bucket"]
    sums = keyed.groupBy(*group).agg(F.sum("size").alias("words"))
    by_source = W.partitionBy("no_source", "name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
    per_source = sums.groupBy("no_source", "name").agg(F.sum("words").alias("source_size"))
    per_source = per_source.withColumn("source", F.when(~F.col("no_source"), F.col("name")))
    goals = targets(per_source.select("source", "source_size"), weights, max_epochs)
    goals = goals.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}).drop("source")
    starts = starts.join(goals, ["no_source", "name"]).drop("words")
    within = W.partitionBy(*group).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(within)).join(starts, group)
    placed = stored(placed.withColumn("upto", F.col("upto") + F.col("start")).select("doc_id", "source", "kept", "size", "source_size", "source_rank", "target", "upto"))
    return _cut(placed, max_epochs)


def _cut(placed: DataFrame, epochs: int) -> Mix:
    """Finds the copy at which the budget, the words of all sources, is used up."""
    copies = placed.filter("size > 0 and target > 0").select("size", "source_rank", F.explode(F.array(*[F.struct(position(e).alias("place"), finish_time(e).alias("finish")) for e in range(epochs)])).alias("c"))
    copies = copies.select("size", "source_rank", "c.place", "c.finish").withColumn("range", F.floor(F.col("finish") * TIME_RANGES).cast("long"))
    budget = placed.groupBy("source_rank").agg(F.first("source_size").alias("n")).agg(F.sum("n")).first()[0] or 0
    if not budget:
        return Mix(placed, epochs, None)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)))
    end = ranges.filter(F.col("upto") >= budget).orderBy("range").limit(1).first()
    if end is None:
        return Mix(placed, epochs, None)
    left = budget - (end["upto"] - end["words"])
    inside = copies.filter(F.col("range") == end["range"]).withColumn("upto", F.sum("size").over(W.orderBy("finish", "source_rank", "place").rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = inside.filter(F.col("upto") >= left).orderBy("finish", "source_rank", "place").limit(1).first()
    return Mix(placed, epochs, (last["finish"], last["source_rank"], last["place"], left - (last["upto"] - last["size"])))


def taken_words(mixed: Mix) -> DataFrame:
    """The documents with the words that the mix takes of each, repeats counted."""
    total = F.lit(0).cast("long")
    for e in range(mixed.epochs):
        total = total + mixed.taken(e)
    return mixed.documents.withColumn("taken", total)


ORDER = ("finish", "source_rank", "place")


def schedule(mixed: Mix) -> DataFrame:
    """The copies that the mix takes: epoch, finish, place and words taken beside the document's columns."""
    rows = mixed.documents.select("*", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), finish_time(e).alias("finish"), position(e).alias("place"), mixed.taken(e).alias("taken")) for e in range(mixed.epochs)])).alias("c"))
    return rows.filter("c.taken > 0").select(*mixed.documents.columns, "c.*")


def in_order(copies: DataFrame) -> DataFrame:
    """The copies ranged over the cluster in the order of virtual time."""
    return copies.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), n.cast("int")), "")
