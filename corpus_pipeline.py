"""A training corpus from raw documents in five stages, each on what the one before has kept.

Every stage but the last returns the columns of ``documents``. Stages are pure functions of
(spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared folder and reads it again.

Nulls: a null text is rejected by language ID (``und``), so later stages see none from there; on their own
they treat it as empty. A document with a null id is a document of its own; of near copies, one with an id stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.llm import bpe, dedup, jaccard, langid, mixing
from syllabrook.llm.common import MADE, add_row_id, crc_mod, drop, stored, table
from syllabrook.llm.queries import tokenizer_path

#: Near copies: five-word shingles with a Jaccard index of at least 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80

#: No stage but the mixing can be told in SQL: tests/llm/test_pipeline.py holds the stages before the mix against plain
#: versions, and of the whole run the words, the copies and the tokens, but not the order of the mix.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: list[str] = []


def stage(f: Stage) -> Stage:
    """Drops the tables that the stage before has stored on its way: its result is a table of its own by now."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _tables)
        before = set(MADE)
        out = f(spark, docs, sf_dir)
        _tables[:] = [p for p in MADE if p not in before]
        return out

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language found; documents without any (``und``) go."""
    found = langid.identify(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id (null comes last), whatever ids repeat."""
    rows = stored(add_row_id(docs))
    groups = jaccard.linked(rows, percent=SIMILARITY_PERCENT, words=SHINGLE_WORDS, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64(*docs.columns).alias("c"), F.col("__row").alias("d"))
    first = groups.join(rows.select("__row", order.alias("order")), "__row").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order.d").alias("__row")), "__row", "left_semi").select(*docs.columns)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has already; n_chars follows, other columns stay."""
    done = dedup.remove(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[own.get(c, F.col("columns").getField(c)).alias(c) for c in docs.columns])


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the target weights ask for, in the order of the mix; the last one is cut at the budget."""
    rows = stored(add_row_id(docs))  # both reads have to see the same keys
    mixed = mixing.mix(rows.select("doc_id", "text", "source", "__row"), keep=("__row",))
    taken = mixing.schedule(mixed).select("kept.__row", *mixing.ORDER, "size", "taken")
    out = taken.join(rows.select("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "__row")
    text = F.when(F.col("taken") < F.col("size"), mixing.first_words(F.col("doc.text"), F.col("taken"))).otherwise(F.col("doc.text"))
    out = mixing.in_order(out.withColumn("cut", text))
    own = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return out.select(*[own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


@stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): token ids, and whether they decode to the text."""
    done = bpe.encode(docs, tokenizer_path(), decoded="decoded")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = stored(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
