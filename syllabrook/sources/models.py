"""Models as functions that the caller passes in: a text to a text, a text to a vector, and what the engine does with the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.functions.text import strip_fence
from syllabrook.operators.gates import lesson_gate
from syllabrook.operators.status import ATTEMPTS


def answers(prompt: Column, ask: Callable[[str], str], attempts: int = ATTEMPTS) -> Column:
    """(answer, error, attempt) of a model for each prompt; a failed call is made again. Nulls are not asked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            yield pd.DataFrame([_ask(ask, p, attempts) for p in prompts], columns=["answer", "error", "attempt"])

    # A plan that reads two fields of the answer must not ask twice.
    return F.pandas_udf(run, "answer string, error string, attempt int").asNondeterministic()(prompt)


def _ask(ask: Callable[[str], str], prompt: str | None, attempts: int) -> tuple:
    error = None
    for n in range(1, attempts + 1 if prompt is not None else 1):
        try:
            return ask(prompt), None, n
        except Exception as e:  # the row says what went wrong
            error = f"{type(e).__name__}: {e}"
    return None, error, attempts if prompt is not None else 0


def vectors(text: Column, embed: Callable[[list[str]], list]) -> Column:
    """A vector for each text, a batch of texts a call; nulls stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = texts[texts.notna()]
            found = dict(zip(some.index, embed(some.tolist()), strict=True)) if len(some) else {}
            yield pd.Series([found.get(i) for i in texts.index], dtype=object)

    return F.pandas_udf(run, "array<float>").asNondeterministic()(text)


def routed(rows: DataFrame, engines: list[tuple[str, Column, Callable[[str], str]]], prompt: str) -> DataFrame:
    """Rows with ``engine`` and its answer: the first engine whose condition holds answers; rows of none have null."""
    name, answer = F.lit(None).cast("string"), F.lit(None)
    for engine, condition, ask in reversed(engines):
        hit = F.coalesce(condition, F.lit(False))
        name = F.when(hit, F.lit(engine)).otherwise(name)
        answer = F.when(hit, answers(F.when(hit, F.col(prompt)), ask)).otherwise(answer)
    return rows.withColumns({"engine": name, "answer": answer})


def parsed(answer: Column, schema: str) -> Column:
    """A model's answer as a value of the schema, without code fences; null if it is not one."""
    return F.from_json(strip_fence(answer), schema)


def composed(candidates: DataFrame, key: str = "objective_id") -> DataFrame:
    """(key, lesson, attempt, reason) of candidates (key, attempt, lesson, questions, command_words): the first that passes the gate, else the last one's reason and no lesson."""
    c = candidates.withColumn("reason", lesson_gate(F.col("lesson"), F.col("questions"), F.col("command_words")))
    good = F.col("reason").isNull()
    g = c.groupBy(key).agg(
        F.min_by("lesson", F.when(good, F.col("attempt"))).alias("lesson"),
        F.min(F.when(good, F.col("attempt"))).alias("__at"),
        F.max_by("reason", "attempt").alias("__reason"),
        F.max("attempt").alias("__last"),
    )
    return g.select(key, "lesson", F.coalesce("__at", "__last").alias("attempt"), F.when(F.col("__at").isNull(), F.col("__reason")).alias("reason"))
