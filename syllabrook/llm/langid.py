"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter string is the product (binding) of its
letters' vectors, each permuted by its place; a document is the sum (bundle) of its three-letter strings,
and a language the sum of its documents. A document gets the language whose prototype has the largest
cosine with it.

Letters are lower-cased; runs of anything else count as one word boundary. Sums are of whole numbers, so
the model does not depend on how rows are dealt. What the fit keeps is one vector for each language.

Cases: a null text, or one without a letter, is ``und`` with score 0. Rows without language teach
nothing; with no labelled row at all every document is ``und``. Equal cosines: the smaller name. The score
is the cosine, at least 0. Whole texts are used. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.llm.common import give_back, small_batches

DIMS, SYMBOLS, SEED = 256, 128, 20240229
UNKNOWN = "und"
#: Languages whose counts a task keeps at a time.
AT_A_TIME = 16


@cache
def letter_codes() -> np.ndarray:
    """A code for each code point: 0 for what is no letter, 1 to 26 for a to z, others dealt to the rest."""
    codes = np.zeros(0x110000, dtype=np.int32)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            codes[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % (SYMBOLS - 27)
    return codes


@cache
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, permuted (rolled) by two places, by one, and as they are."""
    v = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMS))
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct three-letter strings of a text, as numbers, and how often each occurs."""
    none = np.zeros(0, dtype=np.int32)
    if not text:
        return none, none
    codes = letter_codes()[np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)]
    if not codes.any():
        return none, none
    codes = np.concatenate(([0], codes, [0])).astype(np.int32)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    grams = codes[:-2] * (SYMBOLS * SYMBOLS) + codes[1:-1] * SYMBOLS + codes[2:]
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.append(first, len(grams)))


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the bound n-gram vectors, exact in double precision."""
    a, b, c = letter_vectors()
    out = np.zeros(DIMS)
    for i in range(0, len(grams), 8192):
        g = grams[i : i + 8192]
        bound = a[g // (SYMBOLS * SYMBOLS)] * b[g // SYMBOLS % SYMBOLS] * c[g % SYMBOLS]
        n = counts[i : i + 8192]
        out += n.astype(np.float32) @ bound.astype(np.float32) if n.sum() < 1 << 23 else n.astype(np.float64) @ bound.astype(np.float64)
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each language of the rows of ``docs`` that have one."""

    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> pd.DataFrame:
            rows = []
            for name, counts in held.items():
                grams = np.flatnonzero(counts).astype(np.int32)
                rows.append((name, bundle(grams, counts[grams]).astype(np.int64)))
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "v"])

        for df in batches:
            for t, name in zip(df[text], df[lang], strict=True):
                if name not in held and len(held) >= AT_A_TIME:
                    yield out()
                grams, n = ngrams(t)
                held.setdefault(name, np.zeros(SYMBOLS**3, dtype=np.int64))[grams] += n
        if held:
            yield out()
        give_back()

    parts = docs.filter(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInPandas(count, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    model: dict[str, np.ndarray] = {}
    for r in sums.collect():  # one number for each language and dimension
        model.setdefault(r["lang"], np.zeros(DIMS))[r["d"]] = r["x"]
    return dict(sorted(model.items()))


def predict(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Only the text is looked at."""
    names = [n for n, v in model.items() if np.linalg.norm(v)]
    prototypes = np.array([model[n] / np.linalg.norm(model[n]) for n in names]).reshape(-1, DIMS)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                grams, n = ngrams(t)
                v = bundle(grams, n)
                size = np.linalg.norm(v)
                if not names or not len(grams):
                    rows.append((UNKNOWN, 0.0))
                    continue
                cos = prototypes @ v / size if size else np.zeros(len(names))
                k = int(np.argmax(cos))
                rows.append((names[k], float(min(1.0, max(0.0, cos[k])))))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        give_back()

    out = docs.drop("lang_pred", "score").withColumn("__p", F.pandas_udf(run, "lang_pred string, score double")(F.col(text)))
    return out.select(*[f"`{c}`" for c in out.columns if c != "__p"], "__p.lang_pred", "__p.score")


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """Fits on the rows of ``docs`` for which ``learn`` holds and predicts all of them."""
    return predict(docs, fit(docs.filter(learn), text, lang), text)
