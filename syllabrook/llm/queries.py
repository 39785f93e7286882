"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.llm import ann, bpe, codes, dedup, jaccard, langid, license_scan, line_dedup, lm, mixing, runs, topk, url_filter
from syllabrook.llm.common import crc32_of, crc_mod, table

#: The byte-level tokenizer file.
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(BYTE_BPE))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mixed).select("doc_id", "size", "source_size", "target", "taken")


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup.remove(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = license_scan.licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("finds", lambda f: f["license"]))), ",")
    return done.select("doc_id", F.size("finds").cast("long").alias("n_found"), names.alias("licenses"), F.coalesce(F.aggregate("finds", F.lit(0), lambda a, f: a + f["differences"]), F.lit(0)).cast("long").alias("n_differences"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    return langid.identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, tokenizer_path(), decoded="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    return lm.score(docs, ~F.col("held_out"), keep=("held_out",))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_errors(done.rows).select("vec_id", "code", "error", "label_error", F.lit(done.digest()).alias("codebooks_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc32_of(F.col("doc_id")).alias("h"))
    done = runs.report(runs.find_runs(docs, change=runs.planted, key="h"))
    return done.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_mix_sources, op3_ann_forest, op4_suffix_dedup, op5_license_scan, op6_exact_topk, op7_language_id, op8_ngram_jaccard, op9_bpe, op10_lm_score, op11_vector_codes, op12_line_dedup, op13_periodic_runs)}
