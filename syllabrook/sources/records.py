"""From pages of files to records: windows of text bound to objectives, what could not be bound, and the files' manifest."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.functions import parsing, text
from syllabrook.functions.text import strip
from syllabrook.operators import lookup

#: Why a record waits for a person (fixed values).
UNMATCHED, UNKNOWN, REVIEW = "no_objective_match_via_keywords", "objective_id_not_in_syllabus", "REVIEW"
#: Folders that a file of worksheets lies below, and names that are no lesson (fixed values).
WORKSHEETS, INDEX = ("T&T MoE SLMS", "Notes"), "_"
COLUMNS = ("source_file", "source_family", "content_type", "page", "chunk_seq", "chunk_text", "objective_id", "confidence", "review_reason")
#: What a manifest has to say and what it may, with the types of the values (fixed values).
REQUIRED = {"subject_id": str, "source_root": str, "syllabus_csv": str, "mcq_topic_map": str}
OPTIONAL = {"enable_ocr": bool, "enable_office_adapter": bool, "enable_markdown_adapter": bool, "extra_source_roots": list, "known_gaps": list, "skip_patterns": list}


def content_kind(path: Column, folders: dict[str, str], default: str) -> Column:
    """The kind of the first folder of a path that has one."""
    parts = F.split(path, "/")
    out = F.lit(default)
    for folder, kind in reversed(folders.items()):
        out = F.when(F.array_contains(parts, folder), F.lit(kind)).otherwise(out)
    return out


def page_records(pages: DataFrame, objectives: DataFrame, family: str, kind: Column, least: int = 2) -> DataFrame:
    """Pages (path, page, body) in fixed windows, each bound to the objective that shares most words, else for review.

    Windows that hold white space only are left out and still counted in ``chunk_seq``. Objectives are (objective_id,
    content_stmt, title).
    """
    chunks = pages.select(F.col("path").alias("source_file"), kind.alias("content_type"), "page", F.posexplode(text.windows(F.col("body"))).alias("chunk_seq", "c"))
    chunks = chunks.withColumn("chunk_text", strip(F.col("c"))).filter("chunk_text <> ''").drop("c")
    return _bound(chunks, objectives, family, least)


def _bound(chunks: DataFrame, objectives: DataFrame, family: str, least: int) -> DataFrame:
    """Each distinct text is matched once, however often it occurs."""
    texts = chunks.select("chunk_text").distinct().withColumn("key", F.sha2("chunk_text", 256))
    found = lookup.best_objective(texts, "key", "chunk_text", objectives, least=least).select("key", "target")
    out = chunks.withColumn("key", F.sha2("chunk_text", 256)).join(found, "key", "left")
    some = F.col("target").isNotNull()
    return out.select(
        "source_file", F.lit(family).alias("source_family"), "content_type", "page", "chunk_seq", "chunk_text",
        F.coalesce("target", F.lit(REVIEW)).alias("objective_id"), F.when(some, "medium").otherwise("review").alias("confidence"), F.when(~some, F.lit(UNMATCHED)).alias("review_reason"),
    )


def office_records(pages: DataFrame, objectives: DataFrame, prefix: str, family: str = "generic_office", least: int = 2) -> DataFrame:
    """Pages of office files in packed paragraphs, bound to the objectives that the file's name tells, else by words.

    An objective of the name that the syllabus lacks gives a record for review without a text; files whose names tell
    only such ones give nothing else.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    files = pages.select("path").distinct().withColumn("o", parsing.office_name(name))
    known = objectives.select("objective_id").distinct().withColumn("__k", F.lit(True))
    told = files.filter("o is not null").select("path", "o.confidence", "o.section", F.explode("o.objectives").alias("n"))
    told = told.select("path", "confidence", lookup.structural_id(F.lit(prefix), F.col("section"), F.col("n")).alias("objective_id")).join(known, "objective_id", "left")
    chunks = pages.select(F.col("path").alias("source_file"), F.lit("notes").alias("content_type"), "page", F.posexplode(text.pack_paragraphs(text.normalise(F.col("body")))).alias("chunk_seq", "chunk_text"))
    named = chunks.join(told.filter("__k").select(F.col("path").alias("source_file"), "objective_id", "confidence"), "source_file").withColumns({"source_family": F.lit(family), "review_reason": F.lit(None).cast("string")})
    wrong = told.filter("__k is null").select(F.col("path").alias("source_file"), F.lit(family).alias("source_family"), F.lit("notes").alias("content_type"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("chunk_seq"), F.lit(None).cast("string").alias("chunk_text"), "objective_id", F.lit("review").alias("confidence"), F.lit(UNKNOWN).alias("review_reason"))
    nameless = chunks.join(files.filter("o is null").select(F.col("path").alias("source_file")), "source_file", "left_semi")
    return named.select(*COLUMNS).unionByName(wrong.select(*COLUMNS)).unionByName(_bound(nameless, objectives, family, least).select(*COLUMNS))



def worksheets(path: Column) -> Column:
    """Whether a file lies below both folders of worksheets."""
    parts = F.split(path, "/")
    return F.array_contains(parts, WORKSHEETS[0]) & F.array_contains(parts, WORKSHEETS[1])


def manifest(config: dict, subjects: tuple[str, ...], root: str = ".", check_paths: bool = True) -> dict:
    """A subject's manifest with its defaults and absolute paths; a ValueError says all that is wrong with it."""
    if not isinstance(config, dict):
        raise ValueError("a manifest is a mapping")
    wrong = [f"{k} is missing" for k in REQUIRED if k not in config]
    wrong += [f"{k} is no {t.__name__}" for k, t in {**REQUIRED, **OPTIONAL}.items() if k in config and not isinstance(config[k], t)]
    if isinstance(config.get("subject_id"), str) and config["subject_id"] not in subjects:
        wrong.append(f"unknown subject_id {config['subject_id']!r}; known: {', '.join(sorted(subjects))}")
    if wrong:
        raise ValueError("; ".join(wrong))
    out = {k: t() for k, t in OPTIONAL.items()} | config
    place = lambda p: str(Path(p) if Path(p).is_absolute() else Path(root) / p)
    out |= {k: place(out[k]) for k in ("source_root", "syllabus_csv", "mcq_topic_map")} | {"extra_source_roots": [place(p) for p in out["extra_source_roots"]]}
    if check_paths:
        folders, files = [out["source_root"], *out["extra_source_roots"]], [out["syllabus_csv"], out["mcq_topic_map"]]
        gone = [p for p in folders if not Path(p).is_dir()] + [p for p in files if not Path(p).is_file()]
        if gone:
            raise ValueError(f"not found: {', '.join(gone)}")
    return out


def read_config(path: str) -> dict:
    """A YAML or JSON file on the driver; YAML needs its library."""
    body = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(body)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml library; write the file as JSON instead") from e
    try:
        return yaml.safe_load(body) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is no YAML: {e}") from e
