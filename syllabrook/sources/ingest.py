"""A run over a subject's folders as its manifest says: files to adapters, adapters to records, records to tables, in one commit.

The first adapter whose rule a path fits takes the file. A file whose content the store has, or another file of the run has, is left
out. Records go to chunks, to the bank of questions or to the review queue; chunks of mark schemes give their points, too. Every step is a
plan over all files; only counts come to the driver. The run is safe to repeat: what it wrote it knows by content.

For folders that grow, ``streaming.walk`` hands over new files only; ``ingested`` takes them from there as well.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.functions import parsing
from syllabrook.functions.values import options_map
from syllabrook.operators.status import numbered
from syllabrook.session import written
from syllabrook.sources import files as fs
from syllabrook.sources import office, records
from syllabrook.sources.store import Change, Store

MCQ = "struct<mcq_id: string, topic: string, subtopic: string, difficulty: string, stem: string, options_json: string, correct_option: string>"
#: Content types that have a paper and a year in their name, and whose chunks hold award points (fixed values).
PAST_PAPER, MARK_SCHEME = "past_paper", "mark_scheme"
#: Reasons for review that come up here (fixed values).
NO_POINTS, NO_QUESTIONS, INCOMPLETE, UNMAPPED = "markscheme_no_points", "no_questions", "question_incomplete", "topic_not_mapped"
BANK = "subjectId string, questions array<struct<id: string, topic: string, subtopic: string, difficulty: string, stem: string, options: map<string, string>, answer: string>>"


class NotReady(RuntimeError):
    """The subject cannot be ingested into yet."""


@dataclass(frozen=True)
class Context:
    """objectives: (objective_id, content_stmt, title) of the subject; prefix: of its ids; decode: a reader of PDF files, if there is one."""

    objectives: DataFrame
    prefix: str
    topics: dict
    decode: Callable[[bytes, str], list[str]] | None = None


@dataclass(frozen=True)
class Adapter:
    """extract: records (``records.COLUMNS`` and mcq) of files (path, content, content_type)."""

    family: str
    fits: Callable[[Column], Column]
    extract: Callable[[DataFrame, Context], DataFrame]


def _ends(*endings: str) -> Callable[[Column], Column]:
    return lambda path: reduce(lambda a, b: a | b, [F.lower(path).endswith(e) for e in endings])


def _prose(found: DataFrame) -> DataFrame:
    return found.select(*records.COLUMNS, F.lit(None).cast(MCQ).alias("mcq"))


def notes(files: DataFrame, at: Context) -> DataFrame:
    """Markdown: a file is one page; bytes that are no UTF-8 become replacement signs."""
    pages = files.select("path", F.lit(1).alias("page"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))
    return _prose(records.page_records(pages, at.objectives, "markdown_notes", F.lit("notes")))


def worded(files: DataFrame, at: Context) -> DataFrame:
    return _prose(office.office_records(files.select("path", "content"), at.objectives, at.prefix))


def printed(files: DataFrame, at: Context) -> DataFrame:
    """PDF files by the caller's decoder; without one, and where it fails, they wait for review."""
    kinds = files.select("path", "content_type")
    if at.decode is None:
        read = files.select("path", F.lit(None).cast("int").alias("page"), F.lit("no decoder").alias("body"))
    else:
        read = fs.decoded_files(files.select("path", "content"), at.decode)
    read = read.join(kinds, "path")
    good = records.page_records(read.filter("page is not null"), at.objectives, "generic_pdf", F.col("content_type"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = read.filter("page is null").select(F.col("path").alias("source_file"), F.lit("generic_pdf").alias("source_family"), "content_type", none("int").alias("page"), none("int").alias("chunk_seq"), none("string").alias("chunk_text"), F.lit(records.REVIEW).alias("objective_id"), F.lit("review").alias("confidence"), F.concat(F.lit(f"{office.UNREADABLE}: "), "body").alias("review_reason"))
    return _prose(good.unionByName(bad))


def bank(files: DataFrame, at: Context) -> DataFrame:
    """Questions of JSON banks, bound by the topic map; incomplete and unmapped ones, and files without questions, wait for review."""
    spark = files.sparkSession
    j = files.select(F.col("path").alias("source_file"), F.from_json(F.col("content").cast("string"), BANK).alias("j"))
    some = F.coalesce(F.size("j.questions"), F.lit(0)) > 0
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    q = j.filter(some).select("source_file", F.coalesce("j.subjectId", stem).alias("bank"), F.posexplode("j.questions").alias("i", "q"))
    q = q.select("source_file", "i", "bank", "q.*").withColumn("options", options_map(F.col("options")))
    q = q.withColumns({"id": F.coalesce("id", F.concat(F.lower("bank"), F.lit("-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0"))), "stem": F.trim(F.coalesce("stem", F.lit(""))), "answer": F.upper(F.trim("answer"))})
    q = fs.bind_topics(q, fs.topic_map(spark, at.topics), UNMAPPED)
    q = q.join(F.broadcast(at.objectives.select("objective_id", F.lit(True).alias("known"))), "objective_id", "left") if at.topics else q.withColumn("known", F.lit(None).cast("boolean"))
    whole = (F.col("stem") != "") & F.coalesce(F.map_contains_key("options", F.col("answer")), F.lit(False))
    reason = F.when(~whole, INCOMPLETE).when(F.col("objective_id") == UNMAPPED, UNMAPPED).when(F.col("known").isNull(), records.UNKNOWN)
    payload = F.struct(F.concat(F.lit(f"{at.prefix}-"), "id").alias("mcq_id"), "topic", "subtopic", "difficulty", "stem", F.to_json("options").alias("options_json"), F.col("answer").alias("correct_option")).cast(MCQ)
    told = q.select("source_file", F.col("i").alias("chunk_seq"), F.when(reason.isNull(), F.col("objective_id")).otherwise(records.REVIEW).alias("objective_id"), reason.alias("review_reason"), payload.alias("mcq"))
    none = j.filter(~some).select("source_file", F.lit(None).cast("int").alias("chunk_seq"), F.lit(records.REVIEW).alias("objective_id"), F.lit(NO_QUESTIONS).alias("review_reason"), F.lit(None).cast(MCQ).alias("mcq"))
    out = told.unionByName(none).withColumns({"source_family": F.lit("mcq_bank"), "content_type": F.lit("mcq"), "page": F.lit(None).cast("int"), "chunk_text": F.lit(None).cast("string"), "confidence": F.when(F.col("review_reason").isNull(), "high").otherwise("review")})
    return out.select(*records.COLUMNS, "mcq")


#: The adapters in their order.
ADAPTERS = (
    Adapter("mcq_bank", lambda p: _ends(".json")(p) & F.lower(p).contains("mcq"), bank),
    Adapter("markdown_notes", lambda p: _ends(".md")(p) & ~F.element_at(F.split(p, "/"), -1).startswith(records.INDEX), notes),
    Adapter("generic_office", _ends(".docx", ".pptx", ".pptm"), worded),
    Adapter("generic_pdf", _ends(".pdf"), printed),
)


def walked(store: Store, config: dict) -> DataFrame:
    """(path, content) of all files below the manifest's roots, but for those with a part of their path below the root that a skip pattern fits.

    Spark's sources pass over files whose names start with ``_`` or a dot, and over empty ones.
    """
    out = []
    for root in (config["source_root"], *config["extra_source_roots"]):
        df = store.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
        below = F.split(F.substr("path", F.instr("path", root.rstrip("/")) + F.lit(len(root.rstrip("/")) + 1)), "/")
        skips = "|".join(f"^{fnmatch.translate(p)}" for p in config["skip_patterns"])
        out.append(df.filter(~F.exists(below, lambda part: part.rlike(skips))) if skips else df)
    return reduce(DataFrame.unionByName, out).dropDuplicates(["path"])


def context(store: Store, config: dict, decode: Callable[[bytes, str], list[str]] | None = None) -> Context:
    """What adapters need; raises where the subject is unknown, not locked, or has no objectives."""
    subject = config["subject_id"]
    row = store.read("subjects").filter(F.col("subject_id") == subject).first()
    if row is None or not row["syllabus_locked"]:
        raise NotReady(f"subject {subject} is {'unknown' if row is None else 'not locked'}; lock its syllabus first")
    titles = store.read("syllabus_sections").select("section_id", "title")
    own = store.read("objectives").filter(F.col("subject_id") == subject).join(titles, "section_id", "left").select("objective_id", "content_stmt", "title")
    prefix = own.agg(F.min(F.split_part("objective_id", F.lit("-"), F.lit(1)))).first()[0]
    if prefix is None:
        raise NotReady(f"subject {subject} has no objectives; load its syllabus first")
    return Context(own, prefix, config.get("topics", {}), decode)


def run(store: Store, config: dict, decode: Callable[[bytes, str], list[str]] | None = None, only: str | None = None, dry_run: bool = False) -> dict[str, int]:
    """Counts of a run over the manifest ``config`` (see ``records.manifest``); ``only`` names one family; a dry run writes nothing."""
    if only is not None and only not in {a.family for a in ADAPTERS}:
        raise ValueError(f"unknown adapter {only}; known: {', '.join(a.family for a in ADAPTERS)}")
    at = context(store, config, decode)
    change = store.begin()
    counts = ingested(change, walked(store, config), config["subject_id"], at, only)
    if not dry_run:
        change.commit(f"ingest {config['subject_id']}")
    return counts


def ingested(change: Change, files: DataFrame, subject: str, at: Context, only: str | None = None) -> dict[str, int]:
    """Writes the records of files (path, content) with a change, and counts files and records."""
    chosen = [a for a in ADAPTERS if only in (None, a.family)]
    family = F.lit(None).cast("string")
    for a in reversed(chosen):
        family = F.when(a.fits(F.col("path")), F.lit(a.family)).otherwise(family)
    kind = F.when(F.col("family") == "mcq_bank", "mcq").when(F.col("family") == "generic_pdf", F.coalesce(fs.content_type(F.col("path")), F.lit("notes"))).otherwise("notes")
    seen = written(files.select("path", family.alias("family"), F.sha2("content", 256).alias("content_hash")).withColumn("content_type", kind))
    known = change.read("documents").select("content_hash").distinct()
    first = seen.filter("family is not null").groupBy("content_hash").agg(F.min("path").alias("path")).join(known, "content_hash", "left_anti")
    fresh = seen.join(first.select("path"), "path", "left_semi")
    fresh = fresh.withColumn("doc_id", F.concat("content_type", F.lit("-"), F.substring("content_hash", 1, 12)))
    parts = [a.extract(files.join(fresh.filter(F.col("family") == a.family).select("path", "content_type"), "path"), at) for a in chosen]
    found = written(reduce(DataFrame.unionByName, parts).join(fresh.select(F.col("path").alias("source_file"), "doc_id"), "source_file"))
    _documents(change, fresh.join(found.select(F.col("source_file").alias("path")).distinct(), "path", "left_semi"), subject)
    review = F.col("review_reason").isNotNull()
    chunks = _chunks(change, found.filter(~review & F.col("mcq").isNull()), subject)
    queued = [_blob(found.filter(review)), _points(change, chunks)]
    _queue(change, queued[0].unionByName(queued[1]))
    _questions(change, found.filter(~review & F.col("mcq").isNotNull()), subject)
    return _counts(seen, fresh, found)


def _documents(change: Change, fresh: DataFrame, subject: str) -> None:
    name = F.element_at(F.split("path", "/"), -1)
    paper = F.col("content_type") == PAST_PAPER
    rows = fresh.select("doc_id", F.lit(subject).alias("subject_id"), "content_type", F.when(paper, parsing.paper_label(name)).alias("paper"), F.when(paper, parsing.exam_year(name)).alias("year"), F.col("path").alias("source_file"), "content_hash")
    change.insert("documents", rows, [F.asc("source_file")])


def _next_ids(change: Change, name: str, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with an ``id`` each, counting on from the table's largest."""
    last = change.read(name).agg(F.max("id")).first()[0] or 0
    return numbered(rows, order, "__at").withColumn("id", F.col("__at") + F.lit(last + 1)).drop("__at")


def _chunks(change: Change, found: DataFrame, subject: str) -> DataFrame:
    """Chunks by page; one that several objectives share is one row for each of them."""
    number = F.when(F.col("content_type") == PAST_PAPER, parsing.question_number(F.col("chunk_text")))
    chunk_id = F.concat("doc_id", F.lit("-p"), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit("-c"), "chunk_seq")
    rows = found.select("doc_id", "objective_id", F.lit(subject).alias("subject_id"), "chunk_text", "page", number.alias("question_num"), chunk_id.alias("chunk_id"), "source_family", "content_type", "source_file", "chunk_seq")
    rows = written(_next_ids(change, "chunks", rows, [F.asc("doc_id"), F.asc("page"), F.asc("chunk_seq"), F.asc("objective_id")]))
    change.insert("chunks", rows, [F.asc("id")])
    return rows


def _points(change: Change, chunks: DataFrame) -> DataFrame:
    """Writes the award points of mark schemes; chunks without any are for review."""
    c = chunks.filter(F.col("content_type") == MARK_SCHEME).withColumn("points", parsing.bullets(F.col("chunk_text")))
    p = c.select("objective_id", "doc_id", "page", "chunk_seq", F.posexplode("points").alias("k", "point_text"))
    point_id = F.concat("objective_id", F.lit("-"), "doc_id", F.lit("-p"), "page", F.lit("c"), "chunk_seq", F.lit("-mp"), F.col("k") + 1)
    change.insert("mark_points", p.select(point_id.alias("mark_point_id"), "objective_id", "doc_id", "point_text", F.lit(1).alias("marks_value"), (F.col("k") + 1).alias("point_order")), [F.asc("mark_point_id")])
    return c.filter(F.size("points") == 0).select("source_file", "chunk_text", F.lit(NO_POINTS).alias("reason"), F.lit(None).cast("string").alias("objective_id"), F.lit(None).cast("string").alias("doc_id"))


def _blob(found: DataFrame) -> DataFrame:
    """Records for review, whole, as JSON text."""
    whole = F.to_json(F.struct("source_family", "content_type", "objective_id", "page", "chunk_text", F.col("mcq").alias("mcq_payload"), "confidence", "review_reason"))
    return found.select("source_file", whole.alias("chunk_text"), F.col("review_reason").alias("reason"), F.when(F.col("objective_id") != records.REVIEW, F.col("objective_id")).alias("objective_id"), "doc_id")


def _queue(change: Change, rows: DataFrame) -> None:
    change.insert("ingest_review_queue", _next_ids(change, "ingest_review_queue", rows, [F.asc("source_file"), F.asc("reason"), F.asc("chunk_text")]), [F.asc("id")])


def _questions(change: Change, found: DataFrame, subject: str) -> None:
    change.insert("mcq_questions", found.select("mcq.*", "objective_id", F.lit(subject).alias("subject_id"), "source_file"), [F.asc("source_file"), F.asc("stem")])


def _counts(seen: DataFrame, fresh: DataFrame, found: DataFrame) -> dict[str, int]:
    f = seen.agg(F.count("*").alias("files_seen"), F.count_if(F.col("family").isNull()).alias("no_adapter")).first()
    n, with_records = fresh.count(), found.agg(F.count_distinct("source_file")).first()[0]
    out = {"files_seen": f["files_seen"], "files_no_adapter": f["no_adapter"], "files_duplicate": f["files_seen"] - f["no_adapter"] - n, "files_processed": n, "files_no_records": n - with_records}
    by = found.groupBy("source_family", "content_type", "confidence").agg(F.count("*").alias("n"), F.count_if(F.col("review_reason").isNotNull()).alias("review")).collect()  # a few families, types and levels
    for column in ("source_family", "content_type", "confidence"):
        for r in by:
            out[f"{column}:{r[column]}"] = out.get(f"{column}:{r[column]}", 0) + r["n"]
    return out | {"review": sum(r["review"] for r in by)}
