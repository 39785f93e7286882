"""State machines of staged files, classifications, lessons and review queues, as plans over whole tables.

Each step takes the table as it is and the events of a run, and returns the table as it is afterwards; nothing is
updated in place, so a run that is repeated or lost half-way gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from syllabrook.functions import text as tx
from syllabrook.functions.values import clamp, short_id
from syllabrook.session import written

#: Limits of what is shown and kept of a text, and of a message (fixed values).
PREVIEW, HARD, SLICE, MESSAGE, ATTEMPTS, ITEMS = 500_000, 5_000_000, 100_000, 1000, 3, 15
#: Pages below this many letters on average are read again by character recognition (fixed value).
LOW_QUALITY = 100
#: Folders that a file can go to (fixed values).
FOLDERS, UNCERTAIN = ("00_SYLLABUS", "01_SPECIMEN_PAPERS", "02_PAST_PAPERS", "03_MARK_SCHEMES", "04_NOTES", "UNCERTAIN"), "UNCERTAIN"
#: Marks between a candidate and its evidence, and where a candidate of a reason comes from (fixed values).
EVIDENCE = ("\n\nEvidence:", " | EVIDENCE: ")
PROVENANCE, RECOVERED = {"syllabus_derived_first_run": "syllabus_derived"}, "recovered_extraction"


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


# Extraction: pending, extracting, ready or failed
def extracted(staging: DataFrame, results: DataFrame, key: str = "staging_id", preview: int = PREVIEW, hard: int = HARD) -> DataFrame:
    """``staging`` after a run whose ``results`` are (key, text, ocr_pages, confidence, error), one a file at most.

    A file with a text and without an error is ready: a longer text than ``preview`` is cut and flagged. A file
    with an error, or without a text, failed; files that are not in the results stay as they were.
    """
    r = results.select(key, F.col("text").alias("__t"), F.col("ocr_pages").alias("__p"), F.col("confidence").alias("__c"), F.col("error").alias("__e"), F.lit(True).alias("__r"))
    good = F.col("__t").isNotNull() & F.col("__e").isNull()
    then = {
        "extract_status": F.when(good, "ready").otherwise("failed"),
        "extracted_text": F.when(good, F.substring("__t", 1, min(preview, hard))),
        "extract_error": F.when(~good, F.substring(F.coalesce("__e", F.lit("no text")), 1, MESSAGE)),
        "ocr_used": F.when(good, F.coalesce(F.col("__p") > 0, F.lit(False))).otherwise(F.col("ocr_used")),
        "ocr_pages_count": F.when(good, F.coalesce("__p", F.lit(0))).otherwise(F.col("ocr_pages_count")),
        "ocr_confidence_avg": F.when(good, F.col("__c")).otherwise(F.col("ocr_confidence_avg")),
        "truncated": F.when(good, F.length("__t") > preview).otherwise(F.col("truncated")),
    }
    out = staging.join(r, key, "left")
    return out.select(*[(F.when(F.col("__r"), then[c]).otherwise(F.col(c)) if c in then else F.col(c)).alias(c) for c in staging.columns])


def chunks_of(results: DataFrame, key: str = "staging_id", preview: int = PREVIEW, size: int = SLICE, hard: int = HARD) -> DataFrame:
    """(key, chunk_index, chunk_text) of the texts that are longer than the preview, whole up to the hard limit."""
    long = results.filter(F.col("error").isNull() & (F.length("text") > preview))
    return long.select(key, F.posexplode(tx.slices(F.col("text"), size, hard)).alias("chunk_index", "chunk_text"))


def reset(staging: DataFrame, selected: Column) -> DataFrame:
    """Selected files start again: pending, without text, error and signals."""
    again = {"extract_status": F.lit("pending"), "extracted_text": F.lit(None), "extract_error": F.lit(None), "ocr_used": F.lit(False), "ocr_pages_count": F.lit(0), "ocr_confidence_avg": F.lit(None), "truncated": F.lit(False)}
    chosen, types = F.coalesce(selected, F.lit(False)), dict(staging.dtypes)
    return staging.select(*[(F.when(chosen, again[c].cast(types[c])).otherwise(F.col(c)) if c in again else F.col(c)).alias(c) for c in staging.columns])


def low_quality(text: Column, least: int = LOW_QUALITY) -> Column:
    """Texts with page marks and fewer letters a page than ``least``; texts without marks are no scans."""
    pages = F.size(F.split(text, r"\[Page ")) - 1
    return F.coalesce((pages > 0) & (F.length(text) / F.greatest(pages, F.lit(1)) < least), F.lit(False))


def read_again(staging: DataFrame, only_low_quality: bool = False) -> DataFrame:
    """Ready files from before page counts and character recognition were kept."""
    old = staging.filter((F.col("extract_status") == "ready") & ~F.col("ocr_used") & F.col("total_pages").isNull())
    return old.filter(low_quality(F.col("extracted_text"))) if only_low_quality else old


# Classification: unclassified, queued, classifying, classified, skipped or failed
def eligible(staging: DataFrame, force: bool = False, staging_id: int | None = None) -> DataFrame:
    """Ready files that are not skipped; only unclassified ones unless forced, only one if it is named."""
    out = staging.filter((F.col("extract_status") == "ready") & ~F.col("skip_classification"))
    if not force:
        out = out.filter(F.col("classification_status") == "unclassified")
    return out if staging_id is None else out.filter(F.col("staging_id") == staging_id)


def healed(status: Column, skip: Column) -> Column:
    """A status before a run over all files: what an interrupted run left is unclassified again, skipped files say so."""
    return F.when(skip, F.lit("skipped")).when(status.isin("classifying", "queued"), F.lit("unclassified")).otherwise(status)


def checked_classification(folder: Column, confidence: Column, objectives: Column, valid: Column, rationale: Column, most: int = ITEMS) -> Column:
    """A model's answer made valid: unknown folder is uncertain, unknown objectives go (and are noted), confidences are clamped, the first ``most`` stay."""
    known = F.filter(objectives, lambda x: F.array_contains(valid, x["objective_id"]))
    kept = F.slice(F.transform(known, lambda x: F.struct(x["objective_id"].alias("objective_id"), clamp(x["confidence"]).alias("confidence"))), 1, most)
    dropped = F.size(objectives) - F.size(known)
    note = F.when(dropped > 0, F.concat(F.lit("[Filtered "), dropped.cast("string"), F.lit(" objective id(s) not in the syllabus.]")))
    return F.struct(
        F.when(folder.isin(*FOLDERS), folder).otherwise(F.lit(UNCERTAIN)).alias("recommended_folder"),
        clamp(confidence).alias("folder_confidence"),
        F.coalesce(kept, F.array().cast("array<struct<objective_id:string,confidence:int>>")).alias("objectives"),
        F.concat_ws(" ", F.nullif(F.trim(rationale), F.lit("")), note).alias("rationale"),
        F.greatest(dropped, F.lit(0)).alias("dropped"),
    )


def classified(attempts: DataFrame, key: str = "staging_id", most: int = ATTEMPTS) -> DataFrame:
    """(key, status, answer, rationale, attempts) of (key, attempt, answer, error): the first answer among the first ``most`` attempts, else the last error."""
    tried = attempts.filter(F.col("attempt") <= most)
    good = F.col("error").isNull() & F.col("answer").isNotNull()
    out = tried.groupBy(key).agg(
        F.min_by("answer", F.when(good, F.col("attempt"))).alias("answer"),
        F.min(F.when(good, F.col("attempt"))).alias("__at"),
        F.max_by("error", F.when(~good, F.col("attempt"))).alias("__e"),
        F.max("attempt").alias("__last"),
    )
    ok = F.col("__at").isNotNull()
    return out.select(
        key,
        F.when(ok, "classified").otherwise("failed").alias("status"),
        F.when(ok, F.col("answer")).alias("answer"),
        F.when(~ok, F.concat(F.lit("ERROR: "), F.coalesce("__e", F.lit("no answer")))).alias("rationale"),
        F.coalesce("__at", "__last").alias("attempts"),
    )


def unskipped(staging: DataFrame, chosen: Column) -> DataFrame:
    """Chosen files lose their skip flag and its reason and are unclassified again."""
    hit = F.coalesce(chosen, F.lit(False))
    return staging.withColumns({
        "classification_status": F.when(hit, "unclassified").otherwise(F.col("classification_status")),
        "skip_classification": F.when(hit, F.lit(False)).otherwise(F.col("skip_classification")),
        "skip_reason": F.when(~hit, F.col("skip_reason")),
    })


# Review: accepted, overridden or rejected
def reviewed(classifications: DataFrame, decisions: DataFrame, order: list[Column], key: str = "staging_id") -> DataFrame:
    """Classifications with their latest decision (key, decision, folder, objectives, notes); only an override keeps its folder and objectives."""
    d = latest(decisions, key, order)
    over = F.col("decision") == "overridden"
    d = d.select(key, F.col("decision").alias("review_decision"), F.when(over, F.col("folder")).alias("review_folder"), F.when(over, F.col("objectives")).alias("review_objectives"), F.col("notes").alias("review_notes"))
    return classifications.join(d, key, "left")


def binding(decision: Column, proposed: Column, override: Column) -> Column:
    """What a file is bound to: the override if there is one and it was overridden, else what was proposed; never null."""
    return F.coalesce(F.when(decision == "overridden", F.coalesce(override, proposed)).otherwise(proposed), F.array().cast("array<string>"))


def destination(decision: Column, recommended: Column, override: Column) -> Column:
    return F.when(decision == "overridden", F.coalesce(override, recommended)).otherwise(recommended)


# Ingestion: not_started, queued, ingesting, ingested or failed
def ingestion(status: Column, decision: Column, objectives: Column, error: Column) -> Column:
    """The status after a run: accepted or overridden files with objectives are ingested unless an error is told, others stay."""
    ready = decision.isin("accepted", "overridden") & ~F.coalesce(status, F.lit("not_started")).isin("ingested", "ingesting")
    then = F.when(error.isNotNull() | (F.size(objectives) <= 0), F.lit("failed")).otherwise(F.lit("ingested"))
    return F.when(F.coalesce(ready, F.lit(False)), then).otherwise(F.coalesce(status, F.lit("not_started")))


# Lessons: fresh or stale
def staled(lessons: DataFrame, hit: DataFrame, reason: str, at: Column, key: str = "objective_id") -> DataFrame:
    """Lessons whose objective is among the hits are stale, with reason and time."""
    h = hit.select(key).distinct().withColumn("__hit", F.lit(True))
    out = lessons.join(h, key, "left")
    now = F.coalesce("__hit", F.lit(False))
    new = {"is_stale": now | F.col("is_stale"), "stale_reason": F.when(now, F.lit(reason)).otherwise(F.col("stale_reason")), "staled_at": F.when(now, at).otherwise(F.col("staled_at"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in lessons.columns])


def refreshed(lessons: DataFrame, written: DataFrame, key: str = "objective_id") -> DataFrame:
    """Lessons that were written anew are fresh; those of the run that were not stay stale."""
    out = lessons.join(written.select(key).distinct().withColumn("__w", F.lit(True)), key, "left")
    fresh, types = F.coalesce("__w", F.lit(False)), dict(lessons.dtypes)
    new = {"is_stale": F.col("is_stale") & ~fresh, **{c: F.when(~fresh, F.col(c)).cast(types[c]) for c in ("stale_reason", "staled_at")}}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in lessons.columns])


def stale_causes(lessons: DataFrame, log: DataFrame, files: DataFrame) -> DataFrame:
    """Stale lessons with the files that caused it, each once, in the order of the log (staging_id, lessons_staled as JSON, started_at)."""
    hits = log.select("staging_id", "started_at", F.explode(F.from_json("lessons_staled", "array<string>")).alias("objective_id"))
    hits = hits.join(files.filter("original_name is not null").select("staging_id", "original_name").hint("merge"), "staging_id")
    # Dealt by objective before they are grouped: few hits share their group, and a task would sort all of its share of the input at once.
    first = hits.repartition("objective_id").groupBy("objective_id", "original_name").agg(F.min(F.struct("started_at", "staging_id")).alias("at"))
    causes = first.groupBy("objective_id").agg(F.array_sort(F.collect_list(F.struct("at", "original_name"))).alias("c")).select("objective_id", F.transform("c", lambda x: x["original_name"]).alias("caused_by_files"))
    out = lessons.filter("is_stale").join(causes, "objective_id", "left")
    return out.withColumn("caused_by_files", F.coalesce("caused_by_files", F.array().cast("array<string>")))


# Review queues
def split_evidence(candidate: Column) -> Column:
    """(point, evidence) of a queued candidate; the first kind of mark that it has decides."""
    point, evidence = tx.strip(candidate), F.lit("")
    for mark in reversed(EVIDENCE):
        at = F.instr(candidate, mark)
        point = F.when(at > 0, tx.strip(F.substring(candidate, F.lit(1), at - 1))).otherwise(point)
        evidence = F.when(at > 0, tx.strip(F.substring(candidate, at + len(mark), F.length(candidate)))).otherwise(evidence)
    return F.struct(F.coalesce(point, F.lit("")).alias("point"), F.coalesce(evidence, F.lit("")).alias("evidence"))


def next_ordinal(new: DataFrame, old: DataFrame, group: str, ordinal: str, order: list[Column]) -> DataFrame:
    """``new`` with an ordinal that goes on from the largest of its group in ``old``."""
    most = old.groupBy(group).agg(F.max(ordinal).alias("__m"))
    n = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return new.join(most, group, "left").withColumn(ordinal, F.coalesce("__m", F.lit(0)) + n).drop("__m")


def promoted(points: DataFrame, queue: DataFrame) -> DataFrame:
    """Points (mark_point_id, objective_id, doc_id, point_text, point_order, source_type) with the queue's valid candidates.

    The queue has (id, objective_id, doc_id, chunk_text, reason). Candidates without an objective or a text are
    dropped, those that exist already are ignored; the whole queue is done with afterwards.
    """
    c = queue.withColumn("point_text", split_evidence(F.col("chunk_text"))["point"]).filter(F.col("objective_id").isNotNull() & (F.col("point_text") != ""))
    reasons = F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv])
    c = c.withColumn("source_type", F.coalesce(F.try_element_at(reasons, F.col("reason")), F.lit(RECOVERED)))
    c = c.withColumn("mark_point_id", short_id(F.concat("objective_id", F.lit("-rec")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("point_text"), n=10, kind="sha1"))
    c = latest(c, "mark_point_id", [F.asc("id")]).join(points.select("mark_point_id"), "mark_point_id", "left_anti")
    c = next_ordinal(c, points, "objective_id", "point_order", [F.asc("id")])
    return points.unionByName(c.select(*[F.col(n).cast(t).alias(n) for n, t in points.dtypes]))


def assigned(queue: DataFrame, decisions: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the queue that a person gave an objective (key, objective_id), and the queue without those that were decided (a null objective rejects)."""
    rows = queue.drop("objective_id").join(decisions.select(key, "objective_id"), key)
    return rows.filter("objective_id is not null"), queue.join(decisions.select(key), key, "left_anti")


def batches(queue: DataFrame, order: list[Column], size: int = 20, limit: int | None = None, dry_run: bool = False, shown: int = 5) -> DataFrame:
    """The queue in numbered batches of ``size``; a dry run looks at the first few rows only, as is its feature.

    Positions come from a limited sort where there is a limit, else from ``numbered``.
    """
    most = shown if dry_run else limit
    if most is not None:
        at = F.row_number().over(W.orderBy(*order)) - 1  # at most that many rows
        return queue.orderBy(*order).limit(most).withColumn("batch", F.floor(at / size).cast("long"))
    return numbered(queue, order, "__at").withColumn("batch", F.floor(F.col("__at") / size).cast("long")).drop("__at")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place in the total order, from 0 and without gaps.

    Rows are dealt into ranges of the order and kept; a range is numbered by a window of its own, after the sizes of all ranges
    before it. So no task sees more than a range, and numbers do not depend on how rows are dealt.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__own") - 1).drop("__range", "__own", "__start")


def outcome_counts(rows: DataFrame, outcome: Column) -> DataFrame:
    """(outcome, n): what a run would do with each row; a dry run of any writer is this without the write."""
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
