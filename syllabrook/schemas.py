"""The relations of the study model, their keys and references, and checks that Spark does not make by itself."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Relation:
    ddl: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


#: Enumerations (fixed values).
STATUS_PLAN = ("unmet", "met_once", "mastered")
STATUS_EXTRACT = ("pending", "extracting", "ready", "failed")
STATUS_CLASSIFY = ("unclassified", "classifying", "classified", "skipped", "failed")
STATUS_INGEST = ("not_started", "queued", "ingesting", "ingested", "failed")
SENTIMENT = ("positive", "negative", "confused")

RELATIONS = {
    "subjects": Relation("subject_id STRING, display_name STRING, syllabus_locked BOOLEAN", ("subject_id",)),
    "syllabus_sections": Relation("section_id STRING, subject_id STRING, title STRING, section_num STRING", ("section_id",), references={"subject_id": "subjects"}),
    "objectives": Relation("objective_id STRING, section_id STRING, subject_id STRING, objective_num STRING, content_stmt STRING, skill_type STRING, command_words STRING, exam_weight STRING, verified BOOLEAN", ("objective_id",), references={"section_id": "syllabus_sections", "subject_id": "subjects"}),
    "documents": Relation("doc_id STRING, subject_id STRING, content_type STRING, paper STRING, year INT, source_file STRING, content_hash STRING", ("doc_id",), (("content_hash",),), {"subject_id": "subjects"}),
    "chunks": Relation("id BIGINT, doc_id STRING, objective_id STRING, subject_id STRING, chunk_text STRING, page INT, question_num STRING, chunk_id STRING, source_family STRING", ("id",), (("chunk_id",),), {"doc_id": "documents", "objective_id": "objectives"}),
    "mark_points": Relation("mark_point_id STRING, objective_id STRING, question_id STRING, doc_id STRING, point_text STRING, marks_value INT, point_order INT, point_group_id STRING, source_type STRING, source_rank INT, command_word STRING, extraction_confidence INT", ("mark_point_id",), references={"objective_id": "objectives"}),
    "study_sessions": Relation("session_id BIGINT, subject_id STRING, objective_id STRING, mode STRING, outcome STRING, score_pct INT, is_retry BOOLEAN, created_at TIMESTAMP", ("session_id",)),
    "app_state": Relation("key STRING, value STRING, updated_at TIMESTAMP", ("key",)),
    "weakness_log": Relation("weakness_id BIGINT, objective_id STRING, subject_id STRING, score_pct INT, reason STRING, leitner_box INT, next_review DATE, updated_at TIMESTAMP", ("objective_id",)),
    "revision_schedule": Relation("task_id BIGINT, subject_id STRING, objective_id STRING, due DATE, status STRING", ("task_id",)),
    "practice_questions": Relation("question_id STRING, objective_id STRING, stem STRING", ("question_id",), references={"objective_id": "objectives"}),
    "study_plan": Relation("subject_id STRING, objective_id STRING, status STRING, met_count INT, last_met_at DATE", ("subject_id", "objective_id"), enums={"status": STATUS_PLAN}),
    "study_batches": Relation("batch_id BIGINT, subject_id STRING, objective_ids STRING, synthesis_qid STRING, status STRING", ("batch_id",)),
    "ingest_review_queue": Relation("id BIGINT, source_file STRING, chunk_text STRING, reason STRING, objective_id STRING, doc_id STRING", ("id",)),
    "vectors": Relation("id BIGINT, embedding ARRAY<FLOAT>", ("id",), references={"id": "chunks"}),
    "objective_videos": Relation("objective_id STRING, url STRING, title STRING, channel STRING, duration_str STRING", ("objective_id", "url")),
    "mcq_questions": Relation("mcq_id STRING, objective_id STRING, subject_id STRING, topic STRING, subtopic STRING, difficulty STRING, stem STRING, options_json STRING, correct_option STRING", ("mcq_id",)),
    "schema_migrations": Relation("version STRING, description STRING, applied_at TIMESTAMP", ("version",)),
    "lesson_generation_queue": Relation("objective_id STRING, reason STRING, created_at TIMESTAMP", ("objective_id", "reason")),
    "objective_lessons": Relation("lesson_id STRING, objective_id STRING, lesson_text STRING, recall_questions STRING, source_chunk_ids STRING, confidence INT, is_stale BOOLEAN, staled_at TIMESTAMP", ("lesson_id",), (("objective_id",),)),
    "user_feedback": Relation("feedback_id BIGINT, objective_id STRING, subject_id STRING, feedback_type STRING, sentiment STRING, created_at TIMESTAMP", ("feedback_id",), enums={"sentiment": SENTIMENT}),
    "upload_staging": Relation("staging_id BIGINT, subject_id STRING, original_name STRING, file_type STRING, extract_status STRING, classification_status STRING, ingestion_status STRING, extracted_text STRING, ocr_used BOOLEAN, ocr_confidence INT, ocr_dpi_reduced BOOLEAN, truncated BOOLEAN, skip_classification BOOLEAN, skip_reason STRING", ("staging_id",), enums={"extract_status": STATUS_EXTRACT, "classification_status": STATUS_CLASSIFY, "ingestion_status": STATUS_INGEST}),
    "upload_staging_chunks": Relation("staging_id BIGINT, chunk_index INT, chunk_text STRING", ("staging_id", "chunk_index"), references={"staging_id": "upload_staging"}),
    "upload_classifications": Relation("staging_id BIGINT, recommended_folder STRING, folder_confidence INT, objectives_json STRING, review_decision STRING, review_objectives STRING", ("staging_id",)),
    "ingestion_log": Relation("log_id BIGINT, staging_id BIGINT, started_at TIMESTAMP, success BOOLEAN, chunks_created INT, objectives_hit STRING, lessons_staled STRING", ("log_id",)),
    "visual_pages": Relation("objective_id STRING, file_path STRING, generation_ms BIGINT", ("objective_id",)),
    "mark_scheme_locks": Relation("subject_id STRING, source_pdf STRING, page_range STRING, row_count INT", ("subject_id",)),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], RELATIONS[name].schema)


def verify(frames: dict[str, DataFrame]) -> list[str]:
    """Names of relations that are missing or whose columns and types differ."""
    want = {n: [(f.name, f.dataType) for f in r.schema] for n, r in RELATIONS.items()}
    return [n for n, cols in want.items() if n not in frames or [(f.name, f.dataType) for f in frames[n].schema] != cols]


def evolve(df: DataFrame, name: str) -> DataFrame:
    """Additive migration: columns that the relation has and the frame lacks come as nulls; applying it again changes nothing."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in RELATIONS[name].schema if f.name not in have}) if set(RELATIONS[name].schema.names) - have else df




def sql_statements(body: str) -> list[str]:
    """The statements of a migration file: what stands after ``--`` on a line is a comment, semicolons separate."""
    plain = "\n".join(line.split("--", 1)[0] for line in body.splitlines())
    return [s for s in (part.strip() for part in plain.split(";")) if s]



def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is set and does not exist (a null reference is allowed)."""
    keys = parent.select(F.col(parent_key).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def violations(frames: dict[str, DataFrame]) -> DataFrame:
    """(relation, rule, n) for every rule that is broken, over the frames given."""
    out = []
    for name, df in frames.items():
        r = RELATIONS[name]
        for key in (r.key, *r.unique):
            out.append((name, f"unique {', '.join(key)}", duplicates(df.dropna(subset=list(key)), key)))
        for c, parent in r.references.items():
            if parent in frames:
                out.append((name, f"{c} references {parent}", orphans(df, c, frames[parent], RELATIONS[parent].key[0])))
        for c, allowed in r.enums.items():
            out.append((name, f"{c} is one of its values", outside(df, c, allowed)))
    counts = [d.agg(F.lit(n).alias("relation"), F.lit(rule).alias("rule"), F.count("*").alias("n")) for n, rule, d in out]
    return reduce(DataFrame.unionByName, counts).filter("n > 0")
