"""A subject's folders ingested as its manifest says, again, and as a dry run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from syllabrook.sources import ingest, migrations, records
from syllabrook.sources.store import Store
from syllabrook.streaming import walk


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    migrations.bootstrap(s, 2)
    c = s.begin()
    put = lambda name, rows, schema: c.insert(name, spark.createDataFrame(rows, schema), [F.lit(1)])
    put("subjects", [("economics", "Economics", True), ("biology", "Biology", False), ("empty", "Empty", True)], "subject_id string, display_name string, syllabus_locked boolean")
    put("syllabus_sections", [("S1", "economics", "Nature of markets")], "section_id string, subject_id string, title string")
    put("objectives", [("ECON-1.1", "S1", "economics", "Explain how scarcity leads to choice"), ("ECON-1.2", "S1", "economics", "Describe markets and prices")], "objective_id string, section_id string, subject_id string, content_stmt string")
    c.commit()
    return s


BANK = {"subjectId": "Econ", "questions": [
    {"id": "q1", "topic": "Markets", "stem": "Which?", "options": {"a": "x", "B": "y"}, "answer": "b"},
    {"topic": "Markets", "subtopic": "Prices", "stem": "What?", "options": {"A": "x"}, "answer": "A"},
    {"id": "q3", "topic": "Unknown", "stem": "Why?", "options": {"A": "x"}, "answer": "A"},
    {"id": "q4", "topic": "Markets", "stem": "No answer", "options": {"A": "x"}, "answer": "D"},
]}


@pytest.fixture
def config(tmp_path):
    root, more = tmp_path / "kb", tmp_path / "more"
    files = {
        "notes/choice.md": "Scarcity leads people to a choice between markets.",
        "notes/copy.md": "Scarcity leads people to a choice between markets.",
        "notes/_index.md": "scarcity choice",
        "notes/other.md": "Nothing of it.",
        "banks/mcq_econ.json": json.dumps(BANK),
        "banks/mcq_bad.json": "not json",
        "drafts/x.md": "scarcity choice drafts",
        "past_papers/June 2019 p2.pdf": "3. Describe markets and prices.",
        "mark_schemes/scheme.pdf": "• markets have prices\n• prices clear markets",
        "mark_schemes/prose.pdf": "markets and prices only",
        "mark_schemes/broken.pdf": "%",
        "readme.bin": "?",
    }
    for name, body in files.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_text(body)
    os.makedirs(more)
    (more / "again.md").write_text("Markets and prices, described.")
    (tmp_path / "s.csv").write_text("")
    (tmp_path / "t.yaml").write_text("")
    raw = {"subject_id": "economics", "source_root": str(root), "extra_source_roots": [str(more)], "skip_patterns": ["draft*"], "syllabus_csv": str(tmp_path / "s.csv"), "mcq_topic_map": str(tmp_path / "t.yaml")}
    topics = {"Markets": {"default_objective": "ECON-1.2", "subtopic_overrides": {"Prices": "ECON-9.9"}}}
    return records.manifest(raw, ("economics", "biology", "empty")) | {"topics": topics}


def decoder():
    """A function of its own, since workers do not know this module."""

    def read(content, path):
        if content == b"%":
            raise ValueError("no pages")
        return [content.decode()]

    return read


decode = decoder()


def told(store, name, *columns):
    return sorted(map(tuple, store.read(name).select(*columns).collect()), key=str)


def test_run(spark, store, config):
    before = store.versions()
    dry = ingest.run(store, config, decode, dry_run=True)
    assert store.versions() == before and store.read("chunks").count() == 0
    counts = ingest.run(store, config, decode)
    assert counts == dry and len(store.versions()) == len(before) + 1
    assert {k: counts[k] for k in ("files_seen", "files_no_adapter", "files_duplicate", "files_processed", "files_no_records", "review")} == {"files_seen": 11, "files_no_adapter": 1, "files_duplicate": 1, "files_processed": 9, "files_no_records": 0, "review": 6}
    assert told(store, "chunks", "objective_id", "chunk_text", "question_num", "source_family") == [
        ("ECON-1.1", "Scarcity leads people to a choice between markets.", None, "markdown_notes"),
        ("ECON-1.2", "3. Describe markets and prices.", "3", "generic_pdf"),
        ("ECON-1.2", "Markets and prices, described.", None, "markdown_notes"),
        ("ECON-1.2", "markets and prices only", None, "generic_pdf"),
        ("ECON-1.2", "• markets have prices\n• prices clear markets", None, "generic_pdf"),
    ]
    assert [r[0] for r in told(store, "chunks", "id")] == [1, 2, 3, 4, 5]
    assert told(store, "documents", "content_type", "paper", "year") == [("mark_scheme", None, None)] * 3 + [("mcq", None, None)] * 2 + [("notes", None, None)] * 3 + [("past_paper", "Paper 2 - June 2019", 2019)]
    assert told(store, "mcq_questions", "mcq_id", "objective_id", "correct_option", "options_json") == [("ECON-q1", "ECON-1.2", "B", '{"A":"x","B":"y"}')]
    assert told(store, "mark_points", "objective_id", "point_text", "point_order") == [("ECON-1.2", "markets have prices", 1), ("ECON-1.2", "prices clear markets", 2)]
    reasons = [r[0] for r in told(store, "ingest_review_queue", "reason")]
    assert reasons == sorted(["no_objective_match_via_keywords", "objective_id_not_in_syllabus", "topic_not_mapped", "question_incomplete", "no_questions", "unreadable: ValueError: no pages", "markscheme_no_points"])
    unmapped = store.read("ingest_review_queue").filter("reason = 'topic_not_mapped'").first()
    assert json.loads(unmapped["chunk_text"])["mcq_payload"]["mcq_id"] == "ECON-q3" and unmapped["objective_id"] is None


def test_a_second_run_adds_what_is_new(spark, store, config, tmp_path):
    ingest.run(store, config, decode)
    again = ingest.run(store, config, decode)
    assert again["files_processed"] == 0 and again["files_duplicate"] == 10 and store.read("chunks").count() == 5
    (tmp_path / "more" / "new.md").write_text("How scarcity leads to choice.")
    assert ingest.run(store, config, decode)["files_processed"] == 1
    assert max(r["id"] for r in store.read("chunks").collect()) == 6


def test_one_adapter_and_no_decoder(spark, store, config):
    counts = ingest.run(store, config, only="generic_pdf")
    assert counts["files_processed"] == 4 and counts["review"] == 4 and counts["files_no_adapter"] == 7
    assert {r["reason"] for r in store.read("ingest_review_queue").collect()} == {"unreadable: no decoder"}
    with pytest.raises(ValueError, match="unknown adapter pptx; known: mcq_bank"):
        ingest.run(store, config, only="pptx")


@pytest.mark.parametrize(("subject", "why"), [("biology", "not locked"), ("history", "unknown"), ("empty", "no objectives")])
def test_subjects_that_are_not_ready(spark, store, config, subject, why):
    with pytest.raises(ingest.NotReady, match=why):
        ingest.run(store, config | {"subject_id": subject})


def test_files_of_a_walk(spark, store, config, tmp_path):
    """The walk hands over what is new, and its registry, chunks and documents come with one commit."""
    at = ingest.context(store, config, decode)
    walk.make_registry(store)
    seen = []

    def batch(change, files, number):
        walk.registered(change, files, number)
        seen.append(ingest.ingested(change, files.select("path", "content"), "economics", at)["files_processed"])

    go = lambda: walk.stream(store, [config["source_root"]], f"{tmp_path}/checkpoint", "*.md", batch)
    go()
    (tmp_path / "kb" / "notes" / "late.md").write_text("Describe prices of markets.")
    go()
    assert seen == [3, 1] and store.read("kb_paths").count() == 5 and "ECON-1.2" in {r["objective_id"] for r in store.read("chunks").collect()}
