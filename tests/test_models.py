"""What the engine does with models that the caller passes in, and small sinks and sources."""

import json

import pytest
from pyspark.sql import functions as F

from syllabrook.sources import files, models, records, sinks


def test_answers_are_asked_again_and_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def ask(prompt):
        calls.add(1)
        if prompt == "never":
            raise TimeoutError("no answer")
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "never"), (3, None)], "i int, p string").coalesce(1)
    out = df.withColumn("m", models.answers(F.col("p"), ask, attempts=2))
    got = {r["i"]: tuple(r)[1:] for r in out.select("i", "m.answer", "m.error", "m.attempt").collect()}
    assert got == {1: ("A", None, 1), 2: (None, "TimeoutError: no answer", 2), 3: (None, None, 0)}
    assert calls.value == 3  # one field or three: each prompt is asked once


def test_vectors(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "i int, t string").coalesce(1)
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert {r["i"]: r["v"] for r in df.withColumn("v", models.vectors(F.col("t"), embed)).collect()} == {1: [2.0, 1.0], 2: None, 3: [1.0, 1.0]}


def test_routed_to_the_first_engine_that_fits(spark):
    df = spark.createDataFrame([(1, "short", 10), (2, "long", 90), (3, "none", None)], "i int, p string, n int")
    out = models.routed(df, [("local", F.col("n") < 50, lambda p: f"local {p}"), ("cloud", F.col("n") >= 50, lambda p: f"cloud {p}")], "p")
    assert {r["i"]: (r["engine"], r["answer"] and r["answer"]["answer"]) for r in out.collect()} == {1: ("local", "local short"), 2: ("cloud", "cloud long"), 3: (None, None)}


def test_parsed_answers(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("no",)], "t string")
    assert [r["x"] and r["x"]["a"] for r in df.select(models.parsed(F.col("t"), "a int").alias("x")).collect()] == [1, None]


def test_the_first_lesson_that_passes(spark):
    good = "word " * 400
    rows = [("o1", 1, "too short", ["What is the point of it?"], ["Define"]), ("o1", 2, good, ["What is the point of it?"], ["Define"]), ("o1", 3, good + "x", ["What is the point of it?"], ["Define"]), ("o2", 1, "bad", ["What?"], ["Define"]), ("o2", 2, "bad", [], ["Define"])]
    df = spark.createDataFrame(rows, "objective_id string, attempt int, lesson string, questions array<string>, command_words array<string>")
    got = {r["objective_id"]: r for r in models.composed(df).collect()}
    assert got["o1"]["lesson"] == good and got["o1"]["attempt"] == 2 and got["o1"]["reason"] is None
    assert got["o2"]["lesson"] is None and got["o2"]["attempt"] == 2 and got["o2"]["reason"]


def test_rows_of_reviews_and_progress(spark):
    scores = spark.createDataFrame([(None,), (39,), (40,), (70,)], "last_score int")
    assert [r["status"] for r in sinks.progress_rows(scores).collect()] == ["not_started", "weak", "developing", "strong"]
    rows = spark.createDataFrame([(True, True, None, False), (False, True, None, False), (False, False, None, True), (False, False, "o", False), (False, False, "o", True)], "artifact boolean, manual boolean, objective_id string, verified boolean")
    assert [r["state"] for r in sinks.scheme_review_rows(rows).collect()] == ["artifact", "manual", "unmapped", "unverified", "ok"]


def test_the_last_vector_of_an_id_stays(spark):
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, embedding array<float>")
    new = spark.createDataFrame([(2, [3.0], 1), (2, [4.0], 2), (3, [5.0], 1)], "id long, embedding array<float>, n int")
    assert sorted((r["id"], r["embedding"][0]) for r in sinks.upsert_vectors(old, new, F.desc("n")).collect()) == [(1, 1.0), (2, 4.0), (3, 5.0)]


def test_master_map_takes_whole_rows_of_the_supplement(spark):
    main = spark.createDataFrame([("a", "b", "c", None)], "p string, q string, r string, s string")
    more = spark.createDataFrame([("x", "y", "z", "w"), ("x", None, "z", "w")], "p string, q string, r string, s string")
    assert sorted(map(tuple, files.master_map(main, more, ("p", "q", "r", "s")).collect())) == [("a", "b", "c", None), ("x", "y", "z", "w")]


def test_kinds_and_configs(spark, tmp_path):
    df = spark.createDataFrame([("/kb/mark_schemes/a.pdf",), ("/kb/x/b.pdf",)], "p string")
    assert [r["k"] for r in df.select(records.content_kind(F.col("p"), {"mark_schemes": "mark_scheme"}, "notes").alias("k")).collect()] == ["mark_scheme", "notes"]
    (tmp_path / "m.json").write_text(json.dumps({"subject_id": "x"}))
    assert records.read_config(str(tmp_path / "m.json")) == {"subject_id": "x"}
    with pytest.raises(ValueError, match="source_root is missing; syllabus_csv is missing; mcq_topic_map is missing; unknown subject_id 'x'; known: y"):
        records.manifest({"subject_id": "x"}, ("y",))
