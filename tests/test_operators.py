"""Operators on small frames: folds, gates, rewrites, line parsers, checks, streams and files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from syllabrook import schemas
from syllabrook.operators import curate, lines, match, schedule, score
from syllabrook.sources import files, sinks
from syllabrook.streaming import study

EVENTS = "user_id long, event_id long, ts timestamp, value double"


def events(seed, n=400):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    return [(rnd.randint(1, 7), i, t0 + dt.timedelta(hours=rnd.randint(0, 900)), rnd.choice([20.0, 69.9, 70.0, 95.0])) for i in range(n)]


def fold(rows):
    out = {}
    for k, i, ts, v in sorted(rows, key=lambda r: (r[2], r[1])):
        box, n, met, day = out.get(k, (None, 0, 0, None, None))[:4]
        box = study.next_box(box, v)
        met, day = (0, None) if v < 70 else (met, day) if day == ts.date() else (min(met + 1, 2), ts.date())
        due = ts.date() if n == 0 else ts.date() + dt.timedelta(days=(1, 2, 4, 7, 15)[box - 1])
        out[k] = (box, n + 1, met, day, due)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_a_fold(spark, seed):
    rows = events(seed)
    df, want = spark.createDataFrame(rows, EVENTS), fold(rows)
    got = {r["user_id"]: r for r in schedule.leitner(df, "user_id", "ts", "event_id", F.col("value") >= 70).collect()}
    met = {r["user_id"]: r["met_count"] for r in schedule.mastery(df, "user_id", "ts", "event_id", F.col("value") >= 70).collect()}
    assert {k: (r["box"], r["next_review"]) for k, r in got.items()} == {k: (v[0], v[4]) for k, v in want.items()}
    assert met == {k: v[2] for k, v in want.items()}


def test_stream_equals_the_batch(spark, tmp_path):
    rows = sorted(events(5, 300), key=lambda r: (r[2], r[1]))
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    study.replay(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), EVENTS)
    got = {r["key"]: (r["box"], r["next_review"]) for r in study.current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {k: (v[0], v[4]) for k, v in fold(rows).items()}


def test_weighted_score(spark):
    p = spark.createDataFrame([("q", "a", 1, True), ("q", "b", 2, False), ("q", "c", 1, True), ("z", "d", None, False), ("z", "e", 0, True)], "q string, mark_point_id string, marks_value int, awarded boolean")
    got = {r["q"]: (r["score_pct"], r["missed"]) for r in score.weighted(p, "q").collect()}
    assert got == {"q": (50, ["b"]), "z": (50, ["d"])}


def test_gates(spark):
    p = spark.createDataFrame([("thin", True, "short", "short"), ("echo", True, "prices rise when supply falls", "I say prices rise when supply falls"), ("why", True, "prices rise because supply falls", "prices rise because supply falls"), ("made", True, "something else entirely here", "x")], "k string, awarded boolean, evidence string, answer string")
    got = {r["k"]: (r["awarded"], r["flagged"]) for r in score.evidence_gates(p).collect()}
    assert got == {"thin": (False, False), "echo": (True, True), "why": (True, False), "made": (True, True)}
    r = score.reconcile(spark.createDataFrame([(False, "The student gave it"), (False, " "), (True, None)], "awarded boolean, evidence string")).collect()
    assert [(x["awarded"], x["evidence"]) for x in r] == [(True, "[auto-corrected] The student gave it"), (False, score.NO_EVIDENCE), (True, None)]


def test_keep_first_with_null_groups(spark):
    df = spark.createDataFrame([(1, "g"), (2, "g"), (3, None), (4, None)], "i int, g string")
    assert sorted(r["i"] for r in score.keep_first(df, "g", [F.asc("i")], F.col("i")).collect()) == [1, 3, 4]


def test_next_batch_takes_due_first(spark):
    due = spark.createDataFrame([(1, 2), (2, 1)], "k int, box int")
    new = spark.createDataFrame([(2, 0), (3, 1), (4, 2), (5, 3)], "k int, o int")
    got = schedule.next_batch(due, new, "k", [F.asc("box")], [F.asc("o")], 4).orderBy("position").collect()
    assert [(r["k"], r["source"]) for r in got] == [(2, "review"), (1, "review"), (3, "new"), (4, "new")]


def test_bind_ties_and_tiers(spark):
    t = spark.createDataFrame([(1, "market demand supply"), (2, "nothing here"), (3, None)], "id int, text string")
    o = spark.createDataFrame([("B", "demand supply"), ("A", "market demand")], "o string, s string")
    assert [(r["id"], r["o"], r["score"]) for r in match.bind(t, "id", "text", o, "o", "s").collect()] == [(1, "A", 2)]
    got = match.bind_tiers(t, "id", "text", [(o.filter("o = 'B'"), "o", "s"), (o, "o", "s")]).collect()
    assert [(r["target"], r["tier"]) for r in got] == [("B", 0)]


def test_rewrites(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 3)], "k int, v string, o int")
    rows = lambda d: sorted((r["k"], r["v"]) for r in d.collect())
    assert rows(curate.insert_ignore(old, new, ["k"], ["o"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(curate.insert_replace(old, new, ["k"], [F.desc("o")])) == [(1, "a"), (2, "x"), (3, "z")]
    assert rows(curate.merge_state(old, spark.createDataFrame([(1, None), (4, "n")], "k int, v string"), ["k"], ["v"])) == [(1, "a"), (2, "b"), (4, "n")]


def test_skip_cascade(spark):
    df = spark.createDataFrame([(True, True, True), (False, False, True), (False, False, False)], "a boolean, b boolean, c boolean")
    rule = curate.skip_cascade([(F.col("a"), "a"), (F.col("b"), "b"), (F.col("c"), "c")], 1)
    assert [r["x"] for r in df.select(rule.alias("x")).collect()] == ["a,b", "c", None]


def test_twins_and_routes(spark):
    df = spark.createDataFrame([("A.docx",), ("a.pdf",), ("b.pdf",)], "n string")
    assert [r["n"] for r in curate.twins(df, F.col("n"), "docx", "pdf").collect()] == ["a.pdf"]


def test_lines(spark):
    df = spark.createDataFrame([("d", "[Page 2 x]first\nBEGIN[Page 3]mid[Page 5 y]END z")], "d string, t string")
    pages = lines.pages(df, ["d"], F.col("t"))
    assert [(r["page"], r["body"]) for r in pages.collect()] == [(2, "first\nBEGIN"), (3, "mid"), (5, "END z")]
    assert lines.page_range(pages, "d", "BEGIN", "^END").first()[1:] == (2, 4)
    assert [(r["page"], r["body"]) for r in lines.pages(spark.createDataFrame([("d", "plain")], "d string, t string"), ["d"], F.col("t")).collect()] == [(1, "plain")]


def test_page_of_an_offset(spark):
    p = spark.createDataFrame([("d", 1, 10), ("d", 2, 5), ("d", 3, 8)], "d string, page int, length int")
    at = spark.createDataFrame([("d", x) for x in (0, 10, 11, 16, 17, 99)], "d string, at int")
    assert [r["page"] for r in lines.page_of(at, p, "d").orderBy("at").collect()] == [1, 1, 2, 2, 3, 3]


def test_choice_questions(spark):
    t = "1. What?\n(A) one\n(B) two\n(C) three\n(D) four\n99. not a number here\n2. Next\nmore\n(A) a\n(B) b\n(C) c\n(D) d\n3. No options"
    got = lines.choice_questions(spark.createDataFrame([("f", t)], "f string, t string"), ["f"], "t").orderBy("number").collect()
    assert [(r["number"], r["stem"], r["options"]["D"]) for r in got] == [(1, "What?", "four 99. not a number here"), (2, "Next more", "d")]


def test_words_on_a_page(spark):
    w = spark.createDataFrame([("p", 5.0, 10.0, "b"), ("p", 1.0, 11.0, "a"), ("p", 2.0, 20.0, "c"), ("p", 400.0, 20.0, "out")], "p string, x double, y double, word string")
    assert [r["text"] for r in lines.word_lines(w, ["p"], 0, 300).orderBy("line").collect()] == ["a b", "c"]
    s = spark.createDataFrame([("p", 100.0, 250.0), ("p", 300.0, 500.0)], "p string, x0 double, x1 double")
    assert lines.gutter(s, "p").first()["width"] == 49


def test_checks(spark):
    frames = {"subjects": schemas.empty(spark, "subjects"), "user_feedback": spark.createDataFrame([(1, "o", "s", "x", "angry", None), (1, "o", "s", "x", "positive", None)], schemas.RELATIONS["user_feedback"].schema)}
    got = {(r["relation"], r["rule"]): r["n"] for r in schemas.violations(frames).collect()}
    assert got == {("user_feedback", "unique feedback_id"): 1, ("user_feedback", "sentiment is one of its values"): 1}
    old = spark.createDataFrame([("s", "S")], "subject_id string, display_name string")
    assert schemas.evolve(old, "subjects").columns == ["subject_id", "display_name", "syllabus_locked"]
    assert schemas.verify({"subjects": frames["subjects"]})[0] == "syllabus_sections"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿objective_id,content_stmt\nE-1,\"x, y\"\n,z\n", encoding="utf-8")
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv"), ("objective_id", "content_stmt")).collect()] == [("E-1", "x, y")]
    shapes = ['[{"id": "A", "statement": "s"}]', '[{"title": "T", "objectives": [{"objective_id": "A", "text": "s"}]}]', '{"sections": [{"title": "T", "objectives": [{"objective_id": "A", "text": "s"}]}]}', '{"objectives": [{"objective_id": "A", "content_stmt": "s"}]}']
    for i, s in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(s)
        r = files.syllabus_json(spark, str(tmp_path / f"{i}.json")).first()
        assert (r["objective_id"], r["content_stmt"]) == ("A", "s")
    (tmp_path / "mcq.json").write_text('{"subjectId": "e", "questions": [{"id": "1", "topic": "t", "options": {" a ": "x", "b": "y"}, "answer": "A"}, {"id": "2", "options": {"a": "x"}, "answer": "Q"}]}')
    good, bad = files.mcq_bank(spark, str(tmp_path / "mcq.json"))
    assert [r["id"] for r in good.collect()] == ["1"] and [r["reason"] for r in bad.collect()] == ["no valid answer: 2"]
    (tmp_path / "s.txt").write_text("HEAD\nQUESTION 1: Why?\nANSWER: So.\nAnd so.\nQUESTION 2: Who?")
    got = {r["number"]: (r["question"], r["answer"], r["reason"]) for r in files.solutions(spark, str(tmp_path / "s.txt")).collect()}
    assert got == {1: ("Why?", "So.\nAnd so.", None), 2: ("Who?", None, "no answer")}
    (tmp_path / "f.md").write_text('---\nobjectives: ["A", "B"]\n---\nSome text.')
    assert sorted((r["objective_id"], r["chunk"]) for r in files.front_matter(spark, str(tmp_path / "f.md")).collect()) == [("A", "Some text."), ("B", "Some text.")]
    d = files.decoded(spark, str(tmp_path / "s.txt"), files.decode_text).collect()
    assert d[0]["page"] == 1 and d[0]["body"].startswith("HEAD")
    walked = {r["path"].rsplit("/", 1)[1] for r in files.walk(spark, [str(tmp_path)], skip=(r"\d\.json",)).collect()}
    assert walked == {"a.csv", "mcq.json", "s.txt", "f.md"}


def test_dispatch(spark):
    df = spark.createDataFrame([("/x/notes/a.md",), ("/x/past_papers/econ_2011.pdf",), ("/x/y.docx",), ("/x/z.bin",)], "path string")
    assert [r["family"] for r in files.triage(df).collect()] == ["notes", "pdf", "office", None]
    assert [r["content_type"] for r in files.triage(df).collect()] == ["notes", "past_paper", None, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([], "a string, b int")
    sinks.csv_file(df, str(tmp_path / "out"), ["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b"]
    good, bad = sinks.split_valid(spark.createDataFrame([(1,), (-1,)], "v int"), F.when(F.col("v") < 0, "negative"))
    assert [r["v"] for r in good.collect()] == [1]
    assert sinks.review_rows(bad, ["v"], F.col("reason")).first()["payload"] == '{"v":-1}'
    v = spark.createDataFrame([(f"p{i}", i) for i in range(33)], "path string, modified int")
    assert sorted(r["path"] for r in sinks.expired(v).collect()) == ["p0", "p1", "p2"]
