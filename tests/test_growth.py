"""Steps whose cost once grew faster than their input, or that held more of it at once than they should."""

import math
import random
import unicodedata

from pyspark.sql import functions as F
from support import DATA

from syllabrook.functions import json_schema, parsing, text
from syllabrook.operators import gates, lines, lookup, semantic, status
from syllabrook.plans import rules


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_are_never_sent_to_the_driver(spark):
    known = [(1, "State the law of demand and what it says of goods", 1), (2, "state the law of supply", 2), (3, "State the Law of Supply ", 3), (4, "xy", 4)]
    texts = {"State the law of DEMAND and what it says of all others": (1, 2), "state the law of supply; and": (3, 1), "STATE THE LAW OF SUPPLY": (3, 0), "state the": (1, 2), "x": (4, 2), "": (None, None), "y": (None, None), None: (None, None)}
    objectives = spark.createDataFrame(known, "objective_id int, content_stmt string, ordinal int")
    got = lookup.resolved(spark.createDataFrame([(t,) for t in texts], "t string"), "t", objectives)
    assert {r["t"]: (r["objective_id"], r["tier"]) for r in got.collect()} == texts
    plan = planned(got)
    assert "BroadcastHashJoin" not in plan and "Generate" not in plan  # only lengths, 40 at most, are sent around


def test_short_beginnings_cost_only_the_lengths_that_are_asked_for(spark):
    objectives = spark.createDataFrame([(i, f"{i:05d} is a statement of more than forty letters", i) for i in range(50)], "objective_id int, content_stmt string, ordinal int")
    rows = objectives.select(F.concat("content_stmt", F.lit("!")).alias("t"))
    got = lookup.resolved(rows, "t", objectives)
    assert got.filter("tier = 2").count() == 50


def test_violations_are_told_once_an_answer(spark):
    a = spark.createDataFrame([(1, '{"objective_id": "O", "question_id": "Q", "points": []}')], "i int, answer string")
    _, bad = gates.graded(a, "answer", gates.SYLLABUS_GRADING)
    got = bad.select("i", F.explode("violations").alias("v"))
    assert [tuple(r) for r in got.collect()] == [(1, "$.points: fewer than 3 items")]
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert plan.count("parsejson") == 1 and "schemaofvariant(lambda" in plan, plan


def test_types_of_scalars(spark):
    kinds = {"string": '"a"', "number": "1.5", "integer": "2", "boolean": "true", "object": "{}", "array": "[]", "null": "null"}
    df = spark.createDataFrame([(k, f'{{"x": {v}}}') for k, v in kinds.items()], "k string, t string")
    for kind in kinds:
        got = {r["k"] for r in df.filter(F.size(json_schema.violations(F.col("t"), {"type": "object", "properties": {"x": {"type": kind}}})) == 0).collect()}
        assert got == {kind, "integer"} if kind == "number" else got == {kind}
    loose = {"required": ["x"], "properties": {"x": {"minItems": 1, "items": {"type": "string"}}}}
    texts = {"[1]": [], "{}": ["$.x: missing"], '{"x": []}': ["$.x: fewer than 1 items"], '{"x": [1]}': ["$.x[0]: not a string"], '{"x": "a"}': []}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", json_schema.violations(F.col("t"), loose).alias("v")).collect()} == texts


def test_verbs_are_found_in_one_pass(spark):
    texts = ["Explain and STATE why; explain_ use2 éuse", "re-use, find it", None, "", "Reuse", "order-order (Make) 3list list3 ſtate Ma\u212ae İdentify"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    at = F.array(*[F.struct(F.regexp_instr("t", F.lit(rf"(?i)\b{v}\b")).alias("at"), F.lit(v).alias("verb")) for v in parsing.VERBS])
    plain = F.transform(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), lambda x: x["verb"])
    skill = F.lit(parsing.UNCLASSIFIED)
    for name, verbs in reversed(parsing.SKILLS):
        skill = F.when(F.col("t").rlike(rf"(?i)\b({'|'.join(verbs)})\b"), F.lit(name)).otherwise(skill)
    got = df.select(parsing.command_words(F.col("t")).alias("v"), plain.alias("w"), parsing.skill_type(F.col("t")).alias("s"), skill.alias("z"))
    assert all(r["v"] == r["w"] and r["s"] == r["z"] for r in got.collect()), got.collect()
    assert df.select(parsing.command_words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 3


def test_gutters_cost_a_row_a_key(spark):
    rnd = random.Random(5)
    spans = [(k, x := rnd.uniform(200, 330), x + rnd.choice([-60, 0, 3, 20, 70])) for k in range(40) for _ in range(rnd.randint(1, 9))] + [(-1, 0.0, 999.0), (-2, 293.0, 293.0), (-3, 294.0, 999.0), (-4, None, 240.0), (-5, 250.0, None)]
    want = {}
    for k in {s[0] for s in spans}:
        taken = set()
        for _, x0, x1 in (s for s in spans if s[0] == k):
            a = max(math.floor(230 if x0 is None else x0), 230)
            taken |= set(range(a, max(min(math.floor(320 if x1 is None else x1), 320), a) + 1))
        free, runs = [x for x in range(230, 321) if x not in taken], []
        for x in free:
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        if runs:
            lo, hi = min(runs, key=lambda r: (r[0] - r[1], r[0]))
            want[k] = ((lo + hi) / 2, hi - lo + 1)
    got = lines.gutter(spark.createDataFrame(spans, "k int, x0 double, x1 double"), "k")
    assert {r["k"]: (r["middle"], r["width"]) for r in got.collect()} == want and -1 not in want
    assert got.dtypes == [("k", "int"), ("middle", "double"), ("width", "bigint")]
    assert "Generate" not in planned(got) and "Join" not in planned(got)


def test_lists_of_questions_come_from_one_reading(spark):
    plan = planned(rules.question_filters(spark, DATA))
    assert plan.count("FileScan") == 3 and "BroadcastHashJoin" not in plan
    counted = plan[plan.index("partial_count"):]
    assert counted.index("REPARTITION_BY_COL") < counted.index("FileScan")  # counted after the dealing, so a task holds its own share only


def test_causes_are_dealt_before_they_are_grouped(spark):
    log = spark.createDataFrame([(2, '["a", "b"]', 5), (1, '["a"]', 6), (3, '["a"]', 4), (4, "[]", 1)], "staging_id int, lessons_staled string, started_at int")
    files = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "staging_id int, original_name string")
    lessons = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "objective_id string, is_stale boolean")
    out = status.stale_causes(lessons, log, files)
    assert {r["objective_id"]: r["caused_by_files"] for r in out.collect()} == {"a": ["x", "y"], "b": ["y"], "c": []}
    assert "REPARTITION_BY_COL" in planned(out)


def test_only_the_best_of_a_cell_are_shuffled(spark, tmp_path):
    rnd = random.Random(3)
    data = [("a", i, [rnd.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(data, "kind string, id long, vec array<double>")
    got = semantic.lookup(semantic.build(df, f"file://{tmp_path}/index", least=40), df.filter("id < 9").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), {"a": 4})
    want = [(q, i) for q, (_, _, v) in enumerate(data[:9]) for _, i in sorted((math.dist(v, w), i) for _, i, w in data)[:4]]
    assert sorted((r["q_id"], r["id"]) for r in got.collect()) == sorted(want)
    assert "WindowGroupLimit" in planned(got)


def test_ascii_texts_stay_out_of_python(spark):
    texts = ["plain", "", None, "ﬁne ① é", "é", *["x" * i + "Å" for i in range(300)]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", text.nfkc_in_python(F.col("t")).alias("n"))
    assert [r["n"] for r in got.collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan
