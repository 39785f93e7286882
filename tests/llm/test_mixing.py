import pytest
from helpers import words
from pyspark.sql import functions as F

from syllabrook.llm import mixing


def test_targets_stop_at_three_times_the_source(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 5)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    # shares 5, 2, 1, 5: a and null stop, b and c share the rest by 2 and 1
    assert t["a"] == 30 and t[None] == 15
    assert t["b"] == pytest.approx(1470 * 2 / 3) and t["c"] == pytest.approx(1470 / 3)


def test_taken_words(spark, docs):
    got = mixing.taken_words(mixing.mix(docs)).collect()
    assert len(got) == docs.count()
    assert sorted(r["size"] for r in got) == sorted(len(words(r["text"])) for r in docs.collect())
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) == total
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)


def test_reruns_agree(docs):
    once, twice = (sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.taken_words(mixing.mix(d)).collect()) for d in (docs, docs.repartition(5)))
    assert once == twice


def test_schedule_is_in_order_of_virtual_time(docs):
    rows = mixing.in_order(mixing.schedule(mixing.mix(docs))).collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    assert sum(r["taken"] < r["size"] for r in rows) <= 1


def test_nothing_to_mix(none, spark):
    assert mixing.taken_words(mixing.mix(none)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.taken_words(mixing.mix(blank)).collect()] == [(0, 0.0, 0)] * 2


def test_first_words(spark):
    df = spark.createDataFrame([(" a  b\nc d ",)], "t string")
    assert df.select(mixing.first_words(F.col("t"), F.lit(3))).first()[0] == " a  b\nc"


def test_no_python_in_the_plan(docs):
    plan = mixing.taken_words(mixing.mix(docs))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "RDDScan"))
