"""Writes that persist: buckets, commits, refused and carried changes, migrations, and what is left of a change that was lost."""

import threading

import pytest
from pyspark.sql import functions as F

from syllabrook import schemas
from syllabrook.sources import migrations
from syllabrook.sources.migrations import ALREADY, APPLIED, Migration
from syllabrook.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    c = s.begin()
    c.create("scores", "id long, name string, score int", ("id",), 8)
    c.insert("scores", rows(spark, [(i, f"n{i}", i) for i in range(20)]), [F.asc("id")])
    c.commit("start")
    return s


def rows(spark, data, schema="id long, name string, score int"):
    return spark.createDataFrame(data, schema)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_keeps_and_replace_takes(spark, store):
    c = store.begin()
    c.insert("scores", rows(spark, [(3, "late", 99), (30, "b", 2), (30, "a", 1), (None, "no key", 0)]), [F.asc("score")])
    c.replace("scores", rows(spark, [(4, "second", 5), (4, "first", 9), (31, "new", 1)]), [F.desc("score")])
    assert store.read("scores").count() == 20  # not seen before the commit
    assert c.read("scores").filter("id >= 30").count() == 2  # but by the change itself
    c.commit()
    got = {r["id"]: (r["name"], r["score"]) for r in store.read("scores").collect()}
    assert got == {i: (f"n{i}", i) for i in range(20)} | {30: ("a", 1), 4: ("first", 9), 31: ("new", 1)}


def test_merge_update_delete(spark, store):
    c = store.begin()
    c.merge("scores", rows(spark, [(1, "x", 10), (50, "y", 7)]), [F.asc("id")], {"score": F.col("old.score") + F.col("new.score")})
    c.update("scores", {"name": F.upper("name"), "score": F.col("score") * 2}, F.col("id") == 2)
    c.delete("scores", F.col("score").between(5, 8) & (F.col("id") < 40))
    c.delete_keys("scores", rows(spark, [(9,), (9,), (77,)], "id long"))
    c.commit()
    got = {r["id"]: (r["name"], r["score"]) for r in store.read("scores").collect()}
    assert got == {i: (f"n{i}", i) for i in range(20) if i not in (5, 6, 7, 8, 9)} | {1: ("n1", 11), 2: ("N2", 4), 50: ("y", 7)}


def test_only_touched_buckets_are_written(spark, store):
    before = store.snapshot().tables["scores"].parts
    c = store.begin()
    c.replace("scores", rows(spark, [(3, "three", 3)]), [F.asc("id")])
    c.commit()
    after = store.snapshot().tables["scores"].parts
    assert sum(before[b] != after[b] for b in before) == 1


def test_old_versions_stay_until_they_expire(spark, store, tmp_path):
    for k in range(3):
        c = store.begin()
        c.replace("scores", rows(spark, [(0, "zero", k)]), [F.asc("id")])
        c.commit(f"round {k}")
    assert [store.read("scores", v).filter("id = 0").first()["score"] for v in (1, 2, 3, 4)] == [0, 0, 1, 2]
    assert [r["note"] for r in store.history().orderBy("version").collect()] == ["start", "round 0", "round 1", "round 2"]
    lost = store.begin()
    lost.replace("scores", rows(spark, [(0, "never committed", 0)]), [F.asc("id")])
    assert store.expire(keep=1) == 0  # what was written just now may still be committed
    assert store.versions() == [4] and store.expire(keep=1, idle_hours=-1) == 3
    assert told(store.read("scores").filter("id = 0")) == [(0, "zero", 2)] and store.read("scores").count() == 20
    with pytest.raises(KeyError, match="version 1"):
        store.read("scores", 1)


def test_a_change_that_is_lost_leaves_the_old_version(spark, store):
    c = store.begin()
    c.delete("scores", F.lit(True))
    broken = F.udf(lambda x: 1 // 0, "int")("score")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        c.replace("scores", rows(spark, [(1, "a", 1)]).withColumn("score", broken), [F.asc("id")])
    assert store.read("scores").count() == 20 and store.versions() == [1]


def test_of_two_writers_one_is_refused(spark, store):
    outcome, start = {}, threading.Barrier(2)

    def write(name):
        c = store.begin()
        c.update("scores", {"name": F.lit(name)}, F.col("id") == 5)
        start.wait()
        try:
            outcome[name] = c.commit(name)
        except Conflict as e:
            outcome[name] = str(e)

    both = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    won = [n for n, o in outcome.items() if o == 2]
    assert len(won) == 1 and "was written by version 2" in next(o for n, o in outcome.items() if n != won[0])
    assert told(store.read("scores").filter("id = 5")) == [(5, won[0], 5)]


def test_writers_of_other_buckets_both_go_on(spark, store):
    of = {r["id"]: r["b"] for r in store.read("scores").select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).collect()}
    x = 0
    y = next(i for i in of if of[i] != of[x])
    a, b = store.begin(), store.begin()
    a.update("scores", {"score": F.lit(100)}, F.col("id") == x)
    b.update("scores", {"score": F.lit(200)}, F.col("id") == y)
    b.create("log", "what string")
    b.append("log", rows(spark, [("b",)], "what string"))
    assert (a.commit(), b.commit()) == (2, 3)
    got = {r["id"]: r["score"] for r in store.read("scores").collect()}
    assert got[x] == 100 and got[y] == 200 and len(got) == 20 and told(store.read("log")) == [("b",)]


def test_appends_never_refuse_each_other(spark, store):
    c = store.begin()
    c.create("log", "what string")
    c.commit()
    a, b = store.begin(), store.begin()
    a.append("log", rows(spark, [("a",)], "what string"))
    b.append("log", rows(spark, [("b",)], "what string"))
    a.commit()
    b.commit()
    assert told(store.read("log")) == [("a",), ("b",)]


def test_wrong_uses(spark, store):
    c = store.begin()
    c.create("log", "what string")
    with pytest.raises(ValueError, match="has no key"):
        c.insert("log", rows(spark, [("a",)], "what string"), [F.asc("what")])
    with pytest.raises(ValueError, match="has a key"):
        c.append("scores", rows(spark, [(1, "a", 1)]))
    assert Store(spark, store.root + "-none").versions() == []


def test_empty_writes_and_other_columns(spark, store):
    c = store.begin()
    c.replace("scores", rows(spark, []), [F.asc("id")])
    c.delete("scores", F.lit(None).cast("boolean"))
    c.replace("scores", rows(spark, [(1, 7)], "id long, other int"), [F.asc("id")])
    c.commit()
    assert told(store.read("scores").filter("id = 1")) == [(1, None, None)] and store.read("scores").columns == ["id", "name", "score"]


FILE = """-- Adds the bank; existing rows get NULL.
CREATE TABLE IF NOT EXISTS bank (
  mcq_id TEXT PRIMARY KEY, -- the id; it stays
  stem TEXT NOT NULL DEFAULT '',
  difficulty INTEGER CHECK (difficulty IN (1, 2, 3)),
  UNIQUE (stem, difficulty)
);
ALTER TABLE scores ADD COLUMN level INTEGER DEFAULT 0;
CREATE INDEX IF NOT EXISTS i ON bank (stem);
"""


def test_migrations_are_applied_once_with_their_ledger_row(spark, store):
    m = migrations.from_file("m018", FILE, "bank of questions")
    assert migrations.migrate(store, [m]) == [("m018", APPLIED)]
    assert store.versions() == [1, 2]  # the tables and the ledger came with one commit
    assert migrations.migrate(store, [m]) == [("m018", ALREADY)] and store.versions() == [1, 2]
    bank = store.snapshot().tables["bank"]
    assert bank.key == ("mcq_id",) and [f.simpleString() for f in bank.schema] == ["mcq_id:string", "stem:string", "difficulty:bigint"]
    assert store.read("scores").filter("level is null").count() == 20
    again = migrations.from_file("m019", FILE)
    assert migrations.migrate(store, [again]) == [("m019", APPLIED)]
    assert told(store.read("schema_migrations").select("version", "description")) == [("m018", "bank of questions"), ("m019", "m019" + migrations.PRE_EXISTING)]


def test_a_migration_that_fails_leaves_nothing(spark, store):
    def half(change):
        change.add_column("scores", "half", "int")
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        migrations.migrate(store, [Migration("m1", "", half)])
    with pytest.raises(ValueError, match="does neither"):
        migrations.migrate(store, [migrations.from_file("m2", "ALTER TABLE scores ADD COLUMN x TEXT; DROP TABLE scores")])
    assert store.versions() == [1] and store.read("scores").columns == ["id", "name", "score"]


def test_a_column_can_be_filled_by_the_migration_that_adds_it(spark, store):
    def steps(change):
        new = change.add_column("scores", "level", "int")
        change.update("scores", {"level": F.col("score") % 3}, F.lit(True))
        return new

    migrations.migrate(store, [Migration("m1", "levels", steps)])
    assert [r["level"] for r in store.read("scores").orderBy("id").collect()] == [i % 3 for i in range(20)]


def test_two_runs_of_one_migration(spark, store):
    calls, start = [], threading.Barrier(2, timeout=60)

    def steps(change):
        calls.append(1)
        if len(calls) <= 2:
            start.wait()
        return change.add_column("scores", "level", "int")

    out = []
    both = [threading.Thread(target=lambda: out.extend(migrations.migrate(store, [Migration("m1", "x", steps)]))) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(o for _, o in out) == [ALREADY, APPLIED] and store.read("schema_migrations").count() == 1


def test_bootstrap(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/model")
    assert migrations.bootstrap(s) == len(schemas.RELATIONS) and migrations.bootstrap(s) == 0
    assert schemas.verify({n: s.read(n) for n in schemas.RELATIONS}) == [] and s.versions() == [1]
