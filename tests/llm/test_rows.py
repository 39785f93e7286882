"""What every operator on texts keeps of its rows: ids beyond 2**53, nulls, clashing and odd columns; and shared folders."""

from types import SimpleNamespace

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from syllabrook.llm import bpe, common, dedup, jaccard, lm
from syllabrook.llm.queries import tokenizer_path

BIG = (1 << 53) + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def big(spark):
    long = " ".join(f"word{i}" for i in range(90))
    rows = [(BIG, long), (None, "another text"), (BIG + 2, long + " more"), (BIG + 4, None), (None, None)]
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).coalesce(1)


IDS = [BIG, BIG + 2, BIG + 4, None, None]


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda i: (i is None, i))


def test_large_ids_beside_null_ones(spark, big):
    assert ids(dedup.remove(big)) == IDS
    groups = jaccard.linked(big)
    assert ids(groups) == IDS
    assert {r["doc_id"]: r["component_id"] for r in groups.collect() if r["doc_id"]} == {BIG: BIG, BIG + 2: BIG, BIG + 4: BIG + 4}
    assert ids(bpe.encode(big, tokenizer_path(), decoded="d")) == IDS
    assert ids(lm.score(big, F.lit(True))) == IDS
    assert ids(corpus_pipeline.tokenize(spark, big, "")) == IDS
    assert ids(corpus_pipeline.cut_repeats(spark, big, "")) == IDS
    assert ids(corpus_pipeline.drop_near_copies(spark, big, "")) == [BIG, BIG + 4, None, None]


def test_short_texts_are_named_by_their_words():
    (a, c), (b, d) = jaccard.tokens_of("one two", 3), jaccard.tokens_of("One\ttwo", 3)
    assert len(a) == 1 and c == d and list(a) == list(b)
    assert jaccard.tokens_of("one three", 3)[1] != c and jaccard.tokens_of("a a a a", 3)[1] == jaccard.tokens_of("a a a", 3)[1]


ODD = ("key", "row", "rare", "n", "c", "kept", "columns", "size", "bucket", "__row", "a.b", "a b")


def test_extra_columns(spark, big):
    more = big.withColumns({name: F.struct(F.col("doc_id").alias("x y"), F.lit(name).alias("own")) for name in ODD})
    want = sorted((str(i), name) for i in ids(big) for name in ODD)
    told = lambda rows: sorted((str(r[name]["x y"]), r[name]["own"]) for r in rows for name in ODD)
    assert told(bpe.encode(more, tokenizer_path()).collect()) == want
    assert told(lm.score(more, F.lit(True), keep=ODD).collect()) == want
    assert told(r["columns"] for r in dedup.remove(more, keep=ODD).collect()) == want


@pytest.mark.parametrize("stage", [corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats, corpus_pipeline.mix, corpus_pipeline.tokenize])
def test_stages_with_extra_columns_and_without_rows(spark, big, stage):
    more = big.withColumns({"url": F.lit("u"), "size": F.lit(1), "taken": F.lit(1), "order": F.lit(1), "doc": F.lit(1), "key": F.lit("k"), "kept": F.lit(2.5), "finds": F.lit(None).cast("string")})
    got = common.stored(stage(spark, more, ""))
    if stage is not corpus_pipeline.tokenize:
        assert got.columns == more.columns
        assert {(r["url"], r["size"], r["key"], r["kept"]) for r in got.collect()} == {("u", 1, "k", 2.5)}
    assert stage(spark, more.limit(0), "").count() == 0


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(session)


def test_what_was_written_elsewhere_is_an_error(spark, monkeypatch, tmp_path):
    here = tmp_path / "a"
    monkeypatch.setattr(common, "scratch", lambda s: f"file://{here}")
    df = spark.range(3)

    class Lost:
        """Writes where the driver does not look."""

        sparkSession, schema = spark, df.schema
        write = SimpleNamespace(parquet=lambda path: here.mkdir())

    with pytest.raises(RuntimeError, match="not shared"):
        common.stored(Lost())


def test_end_sign_and_zero_bytes():
    assert lm.escaped(b"a\x00b\x01c") == b"a\x01\x03b\x01\x02c" and lm.escaped(b"plain") == b"plain"
    seen = [lm.escaped(x) for x in (b"\x00", b"\x01", b"\x01\x02", b"\x01\x03", b"\x00\x01", b"\x01\x00")]
    assert len(set(seen)) == len(seen) and not any(b"\x00" in x for x in seen)


def test_counts_beyond_a_cell():
    import numpy as np

    cells, full = np.zeros(4, dtype=np.uint16), {}
    for _ in range(5):
        lm._add_up(cells, np.full(70_000, 2), full)
    assert int(cells[2]) + full[2] == 350_000 and cells[[0, 1, 3]].sum() == 0


def test_counts_added_in_rounds(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "ADDED", 4)
    rows = [(k % 2, 0, bytearray(lm._sent(np.array([k, 100]), np.array([k + 1, 1])))) for k in range(60)]
    got = lm._added(spark.createDataFrame(rows, "kind long, fold int, x binary")).collect()
    total = np.zeros(101, dtype=int)
    for r in got:
        at, n = lm._received(bytes(r["x"]))
        np.add.at(total, at, n)
    assert len(got) < 10 and total[100] == 60 and total[:60].tolist() == list(range(1, 61))
