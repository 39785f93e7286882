"""Line dedup against a plain version, before and after documents are taken out again."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import DOCS, UPPER
from pyspark.sql import functions as F

from syllabrook.llm import line_dedup, queries
from syllabrook.llm.cuckoo import Cuckoo
from syllabrook.llm.line_dedup import LineIndex

LONG = "this line is long enough to count"
EXACT = "é" * 20  # 20 code points, 40 bytes


def rows():
    out = [(i, f"head {i}\n{LONG}\n  {LONG.upper()}\t\ntail {i}") for i in range(5)]
    out += [(10, f"{LONG}\n{LONG}\n"), (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, EXACT), (15, f"{EXACT}\n"), (16, f" {EXACT}"), (17, f" {EXACT}\x0b")]
    out += [(20 + i, "found in two documents only\nshort") for i in range(2)]
    out += [(30, None), (31, ""), (32, "\n\n"), (33, "a\r\nb")]
    out += [(40, "repeated rows hold this line"), (40, "repeated rows hold this line"), (41, "repeated rows hold this line")]
    out += [(None, "repeated rows hold this line"), (None, "only rows without an id hold it"), (None, "only rows without an id hold it"), (None, "only rows without an id hold it")]
    return out


def keys(text):
    for i, line in enumerate((text or "").split("\n")):
        key = line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
        if len(key) >= 20:
            yield i, key


def plain(docs):
    """(doc_id, n_lines, n_dropped, kept) of each document."""
    holders = defaultdict(list)
    for doc_id, text in docs:
        for key in {k for _, k in keys(text)}:
            holders[key].append(doc_id)
    largest = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for doc_id, text in docs:
        gone = {i for i, k in keys(text) if k in largest and largest[k] != doc_id}
        lines = (text or "").split("\n")
        out.append((doc_id, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], DOCS).repartition(3)


def test_dedup(spark):
    got = line_dedup.dedup_lines(frame(spark, rows()).withColumns({"row": F.lit(1), "kept": F.lit("own")}), keep=("row", "kept"))
    assert {(r["row"], r["kept"]) for r in got.select("columns.*").collect()} == {(1, "own")}
    assert sorted((tuple(r) for r in got.drop("columns").collect()), key=str) == plain(rows())


def test_query(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_line_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in plain(rows())), key=str)


def test_no_documents(spark, none):
    assert line_dedup.dedup_lines(none).count() == 0


def numbered(spark, docs, start):
    return spark.createDataFrame([(start + n, i, t) for n, (i, t) in enumerate(docs)], "row long, doc_id long, text string").repartition(2)


def dropped(index, texts):
    lost = {r["row"]: r["drop"] for r in index.drops().collect()}
    return sorted(((i, (t or "").split("\n"), lost.get(n, [])) for n, (i, t) in texts.items()), key=str)


def expected(docs):
    holders = defaultdict(list)
    for doc_id, text in docs:
        for key in {k for _, k in keys(text)}:
            holders[key].append(doc_id)
    largest = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    return sorted(((i, (t or "").split("\n"), sorted(n for n, k in keys(t) if k in largest and largest[k] != i)) for i, t in docs), key=str)


def test_increments_and_deletions_are_reversible(spark, tmp_path):
    docs = [d for d in rows() if d[0] is not None]
    first, second = docs[:9], docs[9:]
    one = LineIndex.empty(spark, 3).insert(numbered(spark, first, 0))
    assert dropped(one, dict(enumerate(first))) == expected(first)
    two = one.insert(numbered(spark, second, 100))
    texts = dict(enumerate(first)) | {100 + n: d for n, d in enumerate(second)}
    assert dropped(two, texts) == expected(docs)
    two.save(f"file://{tmp_path}/index")
    two = LineIndex.load(spark, f"file://{tmp_path}/index")
    gone = [10, 4, 40, 999]
    three = two.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = {n: d for n, d in texts.items() if d[0] not in gone}
    assert dropped(three, left) == expected(list(left.values()))
    back = three.insert(numbered(spark, [d for d in docs if d[0] in gone], 200))
    assert dropped(back, left | {200 + n: d for n, d in enumerate([d for d in docs if d[0] in gone])}) == expected(docs)
    assert sorted((bytes(r["key"]), r["n"]) for r in back.counts.collect()) == sorted((bytes(r["key"]), r["n"]) for r in two.counts.collect())


def test_filters_hold_the_repeated_keys(spark):
    docs = [(i, "\n".join(f"a line that many documents hold, number {k}" for k in range(60))) for i in range(3)]
    docs += [(9, "\n".join(f"a line that nobody else has, number {k}" for k in range(500)))]
    index = LineIndex.empty(spark, 4).insert(numbered(spark, docs, 0))
    assert sum(r["n"] for r in index.filters.collect()) == 60
    assert index.references.count() == 680 and 180 <= index.repeated().count() < 190
    assert sum(r["n"] for r in index.delete(spark.createDataFrame([(0,)], "doc_id long")).filters.collect()) == 0


def digests(rng, n):
    return rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2), dtype=np.uint64)


@pytest.mark.parametrize(("buckets", "n"), [(4, 12), (64, 200), (4096, 13000), (4, 60)])
def test_cuckoo_keeps_what_it_holds(buckets, n):
    rng = np.random.default_rng(n)
    a, b = digests(rng, n), digests(rng, n // 3)
    c = Cuckoo(buckets)
    c.insert(a)
    c.insert(b)
    assert c.has(a).all() and c.has(b).all() and c.n == len(a) + len(b)
    c.delete(a)
    assert c.has(b).all() and c.n == len(b)
    c.delete(b)
    assert not c.cells.any() and not c.spare


def test_cuckoo_finds_few_others():
    rng = np.random.default_rng(1)
    c = Cuckoo(1 << 12)
    c.insert(digests(rng, 13000))
    assert c.has(digests(rng, 200_000)).mean() < 1 / 4000


def test_equal_fingerprints_leave_one_by_one():
    d = np.array([[5, 8 * i] for i in range(1, 12)], dtype=np.uint64)  # one fingerprint, one bucket
    c = Cuckoo(8)
    c.insert(d)
    for i in range(len(d)):
        assert c.has(d[i:]).all()
        c.delete(d[i : i + 1])
    assert not c.has(d).any()
