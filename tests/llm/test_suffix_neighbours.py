"""Common prefixes where two buckets of the suffix array meet."""

import numpy as np
from pyspark.sql import functions as F

from syllabrook.llm import dedup, suffix

PASSAGE = "".join(chr(97 + i * i % 23) for i in range(11)) + "the passage that follows a rare letter in both pieces"


def test_letters_that_differ_before_a_passage():
    s = np.frombuffer(f"Z{PASSAGE}\0Y{PASSAGE}\0".encode(), dtype=np.uint8).astype(np.uint16)
    sa, flat = suffix.suffix_array(s), s.tolist()
    starts = np.array([0, len(PASSAGE) + 2])
    common = suffix.common_prefixes(s, sa, starts)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = next((k for k in range(len(flat) - max(a, b)) if flat[a + k] != flat[b + k] or not flat[b + k]), 0)
        left = flat[b:].index(0)
        assert min(common[b], left) == n


def test_windows_after_rare_letters_have_one_smallest_id():
    size = np.array([len(PASSAGE) + 1] * 2)
    low = dedup._smallest(f"Z{PASSAGE}Y{PASSAGE}".encode(), size, np.array([1, 2]))
    n = len(PASSAGE) + 2 - dedup.WINDOW
    assert low.tolist() == [1] * n + [2] + [1] * (n - 1)


def test_passage_after_rare_letters_goes(spark):
    docs = spark.createDataFrame([(1, f"Z{PASSAGE}"), (2, f"Y{PASSAGE}")], "doc_id long, text string")
    got = dedup.remove(docs).select("doc_id", "n_removed", F.col("kept_text")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 0, f"Z{PASSAGE}"), (2, len(PASSAGE), "Y")]
