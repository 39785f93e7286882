"""Test tables, and the comparison of a result with its SQL."""

from collections import Counter

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v)


def same(df, duck, sql):
    r = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    want = Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    got = Counter(tuple(plain(x[c]) for c in cols) for x in df.collect())
    assert got == want
