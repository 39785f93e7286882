import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from syllabrook.llm import url_filter as u

URLS = ["http://a.b.net/x", "https://Example.NET/en/a?q#f", "http://x.example.net/en", "http://example.com/de/1", "http://notexample.com/de/1", "http://org/fr/", "http://w.org/fr/x", "http://w.org/de/", "net", None, "", "://", "ftp://net", "http://net/?x", "http://evilnet/", "http://h.net/#://y", "http://q?z/w", "http://example.com:80/de/"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = rest[: min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])]
    after = rest[len(host) :]
    path = after[: min([after.index(c) for c in "?#" if c in after] + [len(after)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def run(spark, urls, rules=None):
    df = spark.createDataFrame([(i, x, "keep", "clash") for i, x in enumerate(urls)], "page_id long, url string, more string, rule string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.filter_urls(df, u.rule_table(spark, rules)).collect()}


def test_urls(spark):
    assert run(spark, URLS) == {i: plain(x) for i, x in enumerate(URLS)}


def test_repeated_pages_keep_their_rows(spark):
    df = spark.createDataFrame([(1, URLS[0])] * 3, "page_id long, url string")
    assert u.filter_urls(df, u.rule_table(spark)).count() == 3


def test_no_rules_and_no_pages(spark):
    assert run(spark, URLS[:2], []) == {0: ("a.b.net", "/x", None, "allow"), 1: ("example.net", "/en/a", None, "allow")}
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string"), u.rule_table(spark)).count() == 0


def test_many_rules_have_no_false_negatives(spark):
    rules = [(f"h{i}.example", "/", "block") for i in range(3000)]
    got = run(spark, [f"http://h{i}.example/p" for i in range(0, 3000, 30)] + [f"http://g{i}.example/p" for i in range(100)], rules)
    assert [got[i][3] for i in range(100)] == ["block"] * 100 and [got[i][3] for i in range(100, 200)] == ["allow"] * 100
    keys = u.rule_table(spark, rules).selectExpr("concat(host, path) as key")
    words = u.build_filter(keys)
    h = np.array([(r[0], r[1]) for r in keys.selectExpr("xxhash64(key, 1)", "xxhash64(key, 7)").collect()])
    assert u.may_contain(words, h[:, 0], h[:, 1]).all()
    other = np.array([(r[0], r[1]) for r in spark.range(20000).selectExpr("xxhash64(concat('o', id), 1)", "xxhash64(concat('o', id), 7)").collect()])
    assert u.may_contain(words, other[:, 0], other[:, 1]).mean() < 0.02


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=5))
def test_an_empty_filter_contains_nothing(hashes):
    assert not u.may_contain(np.zeros((4, u.BLOCK_WORDS), dtype=np.uint64), np.array(hashes), np.array(hashes)).any()


def test_a_thousand_shapes_and_salted_rules(spark, monkeypatch):
    rules = [("a." * k + f"h{k}.net", "/" + "x" * n, "block" if (k + n) % 3 else "allow") for k in range(20) for n in range(50)]
    urls = [f"http://w.{'a.' * k}h{k}.net/{'x' * n}y" for k in range(0, 20, 3) for n in range(0, 60, 7)] + [None, "http://h0.net", "http://h0.net/"]

    def want(url):
        if url is None:
            return (None, "allow")
        host, _, path = url[7:].partition("/")
        path = f"/{path}" if "/" in url[7:] else ""
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    expected = {i: want(x) for i, x in enumerate(urls)}
    assert {i: r[2:] for i, r in run(spark, urls, rules).items()} == expected
    monkeypatch.setattr(u, "BROADCAST", 0)
    assert {i: r[2:] for i, r in run(spark, urls, rules).items()} == expected
    assert run(spark, URLS) == {i: plain(x) for i, x in enumerate(URLS)}
