"""The pipeline's stages on small documents."""

import math
import random
from collections import Counter

import corpus_pipeline
import helpers


def shuffled(docs):
    """The same rows, dealt anew whenever they are read."""

    def run(batches):
        for df in batches:
            yield df.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 30))

    return docs.coalesce(1).mapInPandas(run, docs.schema)


def test_mix_reads_its_keys_once(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(5 + i * 7 % 40)), "en", "ab"[i % 2], 0) for i in range(200)]
    docs = spark.createDataFrame(rows, helpers.DOCS)
    want, got = (Counter(tuple(r) for r in corpus_pipeline.mix(spark, d, "").collect()) for d in (docs, shuffled(docs)))
    assert want and got == want


def test_one_row_of_each_group_of_near_copies_stays(spark, docs):
    got = Counter(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    rows = helpers.rows()
    sets = [helpers.shingles(r[1], corpus_pipeline.SHINGLE_WORDS) for r in rows]
    first = {}
    for r, s, g in zip(rows, sets, helpers.groups(sets, corpus_pipeline.SIMILARITY_PERCENT)):
        key = g if s else (len(first), "no words")
        first[key] = min(first.get(key, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    assert got == Counter(first.values())


def test_near_copies_with_repeated_or_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (None, c), (None, f"{c} more"), (None, f"more {c}"), (None, f"{a} more")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], helpers.DOCS)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["text"].split()[5][0] for r in got) == ["a", "b", "c"]
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]


def kept_of(rows):
    """Plain version of the stages before the mix: (doc_id, what is left of the text)."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = [helpers.shingles(r[1], corpus_pipeline.SHINGLE_WORDS) for r in rows]
    first = {}
    for r, g in zip(rows, helpers.groups(sets, corpus_pipeline.SIMILARITY_PERCENT)):
        first[g] = min(first.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    docs = [(math.inf if r[0] is None else r[0], r[1].encode()) for r in first.values()]
    low, out = {}, []
    for i, b in docs:
        for j in range(len(b) - 49):
            low[b[j : j + 50]] = min(low.get(b[j : j + 50], i), i)
    for i, b in docs:
        gone = {j + k for j in range(len(b) - 49) if low[b[j : j + 50]] < i for k in range(50)}
        out.append((None if i == math.inf else i, bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="replace")))
    return out


def test_run_against_plain_stages(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    from syllabrook.llm.queries import tokenizer_path

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = kept_of(helpers.rows())
    frame = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        frame = corpus_pipeline.stored(f(spark, frame, str(tmp_path)))
        assert frame.columns == docs.columns, name
    assert Counter((r["doc_id"], r["text"]) for r in frame.collect()) == Counter(want)
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] for r in frame.collect())

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = Tokenizer.from_file(tokenizer_path())
    texts = [codec.decode(r["ids"], skip_special_tokens=False) for r in got]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and list(r["ids"]) == codec.encode(t, add_special_tokens=False).ids for r, t in zip(got, texts))
    assert sum(len(helpers.words(t)) for t in texts) == sum(len(helpers.words(t)) for _, t in want)
    whole = {}
    for i, t in want:
        whole.setdefault(i, []).append(t)
    cut = [t for r, t in zip(got, texts) if t not in whole[r["doc_id"]]]
    assert len(cut) <= 1 and all(n <= 3 * len(whole[i]) for i, n in Counter(r["doc_id"] for r in got).items())
