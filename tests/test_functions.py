"""Column functions against plain Python versions of their rules."""

import random
import unicodedata

from pyspark.sql import functions as F

from syllabrook.functions import parsing, text, values


def one(spark, column, **fields):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("x")).first()["x"]


def windows(t, size=500, overlap=100):
    out, i = [], 0
    while t and True:
        out.append(t[i : i + size])
        if i + size >= len(t):
            break
        i += size - overlap
    return out


def packed(t, size=60, overlap=10):
    out, buf = [], ""
    for p in [p.strip() for p in __import__("re").split(r"\n\s*\n", t.strip()) if p.strip()]:
        if len(p) > size:
            out += [buf] if buf else []
            buf = ""
            out += windows(p, size, overlap)
        elif buf and len(buf) + 2 + len(p) > size:
            out.append(buf)
            buf = f"{buf[-overlap:]}\n\n{p}"
        else:
            buf = f"{buf}\n\n{p}" if buf else p
    return out + ([buf] if buf else [])


def test_windows_and_packer_equal_a_fold(spark):
    rnd = random.Random(3)
    texts = ["", "a", "b" * 500, "c" * 501, "d" * 2000] + ["\n\n".join("x" * rnd.randint(1, 90) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.windows(F.col("t")).alias("w"), text.pack_paragraphs(F.col("t"), 60, 10).alias("p")).collect()
    for r in rows:
        assert r["w"] == windows(r["t"])
        assert r["p"] == packed(r["t"])


def test_null_text_has_no_windows(spark):
    r = spark.createDataFrame([(None,)], "t string").select(text.windows(F.col("t")), text.pack_paragraphs(F.col("t")), text.tokens(F.col("t"))).first()
    assert list(r) == [[], [], []]


def test_normalise(spark):
    t = "Itâ€™s <wiki>kept</wiki> <mermaid a='1' caption='A cap'>graph</mermaid>end  \n\n\n\nnext"
    assert one(spark, text.normalise(F.col("t")), t=t) == "It’s kept\nA cap\nend\n\nnext"


def test_captions_are_trimmed(spark):
    cases = ['a<mermaid id="1" caption=" A  cap "\n>x\ny</mermaid>b', "a<mermaid>x</mermaid>b", "a<mermaid/>b", "<callout type='x'>c</callout>", "a <wikipedia> b"]
    assert each(spark, text.strip_tags(F.col("t")), cases) == ["a\nA  cap\nb", "a\nb", "ab", "c", "a <wikipedia> b"]
    assert each(spark, text.tidy(F.col("t")), [" a \t\n \n\t\nb\n", "a\n\nb", "a  b"]) == ["a\n\nb", "a\n\nb", "a  b"]


def test_strip_knows_unicode_blanks(spark):
    assert one(spark, text.strip(F.col("t")), t=" \n a b \t ") == "a b"


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Market, the MARKET and demand-led use of ox") == ["market", "demand", "led"]


def test_nfkc(spark):
    t = "ﬁnd ½ Ⅳ ｗ"
    assert one(spark, text.nfkc_in_python(F.col("t")), t=t) == unicodedata.normalize("NFKC", t)


def test_half_even_percent(spark):
    r = spark.sql("select 5 a, 8 b, 0 z, 3 c").select(values.percent(F.col("a"), F.col("b")), values.percent(F.col("c"), F.col("z"))).first()
    assert list(r) == [62, 0]


def test_clamp(spark):
    assert [one(spark, values.clamp(F.col("t")), t=t) for t in ("150", "-3", "x", "42")] == [100, 0, 0, 42]


def test_prefix_number(spark):
    assert [one(spark, parsing.int_prefix(F.col("t")), t=t) for t in ("1.2", " 7a", "x", "-3")] == [1, 7, 0, -3]


def test_pages_and_objectives(spark):
    assert one(spark, parsing.page_list(F.col("t")), t="111-107, 126,x,107") == [107, 108, 109, 110, 111, 126]
    assert one(spark, parsing.objective_numbers(F.col("t")), t="4–3") == [3, 4]
    assert one(spark, parsing.objective_numbers(F.col("t")), t="1, 2 and 5") == [1, 2, 5]
    specs = ["3-4", "1, 2 and 5", " 4 - 2 ", "1 2 2", "x 5-3.", "1-2-3", ""]
    assert each(spark, parsing.objective_confidence(F.col("t")), specs) == ["high", "medium", "high", "high", "medium", "medium", "medium"]
    assert each(spark, parsing.objective_numbers(F.col("t")), specs) == [[3, 4], [1, 2, 5], [2, 3, 4], [1, 2, 2], [3, 4, 5], [1, 2, 3], []]
    stems = ["ECON-2.10 notes S1 Obj 3", "S3_Obj 4-2 x", "S 2 Markets Obj 1 3", "S2 Obj 1, 3", "plain name", "xS2_Obj1"]
    got = each(spark, parsing.office_name(F.col("t")), stems)
    assert [tuple(r) if r else None for r in got] == [(2, [10], "high"), (3, [2, 3, 4], "high"), (2, [1, 3], "high"), (2, [1, 3], "medium"), None, None]


def each(spark, column, texts):
    """The column's value for every text, in one job."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_safe_file_names(spark):
    got = each(spark, text.safe_filename(F.col("t")), ["../a b.c/My File.PDF", "..", "", None, "a" * 200 + ".pdf", "..hidden", "x..b", "é.Tx t", "._-", "no ext", "a.b"])
    assert got == ["a_b_c_My_File.pdf", "file", "file", "file", "a" * 96 + ".pdf", "hidden", "x.b", "file.tx_t", "file", "no_ext", "a.b"]


def test_past_paper_names(spark):
    names = ["June 2019 p2.pdf", "POB_p2_2022.pdf", "Jan 26 POB.PDF", "econ_Paper 02_may.pdf", "Paper 3 May 1998 75.pdf", "p_3 MayJune 2014.pdf", "econ 2031 x.pdf", "P2", "201412.pdf", "a 31 b 12"]
    assert each(spark, parsing.exam_year(F.col("t")), names) == [2019, 2022, 2026, None, 1975, 2014, None, None, 2014, 1931]
    assert each(spark, parsing.paper_number(F.col("t")), names) == [2, 2, 2, 2, 3, 3, 2, 2, 2, 2]
    assert each(spark, parsing.sitting(F.col("t")), names) == ["June", "", "January", "June", "June", "", "", "", "", ""]
    assert each(spark, parsing.paper_label(F.col("t")), names)[:4] == ["Paper 2 - June 2019", "Paper 2 - 2022", "Paper 2 - January 2026", None]


def test_lists_are_trimmed_of_blanks_only(spark):
    assert one(spark, parsing.bullets(F.col("t")), t="- 10 of 0\n- 0 \n1. 1 of 1 ") == ["10 of 0", "0", "1 of 1"]
    assert one(spark, values.delimited(F.col("t")), t=" 0 | 10,, 2 ") == ["0", "10", "2"]


def test_bullets_and_marks(spark):
    t = "• first point\n- second\n1. third\n- second\n(2 marks) and 3 marks"
    assert one(spark, parsing.bullets(F.col("t")), t=t) == ["first point", "second", "third"]
    assert one(spark, parsing.mark_allocation(F.col("t")), t=t) == 3
    got = each(spark, parsing.question_number(F.col("t")), ["  4. What is", "intro\n 12) b", "see 5. no", "1 (a) x", "x" * 199 + "\n3.", "1234. y", None])
    assert got == ["4", "12", None, "1", None, "1234", None]


def test_verbs(spark):
    assert one(spark, parsing.command_words(F.col("t")), t="Explain and state why; explain") == ["Explain", "State"]
    texts = ["State and evaluate", "Examine the causes", "compare a with b", "describe x", "Solve the equation", "outline y", "nothing here", "understate it", "make a claim"]
    assert each(spark, parsing.skill_type(F.col("t")), texts) == ["Application", "Application", "Application", "Understanding", "Application", "Knowledge", "UNCLASSIFIED", "UNCLASSIFIED", "Understanding"]
    assert each(spark, parsing.command_words(F.col("t")), ["solve and find", "Reuse"]) == [["Solve", "Find"], []]
    verbs = parsing.leading_verb(F.col("t"))
    assert each(spark, verbs, ["1. prepare accounts", "LIST two", "42"]) == ["Prepare", "List", ""]
    assert each(spark, parsing.exam_weight(verbs), ["prepare", "List it", "discuss", ""]) == ["P2", "P1", "Both", "Both"]


def test_statements(spark):
    got = each(spark, text.clean_statement(F.col("t")), ["explain scarcity; and", "infectio us conditios.", "name the blood groups. 5.", "work in base 10.", "sell land and", "a, b and, or;", "2.1 keep the number", None])
    assert got == ["Explain scarcity", "Infectious conditions", "Name the blood groups", "Work in base 10", "Sell land", "A, b", "2.1 keep the number", ""]
    assert one(spark, text.comma_append(F.col("t"), "b"), t="a") == "a,b"
    assert one(spark, text.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    cut = ["pre-\npaid non- communicable", "inter- conversion Photo-\n synthesis", "well-known", "trans- geo- logic", "eco-\nnomic", "hinter- land"]
    assert each(spark, text.dehyphenate(F.col("t")), cut) == ["pre-paid non-communicable", "interconversion Photosynthesis", "well-known", "transgeo-logic", "eco-nomic", "hinter-land"]


def test_json(spark):
    got = each(spark, values.json_list(F.col("t")), ["not json", '["a", "b"]', '"one"', "7", "", None, "[]", "true", '["a", 2]'])
    assert got == [["not json"], ["a", "b"], ["one"], ["7"], [], [], [], ["True"], ["a", "2"]]
    assert one(spark, values.only_word(F.col("t")), t='["Explain"]') == "Explain"
    assert one(spark, values.only_word(F.col("t")), t='["a","b"]') is None


def test_cosine_of_a_zero_vector(spark):
    r = spark.sql("select array(0f, 0f) a, array(3f, 4f) b").select(values.cosine(F.col("a"), F.col("b")), values.l2(F.col("a"), F.col("b"))).first()
    assert list(r) == [0.0, 5.0]
