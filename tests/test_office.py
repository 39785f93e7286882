"""Office files that are made here, read as pages, by SQL and as records."""

import zipfile

import pytest
from pyspark.sql import functions as F

from syllabrook.sources import office

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCUMENT = f"""<w:document {NS}><w:body>
<w:p><w:r><w:t>Explain </w:t><w:t>scarcity</w:t></w:r><w:hyperlink><w:r><w:t> and choice</w:t></w:r></w:hyperlink></w:p>
<w:p><w:r><w:t>   </w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t><w:noBreakHyphen/><w:t>four</w:t></w:r></w:p></w:body></w:document>"""


def shape(*paragraphs):
    return f"<p:sp><p:txBody>{''.join(f'<a:p>{x}</a:p>' for x in paragraphs)}</p:txBody></p:sp>"


def run(text):
    return f"<a:r><a:t>{text}</a:t></a:r>"


def slide(*shapes):
    return f"<p:sld {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"


def made(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("office")
    made(at / "S1_Obj2.docx", {"word/document.xml": DOCUMENT})
    rels = '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="/ppt/slides/slide2.xml"/><Relationship Id="r3" Target="slides/slide3.xml"/></Relationships>'
    shown = f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>'
    made(at / "markets.pptx", {
        "ppt/_rels/presentation.xml.rels": rels, "ppt/presentation.xml": shown,
        "ppt/slides/slide1.xml": slide(shape(run("second "), run("slide") + "<a:br/>" + run("more")), shape(""), "<p:pic/>", shape(run("other shape"))),
        "ppt/slides/slide2.xml": slide(shape(run("how markets and prices clear in markets"))),
        "ppt/slides/slide3.xml": slide(),
    })
    (at / "broken.docx").write_bytes(b"PK not a file")
    made(at / "empty.docx", {"other.xml": "<x/>"})
    return str(at)


def name(path):
    return path.rsplit("/", 1)[1]


WANT = {
    ("S1_Obj2.docx", 1, "Explain scarcity and choice\n\none\ttwo\nthree-four"),
    ("markets.pptx", 1, "how markets and prices clear in markets"),
    ("markets.pptx", 2, "second \nslide\vmore\n\nother shape"),
    ("markets.pptx", 3, ""),
}


def test_pages(spark, folder):
    got = [(name(r["path"]), r["page"], r["body"]) for r in office.office_files(spark, folder).collect()]
    assert {r for r in got if r[1]} == WANT and sorted(r[0] for r in got if not r[1]) == ["broken.docx", "empty.docx"]
    assert {r[0]: r[2].split(":")[0] for r in got if not r[1]} == {"broken.docx": "BadZipFile", "empty.docx": "KeyError"}


def test_pages_in_sql(spark, folder):
    office.register(spark)
    spark.read.format("binaryFile").load(folder).createOrReplaceTempView("office_kb")
    got = spark.sql("select f.path, p.page, p.body, p.error from office_kb f, lateral office_pages(f.content, f.path) p").collect()
    assert {(name(r["path"]), r["page"], r["body"]) for r in got if r["error"] is None} == WANT
    assert sorted(name(r["path"]) for r in got if r["error"]) == ["broken.docx", "empty.docx"]
    none = spark.sql("select p.* from (select cast(null as binary) c) f, lateral office_pages(f.c, 'x.docx') p").collect()
    assert len(none) == 1 and none[0]["error"].startswith("BadZipFile")
    with pytest.raises(Exception, match="has to be a binary"):
        spark.sql("select * from office_pages(1, 'x')").collect()


def test_records(spark, folder):
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    objectives = spark.createDataFrame([("ECON-1.2", "Explain scarcity", None), ("ECON-3.1", "Explain how markets clear by prices", "Markets")], "objective_id string, content_stmt string, title string")
    got = sorted((name(r["source_file"]), r["page"] or 0, r["objective_id"], r["confidence"], (r["review_reason"] or "").split(":")[0]) for r in office.office_records(files, objectives, "ECON").collect())
    assert got == [
        ("S1_Obj2.docx", 1, "ECON-1.2", "high", ""),
        ("broken.docx", 0, "REVIEW", "review", "unreadable"),
        ("empty.docx", 0, "REVIEW", "review", "unreadable"),
        ("markets.pptx", 1, "ECON-3.1", "medium", ""),
        ("markets.pptx", 2, "REVIEW", "review", "no_objective_match_via_keywords"),
    ]
    assert office.office_records(files.filter(F.lit(False)), objectives, "ECON").count() == 0
