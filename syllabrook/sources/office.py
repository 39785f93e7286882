"""Word and PowerPoint files: their text from the zipped XML, as a source, as a table function, and as records.

Files come through Spark's binary source, so they may lie wherever Spark can read; a file is opened in the task that has its row. A
document is one page; a slide is a page, also where it has no text. What cannot be read gives a row that says why.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from syllabrook.sources import records
from syllabrook.sources.files import decoded

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Signs that stand for themselves in a run of a document.
SIGNS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
PAGES = StructType([StructField("page", IntegerType()), StructField("body", StringType()), StructField("error", StringType())])
#: Bytes that a part of a file may have when unpacked, against files made to fill the memory.
LARGEST = 256 << 20
#: The reason of a record for a file that could not be read.
UNREADABLE = "unreadable"


def pages(content: bytes, path: str) -> list[str]:
    """The text of each page of a file; raises for what is no such file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if path.lower().endswith(".docx"):
            return [document(z)]
        if path.lower().endswith((".pptx", ".pptm")):
            return list(slides(z))
    raise ValueError(f"no Word or PowerPoint file: {path.rsplit('/', 1)[-1]}")


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > LARGEST:
        raise ValueError(f"{name} is larger than {LARGEST} bytes")
    return ElementTree.fromstring(z.read(name))


def document(z: zipfile.ZipFile) -> str:
    """Paragraphs of the body (not those of tables) that are not blank, with an empty line between them."""
    body = _xml(z, "word/document.xml").find(f"{W}body")
    texts = [_paragraph(p) for p in (body if body is not None else ()) if p.tag == f"{W}p"]
    return "\n\n".join(t for t in texts if t.strip())


def _paragraph(p: ElementTree.Element) -> str:
    runs = [r for child in p for r in ((child,) if child.tag == f"{W}r" else child.findall(f"{W}r") if child.tag == f"{W}hyperlink" else ())]
    return "".join(SIGNS.get(x.tag, (x.text or "") if x.tag == f"{W}t" else "") for r in runs for x in r)


def slides(z: zipfile.ZipFile) -> Iterator[str]:
    """The text of each slide in the order of the show: its shapes that are not blank, with an empty line between them."""
    links = {r.get("Id"): r.get("Target") for r in _xml(z, "ppt/_rels/presentation.xml.rels")}
    for s in _xml(z, "ppt/presentation.xml").findall(f"{P}sldIdLst/{P}sldId"):
        target = links[s.get(f"{R}id")]
        name = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"ppt/{target}")
        shapes = [_shape(x) for x in _xml(z, name).findall(f"{P}cSld/{P}spTree/{P}sp")]
        yield "\n\n".join(t for t in shapes if t.strip())


def _shape(shape: ElementTree.Element) -> str:
    inner = lambda x: "\v" if x.tag == f"{A}br" else "".join(t.text or "" for t in x.findall(f"{A}t")) if x.tag in (f"{A}r", f"{A}fld") else ""
    return "\n".join("".join(map(inner, p)) for p in shape.findall(f"{P}txBody/{A}p"))


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, body) of the files at a path; where a file cannot be read, page is null and body says why."""
    return decoded(spark, path, pages)


class OfficePages:
    """``office_pages(content, path)`` in SQL: a row for each page, or one with the error."""

    @staticmethod
    def analyze(content: AnalyzeArgument, path: AnalyzeArgument) -> AnalyzeResult:
        for name, arg, kind in (("content", content, "binary"), ("path", path, "string")):
            if arg.isTable or arg.dataType.simpleString() != kind:
                raise ValueError(f"office_pages: {name} has to be a {kind}")
        return AnalyzeResult(PAGES)

    def eval(self, content: bytes, path: str) -> Iterator[tuple]:
        try:
            for n, body in enumerate(pages(bytes(content or b""), path or ""), 1):
                yield n, body, None
        except Exception as e:  # the row says what went wrong
            yield None, None, f"{type(e).__name__}: {e}"


def register(spark: SparkSession) -> None:
    """Makes ``office_pages`` known to the session's SQL."""
    spark.udtf.register("office_pages", F.udtf(OfficePages))


def office_records(files: DataFrame, objectives: DataFrame, prefix: str, least: int = 2) -> DataFrame:
    """Records of office files (path, content): their pages in paragraphs, bound by the file's name or by words; files that cannot be read wait for review."""
    spark = files.sparkSession
    register(spark)
    read = spark.sql("select f.path, p.* from {files} f, lateral office_pages(f.content, f.path) p", files=files)
    good = read.filter("error is null").select("path", "page", "body")
    text = lambda c: F.lit(None).cast(c)
    bad = read.filter("error is not null").select(
        F.col("path").alias("source_file"), F.lit("generic_office").alias("source_family"), F.lit("notes").alias("content_type"), text("int").alias("page"), text("int").alias("chunk_seq"),
        text("string").alias("chunk_text"), F.lit(records.REVIEW).alias("objective_id"), F.lit("review").alias("confidence"), F.concat(F.lit(f"{UNREADABLE}: "), "error").alias("review_reason"),
    )
    return records.office_records(good, objectives, prefix, least=least).unionByName(bad)
