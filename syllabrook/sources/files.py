"""File sources: discovery, dispatch to families, and readers of CSV, JSON, Markdown, text and Office or PDF files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabrook.functions import parsing, text
from syllabrook.functions.values import options_map
from syllabrook.operators.match import small

#: Families by rule, the first that fits (fixed values); the last takes any PDF.
FAMILIES = (
    ("solutions", r"(?i)solution[^/]*\.txt$"),
    ("mcq_bank", r"(?i)mcq[^/]*\.json$"),
    ("front_matter", r"(?i)/generated/[^/]*\.md$"),
    ("notes", r"(?i)\.md$"),
    ("office", r"(?i)\.(docx|pptx|pptm)$"),
    ("pdf", r"(?i)\.pdf$"),
)
#: Content types by folder (fixed values).
FOLDERS = (("past_papers", "past_paper"), ("mark_schemes", "mark_scheme"), ("specimen", "specimen"), ("notes", "notes"))
MIME = (("pdf", "application/pdf"), ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("txt", "text/plain"), ("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"))


def ordered(rules: tuple[tuple[str, str], ...], c: Column, test: Callable[[Column, str], Column], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for key, value in reversed(rules):
        out = F.when(test(c, key), F.lit(value)).otherwise(out)
    return out


def walk(spark: SparkSession, roots: list[str], skip: tuple[str, ...] = (), glob: str = "*") -> DataFrame:
    """(path, length, modified) of all files below the roots, each path once; content is not read.

    ``skip`` are patterns for folder or file names that leave out what lies below.
    """
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(r).select("path", "length", F.col("modificationTime").alias("modified")) for r in roots]
    files = reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])
    for pattern in skip:
        files = files.filter(~F.exists(F.split("path", "/"), lambda p: p.rlike(f"^{pattern}$")))
    return files


def family(path: Column, only: str | None = None, without: tuple[str, ...] = ()) -> Column:
    """The first family whose rule a path fits; ``without`` are opt-in families that are off."""
    rules = tuple((pattern, name) for name, pattern in FAMILIES if name not in without)
    out = ordered(rules, path, lambda c, p: c.rlike(p))
    return F.when(out == only, out) if only else out


def content_type(path: Column) -> Column:
    return ordered(FOLDERS, path, lambda c, f: F.lower(c).contains(f"/{f}/"))


def mime(path: Column) -> Column:
    return ordered(MIME, F.lower(F.element_at(F.split(path, r"\."), -1)), lambda c, e: c == e, "application/octet-stream")



def csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV of texts with a header; a byte-order mark is dropped; rows without the first required column go."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df.filter(F.trim(F.coalesce(F.col(required[0]), F.lit(""))) != "")


def any_of(row: Column, names: tuple[str, ...]) -> Column:
    """The first of several fields of a map that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.trim(row[n]), F.lit("")) for n in names])


def syllabus_json(spark: SparkSession, path: str) -> DataFrame:
    """(section_num, section_title, objective_id, objective_num, content_stmt) from any of four shapes:

    a list of objectives, a list of sections with objectives, or an object with ``sections`` or ``objectives``.
    """
    raw = spark.read.text(path, wholetext=True).select("value")
    item = "array<map<string,string>>"
    body = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.from_json(F.coalesce(F.get_json_object("value", "$.sections"), F.get_json_object("value", "$.objectives")), item))
    rows = raw.select(F.explode(body).alias("r"))
    # A section holds its objectives as JSON text; a bare objective stands for itself.
    inner = F.coalesce(F.from_json(F.col("r")["objectives"], item), F.array(F.col("r")))
    o = rows.select("r", F.explode(inner).alias("o"))
    return o.select(
        any_of(F.col("r"), ("section_num", "number", "num", "section")).alias("section_num"),
        any_of(F.col("r"), ("section_title", "title", "name")).alias("section_title"),
        any_of(F.col("o"), ("objective_id", "id")).alias("objective_id"),
        any_of(F.col("o"), ("objective_num", "number", "num")).alias("objective_num"),
        any_of(F.col("o"), ("content_stmt", "statement", "text", "description")).alias("content_stmt"),
    )


def master_map(main: DataFrame, supplement: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """The map with the complete rows of a supplement."""
    return main.select(*columns).unionByName(supplement.select(*columns).dropna()).dropDuplicates()


def topic_map(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """(topic, subtopic, objective_id, tier) from {topic: {default_objective, subtopic_overrides}}; tier 0 is the closer one."""
    rows = []
    for topic, entry in config.items():
        rows.append((topic, None, entry.get("default_objective"), 1))
        rows += [(topic, s, o, 0) for s, o in (entry.get("subtopic_overrides") or {}).items()]
    return spark.createDataFrame(rows, "topic string, subtopic string, objective_id string, tier int")


def bind_topics(questions: DataFrame, topics: DataFrame, sentinel: str = "UNMAPPED") -> DataFrame:
    """Adds objective_id: that of the subtopic, else of the topic, else the sentinel."""
    close = small(topics.filter("tier = 0").select("topic", "subtopic", F.col("objective_id").alias("__a")))
    wide = small(topics.filter("tier = 1").select("topic", F.col("objective_id").alias("__b")))
    q = questions.join(close, ["topic", "subtopic"], "left").join(wide, "topic", "left")
    return q.withColumn("objective_id", F.coalesce("__a", "__b", F.lit(sentinel))).drop("__a", "__b")


def mcq_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, rejects) of ``{subjectId, questions: [...]}``; rejects have the file and the reason."""
    schema = "subjectId string, questions array<struct<id:string,topic:string,subtopic:string,stem:string,options:map<string,string>,answer:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.from_json("value", schema).alias("j"))
    some = F.coalesce(F.size("j.questions"), F.lit(0)) > 0
    q = raw.filter(some).select("source_file", F.col("j.subjectId").alias("subject_id"), F.posexplode("j.questions").alias("position", "q")).select("source_file", "subject_id", "position", "q.*")
    q = q.withColumns({"options": options_map(F.col("options")), "answer": F.upper(F.trim("answer"))})
    good = q["id"].isNotNull() & F.coalesce(F.map_contains_key("options", F.col("answer")), F.lit(False))
    bad = raw.filter(~some).select("source_file", F.lit("no questions could be read").alias("reason"))
    return q.filter(good), bad.unionByName(q.filter(~good).select("source_file", F.concat(F.lit("no valid answer: "), F.coalesce("id", F.lit("?"))).alias("reason")))


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, objective_id, position, chunk, reason): chunks of Markdown files times the objectives their header lists."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), "value")
    head = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---", 1)
    body = F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*\n?", "")
    listed = F.filter(F.split(F.regexp_replace(F.regexp_extract(head, r"(?m)^objectives:\s*\[([^\]]*)\]", 1), r"[\"']", ""), r"\s*,\s*"), lambda x: x != "")
    f = raw.select("source_file", listed.alias("o"), F.explode_outer(F.transform(text.pack_paragraphs(text.normalise(body)), lambda c, i: F.struct(i.alias("position"), c.alias("chunk")))).alias("c"))
    return f.select("source_file", F.explode_outer("o").alias("objective_id"), "c.position", "c.chunk", F.when(F.size("o") == 0, "no objectives in the header").when(F.col("c").isNull(), "empty").alias("reason"))


def notes(spark: SparkSession, path: str, deferred: tuple[str, ...] = ()) -> DataFrame:
    """(source_file, position, chunk) of Markdown notes in fixed windows; names that start with ``_`` and deferred folders are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), "value")
    raw = raw.filter(~F.element_at(F.split("source_file", "/"), -1).startswith("_"))
    for d in deferred:
        raw = raw.filter(~F.col("source_file").contains(f"/{d}/"))
    return raw.select("source_file", F.posexplode(text.windows(text.normalise(F.col("value")))).alias("position", "chunk"))


def solutions(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, number, question, answer, reason) of text files with ``QUESTION n`` and ``ANSWER:`` lines below a header."""
    from syllabrook.operators import lines as L

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), "value")
    ls = L.lines(raw, ["source_file"], "value")
    ls = L.carry(ls, ["source_file"], "number", F.regexp_extract("line", r"^QUESTION\s+(\d+)", 1).try_cast("int"))
    ls = L.carry(ls, ["source_file", "number"], "part", F.when(F.col("line").rlike(r"^QUESTION\s+\d+"), "question").when(F.col("line").startswith("ANSWER:"), "answer"))
    body = F.regexp_replace("line", r"^(QUESTION\s+\d+[.:]?|ANSWER:)\s*", "")
    parts = ls.filter("number is not null").groupBy("source_file", "number", "part").agg(F.array_sort(F.collect_list(F.struct("n", body.alias("l")))).alias("p"))
    parts = parts.withColumn("t", text.strip(F.array_join(F.transform("p", lambda x: x["l"]), "\n")))
    of = lambda k: F.max(F.when(F.col("part") == k, F.col("t")))
    found = parts.groupBy("source_file", "number").agg(of("question").alias("question"), of("answer").alias("answer"))
    found = found.withColumn("reason", F.when(F.coalesce("answer", F.lit("")) == "", "no answer"))
    none = raw.join(found.select("source_file").distinct(), "source_file", "left_anti").select("source_file", F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit("no header").alias("reason"))
    return found.unionByName(none)


def decoded(spark: SparkSession, path: str, decode: Callable[[bytes, str], list[str]]) -> DataFrame:
    """(path, page, body): pages of the binary documents at a path."""
    return decoded_files(spark.read.format("binaryFile").load(path).select("path", "content"), decode)


def decoded_files(files: DataFrame, decode: Callable[[bytes, str], list[str]]) -> DataFrame:
    """(path, page, body): pages of files (path, content) by a decoder (bytes, path) -> page texts, one file at a time.

    The decoder is the caller's (PDF and OCR libraries are optional); a file that it fails on gives one row with page null
    and the error as body.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for p, content in zip(df["path"], df["content"], strict=True):
                try:
                    pages = decode(bytes(content), p)
                    yield pd.DataFrame({"path": [p] * len(pages), "page": pd.array(range(1, len(pages) + 1), dtype="Int32"), "body": pages})
                except Exception as e:  # the row says what went wrong
                    yield pd.DataFrame({"path": [p], "page": pd.array([None], dtype="Int32"), "body": [f"{type(e).__name__}: {e}"]})

    return files.mapInPandas(run, "path string, page int, body string")


def decode_text(content: bytes, path: str = "") -> list[str]:
    """Plain text as UTF-8, else Latin-1."""
    try:
        return [content.decode("utf-8-sig")]
    except UnicodeDecodeError:
        return [content.decode("latin-1")]


def needs_ocr(pages: DataFrame, key: str, page_least: int = 50, file_least: int = 100) -> DataFrame:
    """Adds ``ocr``: a page with few letters, or any page of a file with few on average."""
    n = F.length(F.trim(F.coalesce("body", F.lit(""))))
    mean = pages.groupBy(key).agg(F.avg(n).alias("__mean"))
    return pages.join(mean, key).withColumn("ocr", (n < page_least) | (F.col("__mean") < file_least)).drop("__mean")


def mean_confidence(words: DataFrame, key: str) -> DataFrame:
    """The whole part of the mean confidence of words; -1 stands for none."""
    return words.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("conf") != -1, F.col("conf"))).cast("int"), F.lit(0)).alias("confidence"))


def ocr_quality(c: Column) -> Column:
    """CLEAN, PARTIAL or POOR from the number of items and the share of letters that OCR leaves behind."""
    items = F.size(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(\d+)[.)]"), F.lit(1)))
    garble = (F.length(c) - F.length(F.translate(c, "~|^}{<>¢¥§", ""))) / F.greatest(F.length(c), F.lit(1))
    return F.when((items >= 45) & (garble < 0.004), "CLEAN").when(items >= 25, "PARTIAL").otherwise("POOR")


def triage(files: DataFrame) -> DataFrame:
    """Files with family, content type, year, sitting, paper and mime type guessed from their path."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"family": family(F.col("path")), "content_type": content_type(F.col("path")), "mime": mime(F.col("path")), "year": parsing.exam_year(name), "paper": parsing.paper_number(name), "sitting": parsing.sitting(name)})


def marked_links(pages: DataFrame, url: str, html: str, allow: tuple[str, ...], block: tuple[str, ...]) -> DataFrame:
    """(url, link, host, state) for every link of a page; relative links get the page's host; block comes before allow."""
    host = lambda c: F.lower(F.regexp_extract(c, r"^[a-z]+://([^/?#:]*)", 1))
    p = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r'<a[^>]+href="([^"]*)"'), F.lit(1))).alias("link"))
    full = F.when(F.col("link").rlike(r"^[a-z]+://"), F.col("link")).otherwise(F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0), F.when(F.col("link").startswith("/"), F.lit("")).otherwise("/"), "link"))
    p = p.withColumn("link", full).withColumn("host", host(F.col("link")))
    under = lambda names: reduce(lambda a, b: a | b, [(F.col("host") == n) | F.col("host").endswith("." + n) for n in names], F.lit(False))
    return p.withColumn("state", F.when(under(block), "blocked").when(under(allow), "allowed").otherwise("unknown"))
