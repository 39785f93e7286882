"""Objectives found by number, statement, keywords or a chain of sources, and questions by optional filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabrook.functions.text import strip, tokens
from syllabrook.operators import match
from syllabrook.operators.status import latest

#: Content types from the best to the last (fixed values), and what stands in for all of them.
PRIORITY, SYLLABUS = ("notes", "mark_scheme", "past_paper", "specimen"), "syllabus_only"
#: Content types that questions come from (fixed values); letters of a stem in a list.
QUESTIONS, STEM = ("past_paper", "mark_scheme", "specimen"), 400
#: Letters of a statement that decide in the last pass (fixed value).
PREFIX = 40
#: Flags of a video that is loaded (fixed values).
LOADABLE, REUSED = "OK", "VIDEO_REUSED"


def questions(chunks: DataFrame, documents: DataFrame, points: DataFrame, subject_id: str, paper: str | None = None, year: int | None = None) -> DataFrame:
    """Questions of a subject that can be traced to a page, with their marks; ``paper`` and ``year`` narrow the list where they are given."""
    return question_lists(chunks, documents, points, subject_id, {"": (paper, year)}).drop("filter")


def question_lists(chunks: DataFrame, documents: DataFrame, points: DataFrame, subject_id: str, filters: dict[str, tuple[str | None, int | None]]) -> DataFrame:
    """``questions`` for each of the named filters (paper, year), in one reading: a question has a row for each filter that it passes."""
    c = chunks.filter((F.col("subject_id") == subject_id) & F.col("question_num").isNotNull() & F.col("page").isNotNull() & F.col("chunk_id").ilike("%-stem"))
    passes = {name: (F.col("paper") == paper if paper else F.lit(True)) & (F.col("year") == year if year is not None else F.lit(True)) for name, (paper, year) in filters.items()}
    d = documents.filter(F.col("content_type").isin(*QUESTIONS)).filter(reduce(lambda a, b: a | b, passes.values()))
    # Dealt before they are counted: nearly every question is a group of its own, and a task would hold all of its share of the input.
    marks = points.select(F.col("question_id").alias("chunk_id")).repartition("chunk_id").groupBy("chunk_id").agg(F.count("*").alias("marks_total"))
    # Chunks and marks are as many as the tables hold, so neither is sent whole to the driver or to a task.
    out = c.join(d.select("doc_id", "paper", "year").hint("merge"), "doc_id").join(marks.hint("merge"), "chunk_id", "left")
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in passes.items()]))
    out = out.select(F.col("chunk_id").alias("question_id"), "question_num", "paper", "year", F.substring("chunk_text", 1, STEM).alias("stem"), F.coalesce("marks_total", F.lit(0)).alias("marks_total"), named.alias("filter"))
    return out.withColumn("filter", F.explode("filter"))


def context(objectives: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(objective_id, chunk_text, page, source_file, context_source): the best chunk of each objective, else what the syllabus says about it.

    Chunks have (id, objective_id, chunk_text, page, source_file, content_type).
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.col("content_type")), F.lit(0))
    rank = F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank)
    best = latest(chunks, "objective_id", [rank.asc(), F.asc("id")])
    best = best.select("objective_id", "chunk_text", "page", "source_file", F.col("content_type").alias("context_source"), F.lit(True).alias("__found"))
    o = objectives.join(best, "objective_id", "left").join(sections.select("section_id", F.col("title").alias("__title")), "section_id", "left")
    or_else = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    told = F.concat(
        F.lit("Section: "), F.coalesce("__title", F.lit("(unknown section)")),
        F.lit("\nObjective "), F.coalesce("objective_num", F.lit("")), F.lit(": "), F.coalesce("content_stmt", F.lit("")),
        F.lit("\nSkill type: "), or_else(F.col("skill_type"), "(unspecified)"),
        F.lit("\nCommand words: "), or_else(F.array_join(F.from_json("command_words", "array<string>"), ", "), "(none specified)"),
    )
    pick = lambda c, other: F.when(F.col("__found"), F.col(c)).otherwise(other)
    return o.select("objective_id", pick("chunk_text", told).alias("chunk_text"), pick("page", F.lit(None)).alias("page"), pick("source_file", F.lit("syllabus")).alias("source_file"), pick("context_source", F.lit(SYLLABUS)).alias("context_source"))


def resolved(rows: DataFrame, statement: str, objectives: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Rows with ``objective_id`` and ``tier``: the same statement (0), the same without a tail of ``; and`` (1), the first that begins with the same letters (2).

    Objectives have (objective_id, content_stmt, ordinal); of equal statements the last wins, of equal beginnings the first. An empty statement stays unresolved.
    """
    known = objectives.select("objective_id", F.lower(strip(F.col("content_stmt"))).alias("__stmt"), "ordinal").filter(F.coalesce("__stmt", F.lit("")) != "")
    known = known.groupBy("__stmt").agg(F.max_by("objective_id", "ordinal").alias("__id"), F.min("ordinal").alias("__at"))
    key = F.lower(strip(F.col(statement)))
    r = rows.withColumn("__key", key).withColumn("__short", strip(F.regexp_replace("__key", r"[;,]\s+and\s*$", ""))).withColumn("__head", F.substring("__key", 1, prefix))
    # Statements are as many as the tables hold, so no side of them is ever sent whole to the driver (an aggregate's size is guessed too small).
    exact = known.select("__stmt", "__id").hint("merge")
    r = r.join(exact.withColumnsRenamed({"__stmt": "__key", "__id": "__a"}), "__key", "left")
    r = r.join(exact.withColumnsRenamed({"__stmt": "__short", "__id": "__b"}), "__short", "left")
    # A shorter text than the prefix may be any statement's beginning, so each statement has one row for each length that the rows ask for.
    asked = rows.select(F.length(F.substring(key, 1, prefix)).alias("n")).filter("n > 0").distinct()  # as many as the prefix has letters at most
    begun = known.join(F.broadcast(asked), F.length("__stmt") >= F.col("n"))
    begun = begun.groupBy(F.substring("__stmt", F.lit(1), F.col("n")).alias("__head")).agg(F.min_by("__id", "__at").alias("__c"))
    r = r.join(begun.hint("merge"), "__head", "left")
    tier = F.when(F.col("__a").isNotNull(), 0).when(F.col("__b").isNotNull(), 1).when(F.col("__c").isNotNull(), 2)
    return r.withColumns({"objective_id": F.coalesce("__a", "__b", "__c"), "tier": tier}).drop("__key", "__short", "__head", "__a", "__b", "__c")


def structural_id(prefix: Column, section: Column, number: Column) -> Column:
    return F.concat(prefix, F.lit("-"), section.cast("string"), F.lit("."), number.cast("string"))


def structural(rows: DataFrame, objectives: DataFrame, prefix: Column, section: Column, number: Column) -> DataFrame:
    """Rows with ``objective_id`` as their numbers compose it, null where the syllabus has none such."""
    known = objectives.select("objective_id").distinct().withColumn("__k", F.lit(True))
    r = rows.withColumn("objective_id", structural_id(prefix, section, number)).join(known, "objective_id", "left")
    return r.withColumn("objective_id", F.when(F.col("__k"), F.col("objective_id"))).drop("__k")


def best_objective(texts: DataFrame, key: str, text: str, objectives: DataFrame, prefers: str | None = None, least: int = 2) -> DataFrame:
    """(key, target, score, tier): by preferred objectives, by statement, then by statement with title; a later pass sees only what no earlier one has bound.

    Objectives have (objective_id, content_stmt, title). ``prefers`` names a column that both sides have: a text prefers the objectives
    whose value is its own. All passes are told from one join of words: a word of an objective says whether the statement has it.
    """
    own = tokens(F.col("content_stmt"))
    words = objectives.select("objective_id", *([F.col(prefers).alias("__theirs")] if prefers else []), own.alias("__own"), F.explode(tokens(F.concat_ws(" ", "content_stmt", "title"))).alias("token"))
    words = words.withColumn("stated", F.array_contains("__own", F.col("token"))).drop("__own")
    asked = texts.select(key, *([F.col(prefers).alias("__mine")] if prefers else []), F.explode(tokens(F.col(text))).alias("token"))
    pairs = asked.join(match.small(words), "token")
    liked = F.coalesce(F.col("__mine") == F.col("__theirs"), F.lit(False)) if prefers else F.lit(False)
    scores = pairs.groupBy(key, "objective_id").agg(F.count("*").alias("rich"), F.count_if("stated").alias("plain"), F.max(liked).alias("liked"))
    tiers = F.array(*[F.when(rule, F.struct(F.lit(tier).alias("tier"), (-F.col(score)).alias("score"))) for tier, score, rule in ((0, "rich", F.col("liked") & (F.col("rich") >= least)), (1, "plain", F.col("plain") >= least), (2, "rich", F.col("rich") >= least))])
    first = scores.withColumn("t", F.array_min(F.array_compact(tiers))).filter("t is not null")
    best = first.groupBy(key).agg(F.min(F.struct("t", "objective_id")).alias("b"))
    return best.select(key, F.col("b.objective_id").alias("target"), (-F.col("b.t.score")).alias("score"), F.col("b.t.tier").alias("tier"))


def statements(text: Column, verbs: tuple[str, ...], shortest: int = 12) -> Column:
    """Distinct statements that a verb leads, without number and end sign, in lower case."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    found = F.regexp_extract_all(flat, F.lit(rf"(?i)((?:\b\d+\.\d+\s+)?\b(?:{'|'.join(verbs)})\b[^.;]*[.;])"), F.lit(1))
    bare = F.transform(found, lambda s: F.lower(F.rtrim(F.trim(F.regexp_replace(s, r"^\d+\.\d+\s+", "")), F.lit(".;"))))
    return F.array_distinct(F.filter(bare, lambda s: F.length(s) >= shortest))


def editions(old: DataFrame, new: DataFrame, text: str, verbs: tuple[str, ...]) -> DataFrame:
    """(statement, state): statements of two editions that were added, removed or kept."""
    of = lambda df, name: df.select(F.explode(statements(F.col(text), verbs)).alias("statement")).distinct().withColumn(name, F.lit(True))
    both = of(old, "__o").join(of(new, "__n"), "statement", "full_outer")
    return both.select("statement", F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("kept").alias("state"))


def keyword_hits(text: Column, keywords: tuple[str, ...], within: int = 2000) -> Column:
    """The keywords that the first letters of a text contain."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, within))
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(head, k))


def loadable(flag: Column) -> Column:
    f = F.upper(F.trim(F.coalesce(flag, F.lit(""))))
    return (f == LOADABLE) | f.startswith(REUSED)


def videos(rows: DataFrame, objectives: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of a video list (flag, matched_content_stmt, url) with their outcome: skipped_flag, unresolved, already_present or loaded."""
    r = resolved(rows.withColumn("__ok", loadable(F.col("flag"))), "matched_content_stmt", objectives)
    have = present.select("objective_id", "url").distinct().withColumn("__p", F.lit(True))
    r = r.join(have.hint("merge"), ["objective_id", "url"], "left")
    outcome = F.when(~F.col("__ok"), "skipped_flag").when(F.col("objective_id").isNull(), "unresolved").when(F.col("__p"), "already_present").otherwise("loaded")
    return r.withColumn("outcome", outcome).drop("__ok", "__p")


def on_page(source_page: Column, page: int) -> Column:
    """Rows of a page; null where the row's page is no number."""
    return source_page.try_cast("int") == page
