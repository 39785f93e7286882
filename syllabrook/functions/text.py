"""Text functions as column expressions; none of them leaves the JVM unless its name says so."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no content (fixed values).
STOP_WORDS = (
    "the", "and", "for", "are", "with", "that", "this", "from", "have", "has",
    "was", "were", "will", "shall", "should", "would", "can", "could", "may",
    "its", "their", "his", "her", "they", "them", "you", "your", "our", "out",
    "into", "onto", "over", "under", "such", "than", "then", "when", "what",
    "which", "who", "whom", "how", "why", "where", "all", "any", "each", "both",
    "more", "most", "some", "not", "but", "also", "only", "very", "must",
    "use", "used", "using", "one", "two", "three", "etc", "eg",
)
#: Misread punctuation and what it stands for (fixed values).
MISREAD = tuple((c.encode("utf-8").decode("cp1252"), c) for c in "’‘“–—…") + (("â€", "”"),)
#: Patterns of a text that speaks to its reader as in a chat (fixed values).
CHAT_VOICE = (
    r"\blet me know if\b",
    r"\bfeel free to ask\b(?!\s+(?:the|your|a|an|our|their|his|her|each)\b)",
    r"\bif you (?:need|want|have)\b.{0,20}\b(?:clarification|examples|help)\b",
    r"\bdo you (?:have|need) any questions\b",
    r"\bI hope this helps\b",
    r"\bI'm happy to\b",
)
WINDOW, OVERLAP = 500, 100


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's too (trim knows the space only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def replace_all(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def fix_misread(c: Column) -> Column:
    return replace_all(c, MISREAD)


def _element(name: str, attributes: str = "") -> str:
    """A pattern of an element with its content; ``attributes`` must be among those of its start."""
    return rf"(?is)<{name}\b(?=[^>]*{attributes})[^>]*>(?:(?!</{name}>).)*</{name}>"


def strip_tags(c: Column) -> Column:
    """A diagram leaves its trimmed caption on a line of its own, if it has one; tags of links and callouts leave their content."""
    for quote in "'\"":
        captioned = _element("mermaid", rf"\bcaption\s*=\s*{quote}\s*([^{quote}>]*?)\s*{quote}")
        c = F.regexp_replace(c, captioned, "\n$1\n")
    c = F.regexp_replace(c, _element("mermaid"), "\n")
    return F.regexp_replace(c, r"(?i)</?(mermaid|wiki|callout)\b[^>]*>", "")


def tidy(c: Column) -> Column:
    """Lines without blanks at their end, one empty line at most between others, nothing around the whole."""
    lines = F.transform(F.split(c, "\n"), lambda line: F.rtrim(line, F.lit(" \t")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def normalise(c: Column) -> Column:
    return F.coalesce(tidy(strip_tags(fix_misread(c))), F.lit(""))


#: Texts that are held as Python's at a time.
TEXTS = 256


def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in batches:
        parts = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in a.slice(i, TEXTS).to_pylist()], a.type) for i in range(0, len(a), TEXTS)]
        yield pa.concat_arrays(parts) if parts else a


def nfkc_in_python(c: Column) -> Column:
    """Unicode's compatibility form, for which Spark has no function; texts of ASCII alone are in it and do not leave the JVM."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, c).otherwise(F.arrow_udf(_nfkc, T.StringType())(F.when(~plain, c)))


def windows(c: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Overlapping windows; the last ends with the text. Empty for an empty or null text."""
    n, step = F.length(c), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def pack_paragraphs(c: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed into pieces of up to ``size``; each piece starts with the tail of the one before; longer paragraphs are cut in windows."""
    paragraphs = F.filter(F.transform(F.split(strip(c), r"\n\s*\n"), strip), lambda p: p != "")
    none = F.array().cast("array<string>")

    def step(state: Column, p: Column) -> Column:
        buf, done = state["buf"], state["done"]
        flushed = F.when(buf != "", F.concat(done, F.array(buf))).otherwise(done)
        full = (buf != "") & (F.length(buf) + 2 + F.length(p) > size)
        joined = F.when(buf == "", p).otherwise(F.concat(buf, F.lit("\n\n"), p))
        carried = F.concat(F.substring(buf, -overlap, overlap), F.lit("\n\n"), p) if overlap else p
        carried = F.when(F.length(buf) <= overlap, F.concat(buf, F.lit("\n\n"), p)).otherwise(carried)
        long = F.length(p) > size
        return F.struct(
            F.when(long, F.concat(flushed, windows(p, size, overlap))).when(full, flushed).otherwise(done).alias("done"),
            F.when(long, F.lit("")).when(full, carried).otherwise(joined).alias("buf"),
        )

    end = lambda s: F.when(s["buf"] != "", F.concat(s["done"], F.array(s["buf"]))).otherwise(s["done"])
    return F.coalesce(F.aggregate(paragraphs, F.struct(none.alias("done"), F.lit("").alias("buf")), step, end), none)


def slices(c: Column, size: int, most: int) -> Column:
    """A long text in slices of ``size``, up to ``most`` letters of it."""
    t = F.substring(c, 1, most)
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), ((F.length(t) - 1) / size).cast("int")), lambda i: F.substring(t, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def preview(c: Column, most: int = 500_000, marker: str = "\n[Truncated: see chunks]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words of a to z with more than two letters, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def match_text(statement: Column, title: Column) -> Column:
    """A statement with the title of its section."""
    return F.trim(F.concat_ws(" ", strip(statement), F.nullif(strip(title), F.lit(""))))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def safe_filename(c: Column, most: int = 100) -> Column:
    """Letters, digits, dash and underscore before one lower-case extension; nothing but the tail of a long name survives."""
    raw = F.regexp_replace(F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("file")), r"[\\/]", "_")
    ext = F.lower(F.regexp_extract(raw, r"(?s)^\.*[^.].*(\.[^.]+)$", 1))
    stem = F.regexp_replace(F.substring(raw, 1, F.length(raw) - F.length(ext)), r"[^a-zA-Z0-9_-]", "_")
    stem = F.coalesce(F.nullif(F.regexp_replace(stem, r"^[_-]+|[_-]+$", ""), F.lit("")), F.lit("file"))
    return F.right(F.concat(stem, F.regexp_replace(ext, r"[^a-z0-9._-]", "_")), F.lit(most))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def comma_append(c: Column, item: str) -> Column:
    """``item`` after what is there, if anything."""
    return F.concat(F.coalesce(F.concat(c, F.lit(",")), F.lit("")), F.lit(item))


def strip_fence(c: Column) -> Column:
    """The outermost JSON object or list of a model's answer, without code fences."""
    c = F.regexp_replace(c, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")), c)


def chat_voice(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(f"(?i){p}") for p in CHAT_VOICE])



#: Beginnings of words that a line's end cuts and that are written as one (fixed values).
SOLID = ("inter", "intra", "multi", "photo", "electro", "thermo", "hydro", "micro", "macro", "bio", "geo", "trans", "over", "under")
#: Words that were split, and misspelled ones, with what they stand for (fixed values).
REJOINED, MISSPELLED = (("infectio us", "infectious"),), (("conditios", "conditions"),)


def dehyphenate(c: Column, solid: tuple[str, ...] = SOLID) -> Column:
    """Words cut at a line's end lose the white space after their hyphen, and the hyphen too after a beginning that is written solid."""
    c = F.regexp_replace(c, rf"(?<![A-Za-z])((?i:{'|'.join(solid)}))-\s+([a-z])", "$1$2")
    return F.regexp_replace(c, r"([A-Za-z])-\s+([a-z])", "$1-$2")


def clean_statement(c: Column, known: tuple[tuple[str, str], ...] = REJOINED + MISSPELLED) -> Column:
    """Known faults corrected, without a number that leaked in after the last sentence and a tail of ``;``, ``and`` or ``or``; the first letter is a capital."""
    c = strip(F.coalesce(c, F.lit("")))
    for bad, good in known:
        c = F.regexp_replace(c, rf"(?i)\b{bad}\b", good)
    c = F.regexp_replace(strip(F.regexp_replace(c, r"\.\s+\d{1,2}\.?\s*$", ".")), r"(?i)(?:[;.,\s]|\b(?:and|or)\b)+$", "")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, F.length(c)))
