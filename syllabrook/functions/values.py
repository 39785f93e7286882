"""Numbers, identities, JSON and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, BOXES = 70, (1, 2, 4, 7, 15)


def percent(part: Column, whole: Column) -> Column:
    """Half-even percentage; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.bround(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 0).cast("int"))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(0))))


def review_date(day: Column, box: Column) -> Column:
    return F.date_add(day, F.element_at(F.array(*[F.lit(d) for d in BOXES]), box))


def short_id(prefix: Column | str, *parts: Column, n: int = 12, kind: str = "sha256") -> Column:
    """``prefix-`` and the first n digits of a digest of the parts."""
    body = F.concat_ws("|", *[p.cast("string") for p in parts])
    digest = F.sha1(body) if kind == "sha1" else F.sha2(body, 256)
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("-"), F.substring(digest, 1, n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(0.0))


def json_list(c: Column) -> Column:
    """A JSON list as texts; a JSON scalar, and what is no JSON, is a list of one, and null or an empty text an empty one."""
    t = F.trim(c)
    scalar = F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
    one = F.when(t.rlike(r'(?s)^".*"$'), scalar).when(t.isin("true", "false", "null"), F.element_at(F.create_map(*[F.lit(x) for x in ("true", "True", "false", "False", "null", "None")]), t))
    listed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(F.coalesce(one, c))))


def only_word(c: Column) -> Column:
    """The element of a JSON list of one, else null."""
    return F.when(F.json_array_length(c) == 1, F.get_json_object(c, "$[0]"))


def options_map(m: Column) -> Column:
    """Keys of an options map trimmed and in capitals."""
    return F.transform_keys(m, lambda k, v: F.upper(F.trim(k)))


def keep_valid(items: Column, valid: Column, most: int = 15) -> Column:
    """Items {id, confidence} whose id is valid, with the confidence within 0 and 100, the first ``most``."""
    good = F.filter(items, lambda x: F.array_contains(valid, x["id"]))
    return F.slice(F.transform(good, lambda x: F.struct(x["id"].alias("id"), F.greatest(F.lit(0), F.least(F.lit(100), x["confidence"])).alias("confidence"))), 1, most)


def step(items: Column, at: Column) -> Column:
    """The element at a 1-based step, null outside of the list."""
    return F.when(at >= 1, F.try_element_at(items, F.greatest(at, F.lit(1))))


def render_dpi(width_in: Column, height_in: Column, most: int, dpi: int = 300) -> Column:
    """A resolution reduced so that the page stays below ``most`` pixels."""
    pixels = width_in * height_in * dpi * dpi
    return F.when(pixels > most, F.floor(F.lit(dpi) * F.sqrt(F.lit(float(most)) / pixels))).otherwise(F.lit(dpi)).cast("int")


def stamp(at: Column) -> Column:
    """A time as text that sorts as the time does."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times, null if either is."""
    return F.unix_millis(end) - F.unix_millis(start)


def salted_hash(key: Column, at: Column, body: Column) -> Column:
    """A digest that differs for equal texts saved at different times."""
    return F.sha2(F.concat_ws("|", key.cast("string"), stamp(at), body), 256)


def seeded(key: Column, seed: str) -> Column:
    """What to order by for a shuffle that is the same in every run with this seed."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def delimited(c: Column) -> Column:
    """Items between bars or commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,]"), lambda x: F.trim(x)), lambda x: x != "")


#: GiB of memory below which a model does not run, runs slowly, or runs beside little else (fixed values).
MEMORY = ((1.0, "too little"), (2.0, "tight"), (3.5, "enough"))


def memory_band(size: Column) -> Column:
    """The band of a number of bytes."""
    gib = size.cast("double") / (1 << 30)
    out = F.lit("plenty")
    for least, name in reversed(MEMORY):
        out = F.when(gib < least, F.lit(name)).otherwise(out)
    return out


def parsed_json(c: Column, schema: str) -> Column:
    """JSON text as a value of this schema; null if the text is no JSON or does not fit."""
    j = F.from_json(F.concat(F.lit('{"value":'), c, F.lit("}")), f"struct<value:{schema},__bad:string>", {"columnNameOfCorruptRecord": "__bad"})
    return F.when(j["__bad"].isNull(), j["value"])


def request_error(value: Column, rules: list[tuple[Column, str]]) -> Column:
    """Why a parsed request is refused: it could not be read, else the first rule that it breaks; null if it is valid."""
    return F.when(value.isNull(), F.lit("not readable")).otherwise(F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules], F.lit(None).cast("string")))


def only_keys(schema: dict, allowed: tuple[str, ...]) -> dict:
    """A JSON schema with these keywords alone, at every depth; names of properties are no keywords."""

    def keep(node: object, names: bool) -> object:
        if isinstance(node, list):
            return [keep(x, False) for x in node]
        if not isinstance(node, dict):
            return node
        return {k: keep(v, not names and k == "properties") for k, v in node.items() if names or k in allowed}

    return keep(schema, False)
