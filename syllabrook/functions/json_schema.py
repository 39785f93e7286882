"""JSON schemas as expressions: the Spark type of what fits a schema, and all that a text breaks of it.

Texts are parsed to VARIANT once, so a value's own type is known whatever the schema expects. Known keywords: type, enum, properties, required,
additionalProperties (false), items, minItems, maxItems, minimum, maximum, minLength, maxLength, pattern. Others are refused when
the schema is compiled, since a rule that is passed over in silence is worse than none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYWORDS = {"type", "enum", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "minLength", "maxLength", "pattern", "description", "title"}
SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
#: Spark's names of the types of scalars, beside decimals of any size.
KINDS, NUMBERS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}, ("BIGINT", "DOUBLE", "FLOAT")
TYPES = {*KINDS, "object", "array", "number", "integer"}


def checked(schema: dict, at: str = "$") -> None:
    """Raises for what this compiler does not know."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"{at}: unknown keywords {', '.join(sorted(unknown))}")
    kind = schema.get("type")
    if kind is not None and kind not in TYPES:
        raise ValueError(f"{at}: unknown type {kind!r}")
    for name, child in schema.get("properties", {}).items():
        checked(child, f"{at}.{name}")
    if "items" in schema:
        checked(schema["items"], f"{at}[]")


def spark_type(schema: dict) -> T.DataType:
    """The type of what fits a schema."""
    kind = schema.get("type")
    if kind == "object":
        return T.StructType([T.StructField(n, spark_type(s)) for n, s in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {})))
    return SCALARS.get(kind, T.StringType())


def violations(text: Column, schema: dict) -> Column:
    """An array of ``path: what is wrong``, empty where the text fits; a text that is no JSON has one entry, a null text is none."""
    checked(schema)
    broken = lambda v: F.when(v.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_broken(v, schema, F.lit("$")))
    return _let(F.try_parse_json(text), broken)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` looks at it."""
    return F.get(F.transform(F.array(value), f), 0)


def fitting(text: Column, schema: dict) -> Column:
    """The text as a value of the schema's type; null if it breaks any rule."""
    return F.when(F.size(violations(text, schema)) == 0, value(text, schema))


def value(text: Column, schema: dict) -> Column:
    """The text as a value of the schema's type, whatever else it breaks; a number without a fraction is a whole number."""
    return F.try_variant_get(F.try_parse_json(text), "$", spark_type(schema).simpleString())


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _broken(v: Column, schema: dict, at: Column) -> Column:
    """What a value that is there breaks; rules below a wrong type are not looked at.

    Objects and arrays are opened once, which tells their type too; a scalar's type is told once. The type of a whole tree is never
    written out, since that takes as long as the tree is large, at each of its nodes.
    """
    kind = schema.get("type")
    wrong = F.array(F.concat(at, F.lit(f": not {'an' if kind[0] in 'aio' else 'a'} {kind}"))) if kind else _nothing()
    if kind == "object":
        return _let(_members(v), lambda m: F.when(m.isNull(), wrong).otherwise(_all(_own(v, schema, at) + _of_object(m, schema, at))))
    if kind == "array":
        return _let(_items(v), lambda x: F.when(x.isNull(), wrong).otherwise(_all(_own(v, schema, at) + _of_array(x, schema, at))))
    if kind in ("number", "integer"):  # read once as a number: reading a scalar costs more than all else
        whole = (lambda x: x == F.floor(x)) if kind == "integer" else (lambda x: x.isNotNull())
        number = F.when(_number(F.schema_of_variant(v)), F.try_variant_get(v, "$", "double"))
        return _let(number, lambda x: F.when(F.coalesce(whole(x), F.lit(False)), _all(_own(v, schema, at, number=x))).otherwise(wrong))
    if kind:
        return _let(F.schema_of_variant(v), lambda told: F.when(told == KINDS[kind], _all(_own(v, schema, at, told))).otherwise(wrong))
    parts = _own(v, schema, at)
    if {"required", "properties", "additionalProperties"} & set(schema):
        parts.append(_let(_members(v), lambda m: F.when(m.isNull(), _nothing()).otherwise(_all(_of_object(m, schema, at)))))
    if {"minItems", "maxItems", "items"} & set(schema):
        parts.append(_let(_items(v), lambda x: F.when(x.isNull(), _nothing()).otherwise(_all(_of_array(x, schema, at)))))
    return _all(parts)


def _members(v: Column) -> Column:
    """An object's members; null for any other value."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def _items(v: Column) -> Column:
    """An array's items; null for any other value."""
    return F.try_variant_get(v, "$", "array<variant>")


def _all(parts: list[Column]) -> Column:
    if len(parts) < 2:
        return parts[0] if parts else _nothing()
    return F.concat(*parts)


def _number(told: Column) -> Column:
    return told.isin(*NUMBERS) | told.startswith("DECIMAL(")


def _when(rule: Column, at: Column, what: str) -> Column:
    return F.when(F.coalesce(rule, F.lit(False)), F.array(F.concat(at, F.lit(f": {what}")))).otherwise(_nothing())


def _own(v: Column, schema: dict, at: Column, told: Column | None = None, number: Column | None = None) -> list[Column]:
    return [_when(rule, at, what) for rule, what in _own_rules(v, schema, told, number)]


def _own_rules(v: Column, schema: dict, told: Column | None, number: Column | None) -> list[tuple[Column, str]]:
    """Rules of the value itself; ``told`` is its type and ``number`` itself as a number, where they are known."""
    told = F.schema_of_variant(v) if told is None else told
    x = F.when(_number(told), F.try_variant_get(v, "$", "double")) if number is None else number
    s = F.try_variant_get(v, "$", "string")
    rules = []
    if "enum" in schema:
        allowed = [e if isinstance(e, str) else str(e).lower() for e in schema["enum"]]
        rules.append((~F.coalesce(s, F.lit("null")).isin(*allowed), f"not one of {', '.join(allowed)}"))
    for key, test, what in (("minimum", lambda a, b: a < b, "below"), ("maximum", lambda a, b: a > b, "above")):
        if key in schema:
            rules.append((test(x, F.lit(float(schema[key]))), f"{what} {schema[key]}"))
    text = told == KINDS["string"]
    if "minLength" in schema:
        rules.append((text & (F.length(s) < schema["minLength"]), f"shorter than {schema['minLength']}"))
    if "maxLength" in schema:
        rules.append((text & (F.length(s) > schema["maxLength"]), f"longer than {schema['maxLength']}"))
    if "pattern" in schema:
        rules.append((text & ~s.rlike(schema["pattern"]), f"does not match {schema['pattern']}"))
    return rules


def _of_object(members: Column, schema: dict, at: Column) -> list[Column]:
    out, required, known = [], schema.get("required", ()), schema.get("properties", {})
    for n in required:
        if n not in known:
            out.append(_when(~F.map_contains_key(members, F.lit(n)), F.concat(at, F.lit(f".{n}")), "missing"))
    for n, s in known.items():
        path = F.concat(at, F.lit(f".{n}"))
        absent = F.array(F.concat(path, F.lit(": missing"))) if n in required else _nothing()
        out.append(_let(F.try_element_at(members, F.lit(n)), lambda c: F.when(c.isNull(), absent).otherwise(_broken(c, s, path))))  # noqa: B023 - called at once
    if schema.get("additionalProperties") is False:
        others = F.array_sort(F.filter(F.map_keys(members), lambda n: ~n.isin(*known)))
        out.append(F.transform(others, lambda n: F.concat(at, F.lit("."), n, F.lit(": not allowed"))))
    return out


def _of_array(items: Column, schema: dict, at: Column) -> list[Column]:
    out = []
    if "minItems" in schema:
        out.append(_when(F.size(items) < schema["minItems"], at, f"fewer than {schema['minItems']} items"))
    if "maxItems" in schema:
        out.append(_when(F.size(items) > schema["maxItems"], at, f"more than {schema['maxItems']} items"))
    if "items" in schema:
        each = F.transform(items, lambda x, i: _broken(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.coalesce(F.flatten(each), _nothing()))
    return out
