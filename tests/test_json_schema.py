"""What texts break of a JSON schema."""

import pytest
from pyspark.sql import functions as F

from syllabrook.functions import json_schema

SCHEMA = {
    "type": "object",
    "required": ["a", "b"],
    "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 1, "maximum": 5},
        "b": {"type": "string", "enum": ["x", "y"]},
        "c": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["d"], "properties": {"d": {"type": "number"}, "e": {"type": "array", "items": {"type": "boolean"}}}}},
        "f": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^[a-z]+$"},
    },
}
CASES = [
    ('{"a": 1, "b": "x"}', []),
    ('{"a": 5.0, "b": "y", "c": [{"d": 1.5, "e": [true]}], "f": "abc"}', []),
    ("{}", ["$.a: missing", "$.b: missing"]),
    ('{"a": 0, "b": "z"}', ["$.a: below 1", "$.b: not one of x, y"]),
    ('{"a": 1.5, "b": null}', ["$.a: not an integer", "$.b: not a string"]),
    ('{"a": "1", "b": "x", "z": 1, "y": 2}', ["$.a: not an integer", "$.y: not allowed", "$.z: not allowed"]),
    ('{"a": 6, "b": "x", "c": []}', ["$.a: above 5", "$.c: fewer than 1 items"]),
    ('{"a": 2, "b": "x", "c": [{"d": 1}, {"e": [1, false]}, 7]}', ["$.c: more than 2 items", "$.c[1].d: missing", "$.c[1].e[0]: not a boolean", "$.c[2]: not an object"]),
    ('{"a": 2, "b": "x", "f": "Q"}', ["$.f: does not match ^[a-z]+$", "$.f: shorter than 2"]),
    ('{"a": 2, "b": "x", "f": "abcd", "c": {"d": 1}}', ["$.c: not an array", "$.f: longer than 3"]),
    ("[1]", ["$: not an object"]),
    ("", ["$: no JSON"]),
    ('{"a": ', ["$: no JSON"]),
    (None, ["$: no JSON"]),
]


def test_violations(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: sorted(r["v"]) for r in df.select("i", json_schema.violations(F.col("t"), SCHEMA).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    value = {r["i"]: r["x"] for r in df.select("i", json_schema.fitting(F.col("t"), SCHEMA).alias("x")).collect()}
    assert [i for i, x in value.items() if x is not None] == [0, 1]
    assert value[1]["a"] == 5 and value[1]["c"][0]["e"] == [True]


def test_unknown_rules_are_refused():
    with pytest.raises(ValueError, match=r"\$\.a: unknown keywords oneOf"):
        json_schema.checked({"type": "object", "properties": {"a": {"oneOf": []}}})
    with pytest.raises(ValueError, match="unknown type 'date'"):
        json_schema.checked({"type": "array", "items": {"type": "date"}})
