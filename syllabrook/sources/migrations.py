"""Migrations of a store: each is applied once, in the same commit as its row in the ledger."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import functions as F

from syllabrook import schemas
from syllabrook.sources.store import Change, Conflict, Store

LEDGER = "schema_migrations"
APPLIED, ALREADY = "applied", "already_applied"
#: What is added to the description of a migration that found all of it done (fixed value).
PRE_EXISTING = " [pre-existing]"
#: Types of migration files.
TYPES = {"TEXT": "STRING", "INTEGER": "BIGINT", "INT": "BIGINT", "REAL": "DOUBLE", "BLOB": "BINARY", "NUMERIC": "DOUBLE"}
CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)$", re.I | re.S)
ADD = re.compile(r"ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(\w+)\s+(\w+)", re.I)
INDEX = re.compile(r"CREATE\s+(?:UNIQUE\s+)?INDEX\b", re.I)
TABLE_RULE = re.compile(r"(PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK|CONSTRAINT)\b", re.I)

#: Makes its writes in a change and says whether there was anything left to do.
Steps = Callable[[Change], bool]


@dataclass(frozen=True)
class Migration:
    version: str
    description: str
    steps: Steps


def bootstrap(store: Store, buckets: int = 16) -> int:
    """Creates the relations of the study model that the store lacks, all in one commit; returns how many."""
    change = store.begin()
    made = sum(change.create(name, r.schema, r.key, buckets) for name, r in schemas.RELATIONS.items())
    if made:
        change.commit("schema")
    return made


def migrate(store: Store, migrations: Iterable[Migration]) -> list[tuple[str, str]]:
    """(version, outcome) of each migration in its order. A migration that fails leaves no trace and stops the run."""
    return [(m.version, _apply(store, m)) for m in migrations]


def _apply(store: Store, m: Migration) -> str:
    while True:
        change = store.begin()
        change.create(LEDGER, schemas.RELATIONS[LEDGER].schema, schemas.RELATIONS[LEDGER].key, 1)
        if change.read(LEDGER).filter(F.col("version") == m.version).limit(1).count():
            return ALREADY
        told = m.description if m.steps(change) else m.description + PRE_EXISTING
        row = store.spark.range(1).select(F.lit(m.version).alias("version"), F.lit(told).alias("description"), F.current_timestamp().alias("applied_at"))
        change.insert(LEDGER, row, [F.asc("version")])
        try:
            change.commit(f"migration {m.version}")
            return APPLIED
        except Conflict:  # another run was first: look at the ledger again
            continue


def from_file(version: str, body: str, description: str = "") -> Migration:
    """A migration file: tables and columns that are there already are no error; indexes mean nothing here."""
    statements = schemas.sql_statements(body)

    def steps(change: Change) -> bool:
        return any([_run(change, s) for s in statements])

    return Migration(version, description or version, steps)


def _run(change: Change, statement: str) -> bool:
    if found := CREATE.match(statement):
        columns, key = _columns(found[2])
        return change.create(found[1], ", ".join(f"{n} {k}" for n, k in columns), key)
    if found := ADD.match(statement):
        return change.add_column(found[1], found[2], TYPES.get(found[3].upper(), found[3]))
    if INDEX.match(statement):
        return False
    raise ValueError(f"a migration creates tables and adds columns; this does neither: {statement[:80]}")


def _columns(body: str) -> tuple[list[tuple[str, str]], tuple[str, ...]]:
    """Names and types of columns, and the key that a column or the table names."""
    columns, key = [], ()
    for part in re.split(r",(?![^(]*\))", body):
        words = part.split()
        if not words:
            continue
        if TABLE_RULE.match(part.strip()):
            named = re.match(r"\s*PRIMARY\s+KEY\s*\(([^)]*)\)", part, re.I)
            key = tuple(c.strip() for c in named[1].split(",")) if named else key
            continue
        kind = words[1].upper() if len(words) > 1 else "TEXT"
        columns.append((words[0], TYPES.get(kind, kind)))
        if re.search(r"\bPRIMARY\s+KEY\b", part, re.I):
            key = (words[0],)
    return columns, key
