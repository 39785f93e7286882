"""Registry of the named queries and of the SQL that checks them."""

from __future__ import annotations

from syllabrook.plans import corpus, grading, grounding, learning, parsed, persisted, registry, reports, rules, states
from syllabrook.streaming import queries as streamed
from syllabrook.streaming import study

__all__ = ["corpus", "grading", "grounding", "learning", "parsed", "persisted", "reports", "rules", "states", "streamed", "study"]


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
