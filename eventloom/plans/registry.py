"""All queries of the core, by name."""

from __future__ import annotations

from eventloom.plans import core_problems, core_sql, reference, study  # noqa: F401  study adds its queries to reference's


def queries() -> dict:
    return dict(core_problems.QUERIES) | reference.QUERIES


def oracles() -> dict[str, str]:
    return dict(core_sql.ORACLES) | reference.ORACLES
