"""All queries of the core and their SQL."""

from __future__ import annotations

from graphlume.plans import analysis, base, collection, preparation, runs  # noqa: F401 - analysis, collection and runs register themselves


def queries() -> dict:
    return base.QUERIES | preparation.QUERIES


def oracles() -> dict[str, str]:
    return base.ORACLES | preparation.ORACLES
