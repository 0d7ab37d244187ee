"""All queries of the pair-matching engine, with their SQL oracles."""

from __future__ import annotations

from .plans import analysis, audits, base, core, evaluation, features, generation, greedy, policies, runs, sampling, selections, statistics, tables, texts  # noqa: F401  (plans register themselves)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
