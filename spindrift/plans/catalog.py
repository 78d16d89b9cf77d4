"""The registered queries and their SQL oracles."""

from __future__ import annotations

from spindrift.plans import consolidation, facts, lifecycle, proposals, recall, revisions, search, streams, structure, summary_tree, text, time_expressions, topics  # noqa: F401  (they register their queries)
from spindrift.plans.registry import ORACLES, QUERIES

FLAGSHIP = "rrf_two_leg"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
