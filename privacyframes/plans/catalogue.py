"""All registered queries."""

from __future__ import annotations

from . import detection_queries, governance_queries, risk_queries, sanitize_queries  # noqa: F401
from .registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
