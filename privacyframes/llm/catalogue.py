"""All queries of this subpackage."""

from __future__ import annotations

from . import bpe, centroids, decontaminate, html_text, language_id, lexical_search, licenses, near_dedup, quality, secrets, substring_dedup, suffix_dedup, topk  # noqa: F401
from .registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
