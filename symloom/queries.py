"""All queries of the reference's operators and their SQL."""

from __future__ import annotations

from symloom.plans import artifact_queries, corpus_queries, history_queries, listing_queries, name_queries, release_queries, search_queries, source_queries, xref_queries  # noqa: F401  (each registers its queries)
from symloom.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
