"""Queries of the library on the driver tables."""

from __future__ import annotations

from . import article_queries, page_queries, table_queries, url_queries
from .registry import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL


__all__ = ["article_queries", "oracle_sql", "page_queries", "queries", "table_queries", "url_queries"]
