"""Queries of the library and the SQL each of them must equal."""

from __future__ import annotations

from . import evaluation_queries, frame_queries, geo_queries, scan_queries, stat_queries, time_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (time_queries, stat_queries, geo_queries, scan_queries, evaluation_queries, frame_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
