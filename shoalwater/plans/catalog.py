"""Registered queries of the detection engine and their SQL counterparts."""

from __future__ import annotations

from shoalwater.plans import case_queries, evaluation_queries, file_queries, fusion_queries, presentation_queries, report_queries, text_queries, url_queries

_PARTS = (fusion_queries, text_queries, url_queries, evaluation_queries, presentation_queries, case_queries, file_queries, report_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
