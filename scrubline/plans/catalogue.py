"""All query modules loaded; their queries and SQL together. The registry itself imports none of them."""

from __future__ import annotations

from scrubline.plans import attack_queries, corpus_queries, detection_queries, diversity_queries, generation_queries, generator_queries, matching_queries, ordered_queries, profile_queries, reid_queries, report_queries, risk_queries, span_queries, text_queries, worldbuilding_queries  # noqa: F401
from scrubline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
