"""Importing this module registers every query."""

from fraudloom.plans import analyst_queries, click_queries, detection_queries, model_queries, quality_queries, stream_queries
from fraudloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analyst_queries", "click_queries", "detection_queries", "model_queries", "quality_queries", "stream_queries"]
