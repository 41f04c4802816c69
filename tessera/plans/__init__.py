"""Registered queries over the driver tables and their SQL counterparts."""

from . import app_queries, layout_queries, locale_queries, registry, relational_queries, row_queries, rule_queries, sampling_queries, score_queries, stat_queries, view_queries  # noqa: F401
