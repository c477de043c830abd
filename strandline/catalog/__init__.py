"""Registered queries: each name carries a Spark plan and, where SQL can say it, an oracle."""

from strandline.catalog.registry import all_oracles, all_queries  # noqa: F401
