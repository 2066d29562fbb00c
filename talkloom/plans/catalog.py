"""All registered queries."""

from talkloom.plans import diagnostic_queries, model_queries, pipeline_queries, source_queries  # noqa: F401
from talkloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
