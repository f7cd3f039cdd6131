"""All registered queries, in one import."""

from attestry.plans import (  # noqa: F401  (importing registers the queries)
    balance_queries, ctes, model_queries, register_queries, source_queries, survey_queries,
)
from attestry.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
