"""All registered queries."""

from adlake.plans import documents, feature_runs, features, loads, page_kinds, statistics, tables  # noqa: F401
from adlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
