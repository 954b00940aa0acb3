"""All registered queries."""

from __future__ import annotations

from axisframe.plans import (  # noqa: F401
    contract_queries, direction_queries, io_queries, support_queries, vector_queries)
from axisframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
