"""Registered queries and their SQL counterparts."""

from workload import catalog, cdc, functions, joins, measures, quality, security, sources, time, transforms  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
