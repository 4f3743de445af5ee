"""Registered queries over the given tables, each with an equivalent SQL text where SQL can say it."""

from strandline.queries import quality, reduction, rows, series, stats, tables  # noqa: F401
from strandline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
