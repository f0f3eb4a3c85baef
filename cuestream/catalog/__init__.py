"""Queries over the driver's tables, one per operator, with their SQL oracles."""

from cuestream.catalog.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
