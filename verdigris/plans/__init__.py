"""Registered queries over the driver's tables, with equivalent SQL."""

from . import curating, evaluating, joining, reading, scoring
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curating", "evaluating", "joining", "reading", "scoring"]
