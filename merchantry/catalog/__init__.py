"""Registered queries over the shared test tables, each beside the SQL it must agree with."""

from merchantry.catalog import checks, jobs, primitives, sources  # noqa: F401  (registration)
from merchantry.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
