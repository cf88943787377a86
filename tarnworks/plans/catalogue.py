"""All queries of the reference operators and their SQL."""

from __future__ import annotations

from tarnworks.plans import dataflow, logs, state, stores  # noqa: F401 - they register their queries
from tarnworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
