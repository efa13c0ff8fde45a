"""The registered queries of the catalogue operators, and their SQL."""

from __future__ import annotations

from tidewright.plans import curation, discovery, ledgers, reading, rollups, scalars, selecting  # noqa: F401
from tidewright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
