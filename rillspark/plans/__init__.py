"""Named queries with their SQL, by family."""

from __future__ import annotations

from . import basins, flow, geometries, learning, network, relational, repair
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basins", "flow", "geometries", "learning", "network", "relational", "repair"]
