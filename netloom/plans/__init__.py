"""Registered queries over the driver's tables."""

from __future__ import annotations

from . import chains, comparison, coordinates, curves, exchange, features, fields, gaps, graphs, grids, joins, paths, refinement, response, rollups, sources, spaces, statistics
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chains", "comparison", "coordinates", "curves", "exchange", "features", "fields", "gaps", "graphs", "grids", "joins", "paths", "refinement", "response", "rollups", "sources", "spaces", "statistics"]
