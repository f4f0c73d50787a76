"""Registered queries."""

from . import grid_queries, population_queries, shape_queries, spatial_queries, study_queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "grid_queries", "population_queries", "shape_queries", "spatial_queries", "study_queries"]
