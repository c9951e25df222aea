"""Imports every query module, which fills the registry."""

from workload import q_expressions, q_ingest, q_maps, q_movement, q_naming, q_patterns, q_places, q_profile  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
