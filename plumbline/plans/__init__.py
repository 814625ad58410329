"""Registered queries over the driver's tables, with their check SQL."""

from plumbline.plans.registry import ORACLES, QUERIES
from plumbline.plans import (  # noqa: F401  (importing registers the queries)
    appearance_queries,
    check_queries,
    coverage_queries,
    drawing_queries,
    integrity_queries,
    mesh_queries,
    pixel_queries,
    source_queries,
    surface_queries,
)

__all__ = ["ORACLES", "QUERIES"]
