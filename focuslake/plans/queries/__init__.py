"""Registered queries over the given tables, each with the SQL that checks it where SQL can."""

from . import catalog, detections, focus_points, geometry, media, pixels, regions, sidecars
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
