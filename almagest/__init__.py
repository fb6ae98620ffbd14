"""Positional matching of large sky catalogs on Spark.

Frames in, frames out: read tiles, correct them, write a layout, and search cones around points.
"""

from almagest.functions.cells import PlaneGrid, SphereGrid
from almagest.functions.coords import radius_degrees, with_lon_lat
from almagest.functions.s2 import S2Cells
from almagest.operators.calibrate import apply_offsets, dropped_tiles, union_all, union_tiles
from almagest.operators.match import (
    cell_match,
    cone_match,
    cone_pairs,
    count_matches,
    grouped_match,
    hybrid_match,
    wkt_match,
)
from almagest.operators.stats import cover_expansion, geometry_report
from almagest.plans.experiments import point_set_sweep, radius_sweep, random_points
from almagest.session import build_session
from almagest.sources.points import points_from_rows
from almagest.sources.tables import attach_catalog
from almagest.sources.tiles import read_catalog_tiles, read_offset_tiles, read_tiles

__all__ = [
    "PlaneGrid",
    "S2Cells",
    "SphereGrid",
    "apply_offsets",
    "attach_catalog",
    "build_session",
    "cell_match",
    "cone_match",
    "cone_pairs",
    "count_matches",
    "cover_expansion",
    "dropped_tiles",
    "geometry_report",
    "grouped_match",
    "hybrid_match",
    "point_set_sweep",
    "points_from_rows",
    "radius_degrees",
    "radius_sweep",
    "random_points",
    "read_catalog_tiles",
    "read_offset_tiles",
    "read_tiles",
    "union_all",
    "union_tiles",
    "with_lon_lat",
    "wkt_match",
]
