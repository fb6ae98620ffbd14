"""Headline timings: prints one JSON line.

Searches run at each radius over the grid join (five timed runs), the cell layout and the
cell-partitioned layout (two each); other operators are timed once. Each has a warm-up first. Medians
in seconds, of building and running the query with every row produced and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import functions as F

from almagest.functions.cells import PlaneGrid, RadiusClasses
from almagest.functions.s2 import S2Cells
from almagest.operators.match import cone_pairs, count_matches, measure, query_side
from almagest.operators.stats import cover_expansion
from almagest.plans.experiments import ARCSECONDS
from almagest.plans.layouts import cell_layout, hybrid_layout, write_cells, write_hybrid
from almagest.queries import catalogs, search, sky
from almagest.session import build_session, work_folder
from almagest.sources.tables import attach_catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
OPERATORS = [
    "cone_match_polygon", "cone_match_cells", "cone_match_shuffled", "cone_match_wkt", "cone_match_grouped",
    "distance_join_flat", "distance_join_mercator", "great_circle_match", "match_count", "radius_sweep",
    "point_set_sweep", "typed_catalog", "tile_offsets", "tile_text", "geohash_layout", "hybrid_layout", "s2_cells",
    "geohash_density", "cover_expansion", "query_geometry_report", "dedup_sources",
]


def median_seconds(build, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 4)


def candidates(catalog, points, radius: float) -> int:
    """Pairs that meet in a cell, before the test on their coordinates."""
    query, reach = query_side(points, radius, "lon", "lat"), F.lit(radius)
    grid = RadiusClasses(measure(query, reach, "lon", "lat").classes)
    cover = grid.explode_cover(query, reach, "cell", "query_lon", "query_lat")
    return grid.with_cell(catalog, "cell").join(cover, [*grid.keys, "cell"]).count()


def main() -> None:
    spark = build_session(
        "almagest-bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = {**search.QUERIES, **catalogs.QUERIES}
    seconds: dict[str, float] = {}

    hybrid, cells = work_folder(spark, "bench-hybrid"), work_folder(spark, "bench-cells")
    write_hybrid(hybrid_layout(sky.primary(spark, SF_DIR)), hybrid)
    write_cells(cell_layout(sky.primary(spark, SF_DIR)), cells)
    points = sky.points(spark, SF_DIR)
    layouts = {
        "grid": sky.sources(spark, SF_DIR),
        "cells": attach_catalog(spark, cells),
        "hybrid": attach_catalog(spark, hybrid),
    }
    for arcsec in ARCSECONDS:
        for name, catalog in layouts.items():
            seconds[f"{name}_{arcsec}s"] = median_seconds(
                lambda: cone_pairs(catalog, points, arcsec / 3600.0).select("source_id", "query_point_id"),
                5 if name == "grid" else 2,
            )
    for name in OPERATORS:
        seconds[name] = median_seconds(lambda: registered[name][0](spark, SF_DIR), 1)

    radii = [a / 3600.0 for a in ARCSECONDS]
    found = [r["matches"] for r in count_matches(layouts["grid"], points, radii).orderBy("radius").collect()]
    met = {str(a): candidates(layouts["grid"], points, a / 3600.0) for a in ARCSECONDS}
    covers = {
        name: round(cover_expansion(points, radii[-1], index).first()["relative_diff"], 4)
        for name, index in (("grid", PlaneGrid(0.05)), ("s2_9", S2Cells(9)))
    }
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "matches": dict(zip(map(str, ARCSECONDS), found)),
                "candidates": met,
                "cover_rows_per_point_60s": covers,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
