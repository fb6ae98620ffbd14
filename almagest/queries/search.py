"""Searches: pairs, lists and counts of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.cells import PlaneGrid
from almagest.functions.geometry import parse_point_wkt, point_wkt, with_parsed_points
from almagest.functions.s2 import S2Cells
from almagest.operators.match import (
    cell_match,
    cone_match,
    cone_pairs,
    count_matches,
    distinct_positions,
    grouped_match,
    hybrid_match,
    wkt_match,
)
from almagest.plans.experiments import ARCSECONDS, point_set_sweep, radius_sweep
from almagest.plans.layouts import (
    cell_layout,
    geohash_layout,
    hybrid_layout,
    projected_layout,
    write_cells,
    write_geohash,
    write_hybrid,
)
from almagest.queries import sky
from almagest.queries.catalogs import geohash_sql
from almagest.session import work_folder
from almagest.sources.points import read_points_wkt, read_points_xy
from almagest.sources.tables import attach_catalog, read_csv, write_csv

MINUTE = 60 / 3600.0
PAIR = "c.source_id, p.point_id"


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select("source_id", F.col("query_point_id").alias("point_id"))


def _numbers(matches: DataFrame) -> DataFrame:
    """Geometry text of an answer back to numbers."""
    both = with_parsed_points(matches, {"point": "c", "query_point": "p"})
    return both.select(
        F.col("c.lon").alias("lon"),
        F.col("c.lat").alias("lat"),
        F.col("p.lon").alias("query_lon"),
        F.col("p.lat").alias("query_lat"),
    )


NUMBERS = "c.lon, c.lat, p.lon AS query_lon, p.lat AS query_lat"


def cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(cone_pairs(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), MINUTE))


def cone_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(cone_match(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), MINUTE))


def cone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(cone_pairs(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), MINUTE, index=S2Cells(9)))


def cone_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(cone_pairs(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), MINUTE, shape="polygon"))


STEPS = 64


def snapped(df: DataFrame, steps: int = STEPS) -> DataFrame:
    """Positions moved to a dyadic grid, where distances are exact: rims and repeats abound."""
    return df.withColumns({c: F.floor(F.col(c) * steps) / F.lit(float(steps)) for c in ("lon", "lat")})


def snapped_sql(table: str, name: str, steps: int = STEPS) -> str:
    return (
        f"SELECT {name}, floor(lon * {steps}) / {steps}e0 AS lon, floor(lat * {steps}) / {steps}e0 AS lat "
        f"FROM ({sky.positions_sql(table, name)})"
    )


def snapped_search_sql(select: str, where: str, steps: int = STEPS) -> str:
    return f"WITH c AS ({snapped_sql('orders', 'source_id', steps)}), p AS ({snapped_sql('customer', 'point_id', steps)}) SELECT {select} FROM c, p WHERE {where}"


COPIES = 16
# Three steps of the grid: many pairs lie exactly on the rim.
RIM = 3 / STEPS


def cone_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(cone_pairs(snapped(sky.sources(spark, sf_dir)), snapped(sky.points(spark, sf_dir)), RIM, boundary=False))


def cone_rim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with and without the rim, at radii that pairs lie exactly on."""
    layers = snapped(sky.sources(spark, sf_dir)), snapped(sky.points(spark, sf_dir))
    counts = [
        count_matches(*layers, [1 / STEPS, RIM], boundary=b).withColumn("boundary", F.lit(b)) for b in (True, False)
    ]
    return counts[0].unionByName(counts[1])


def cone_rim_sql() -> str:
    near = f"{sky.DX} * {sky.DX} + {sky.DY} * {sky.DY}"
    return " UNION ALL ".join(
        f"SELECT {sky.number(r)} AS radius, {b} AS boundary, (SELECT count(*) FROM ({snapped_search_sql(PAIR, f'{near} {less} {sky.number(r)} * {sky.number(r)}')})) AS matches"
        for r in (1 / STEPS, RIM) for b, less in (("true", "<="), ("false", "<"))
    )


def cone_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for point sets too large to broadcast, with every cell treated as if it were hot."""
    return _ids(
        cone_pairs(
            sky.sources(spark, sf_dir), sky.points(spark, sf_dir), MINUTE, strategy="shuffle", pair_target=2
        )
    )


def cone_own_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sky.points(spark, sf_dir).withColumn("radius", (F.col("point_id") % 60 + 1) / 3600.0)
    return _ids(cone_pairs(sky.sources(spark, sf_dir), points, "radius"))


def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(
        cone_pairs(sky.sources(spark, sf_dir, True), sky.points(spark, sf_dir, True), 1.0, metric="great_circle")
    )


GREAT_CIRCLE = (
    "pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) "
    "* pow(sin(radians(p.lon - c.lon) / 2), 2) <= pow(sin(radians(1e0) / 2), 2)"
)

STRING_COLUMNS = [
    "source_name", "source_id", "sigra", "sigdec", "w1mag", "w1sigm", "w1flg", "w2mag", "w2sigm", "w2flg",
    "pmra", "pmdec", "sigpmra", "sigpmdec", "w1k", "w2k", "w1mlq", "w2mlq",
]


def cone_catalog_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole catalog rows as text. The text of doubles differs between engines: numbers again."""
    catalog = cell_layout(sky.primary(spark, sf_dir))
    matches = cell_match(catalog, sky.points(spark, sf_dir), MINUTE, shape="polygon")
    return with_parsed_points(matches, {"query_point": "p"}).select(
        *STRING_COLUMNS,
        F.col("ra").cast("double").alias("ra"),
        F.col("dec").cast("double").alias("dec"),
        F.col("p.lon").alias("query_lon"),
        F.col("p.lat").alias("query_lat"),
    )


def cone_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "hybrid")
    write_hybrid(hybrid_layout(sky.primary(spark, sf_dir)), path)
    return _numbers(hybrid_match(attach_catalog(spark, path), sky.points(spark, sf_dir), MINUTE))


def cone_cell_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "cells")
    write_cells(cell_layout(sky.primary(spark, sf_dir)), path)
    pairs = cone_pairs(attach_catalog(spark, path), sky.points(spark, sf_dir), MINUTE)
    return pairs.select(
        F.col("source_id").cast("bigint").alias("source_id"), F.col("query_point_id").alias("point_id")
    )


def cone_geohash_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "geohash")
    write_geohash(geohash_layout(sky.primary(spark, sf_dir)), path)
    matches = cone_pairs(attach_catalog(spark, path), sky.points(spark, sf_dir), MINUTE)
    return matches.select(
        F.col("source_id").cast("bigint").alias("source_id"),
        F.col("query_point_id").alias("point_id"),
        F.substring("geohash", 1, 4).alias("geohash4"),
    )


def cone_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = sky.sources(spark, sf_dir).select(
        "source_id", point_wkt(F.col("lon"), F.col("lat")).alias("geom")
    )
    place = parse_point_wkt(F.col("point"))
    found = wkt_match(catalog, sky.points(spark, sf_dir), 0.001)
    return found.select(place["lon"].alias("lon"), place["lat"].alias("lat"))


def _told(layer: DataFrame) -> DataFrame:
    """Sources with the text of their id, made once a source instead of once a place in a list."""
    return layer.withColumn("id", F.col("source_id").cast("string"))


def _listed(groups: DataFrame, *place: str) -> DataFrame:
    ids = F.array_join(F.col("matches")["id"], ",").alias("ids")
    return groups.select("point_id", "part", *place, F.size("matches").cast("bigint").alias("n"), ids)


def listed_sql(height: float, x: str = "lon", y: str = "lat") -> str:
    """Lists per point and part, the part being the square of the plane in which matches lie."""
    h = sky.number(height)
    part = f"CAST(floor(c.{y} / {h}) AS BIGINT) * 4294967296 + CAST(floor(c.{x} / {h}) AS BIGINT)"
    ids = "string_agg(CAST(c.source_id AS VARCHAR), ',' ORDER BY c.source_id) AS ids"
    return f"p.point_id, {part} AS part, count(*) AS n, {ids}"


def cone_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(
        grouped_match(
            _told(sky.sources(spark, sf_dir)),
            sky.points(spark, sf_dir),
            MINUTE,
            center=["point_id"],
            attributes=["source_id", "lon", "lat", "id"],
            list_rows=None,
        )
    )


def cone_grouped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorter lists: parts a third of the radius high."""
    return _listed(
        grouped_match(
            _told(sky.sources(spark, sf_dir)),
            sky.points(spark, sf_dir),
            MINUTE,
            center=["point_id"],
            attributes=["source_id", "id"],
            part_height=MINUTE / 3,
            list_rows=None,
        )
    )


RUN_ROWS = 2


def cone_grouped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of two matches at most: parts cut where sources are many, and runs of what lies on one spot."""
    groups = grouped_match(
        _told(snapped(sky.sources(spark, sf_dir), COPIES)),
        snapped(sky.points(spark, sf_dir), COPIES),
        1 / COPIES,
        center=["point_id"],
        attributes=["source_id", "id"],
        part_height=2 / COPIES,
        list_rows=RUN_ROWS,
    )
    return _listed(groups, "square", "run")


def cone_grouped_runs_sql() -> str:
    h = sky.number(2 / COPIES)
    row, column = (f"CAST(floor({axis} / {h}) AS BIGINT)" for axis in ("lat", "lon"))
    inside = [f"least(greatest(CAST(floor(({axis} / {h} - floor({axis} / {h})) * side) AS BIGINT), 0), side - 1)" for axis in ("lat", "lon")]
    cuts = f"least(CAST(ceil(log2(held / {RUN_ROWS}e0) / 2) AS INTEGER), 12)"
    return (
        f"WITH p AS ({snapped_sql('customer', 'point_id', COPIES)}), "
        f"a AS (SELECT *, {row} * 4294967296 + {column} AS part FROM ({snapped_sql('orders', 'source_id', COPIES)})), "
        f"b AS (SELECT *, count(*) OVER (PARTITION BY part) AS held FROM a), "
        f"s AS (SELECT *, CASE WHEN held > {RUN_ROWS} THEN CAST(pow(2, {cuts}) AS BIGINT) ELSE 1 END AS side FROM b), "
        f"c AS (SELECT *, {inside[0]} * side + {inside[1]} AS square FROM s), "
        f"m AS (SELECT p.point_id, c.part, c.square, c.source_id, (row_number() OVER (PARTITION BY p.point_id, c.part, c.square ORDER BY c.source_id) - 1) // {RUN_ROWS} AS run "
        f"FROM c, p WHERE {sky.disc_sql(1 / COPIES)}) "
        "SELECT point_id, part, square, run, count(*) AS n, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) AS ids FROM m GROUP BY ALL"
    )


def distance_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(cone_pairs(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), 0.006))


def _projected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layers = [projected_layout(f(spark, sf_dir, True)).drop("lon", "lat") for f in (sky.sources, sky.points)]
    return layers[0], layers[1]


METRES = 100_000.0


def distance_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer, circles = _projected(spark, sf_dir)
    return _listed(
        grouped_match(
            _told(layer), circles, METRES, center=["point_id"], attributes=["source_id", "id"], list_rows=None, x="x", y="y"
        )
    )


def distance_mercator_sql() -> str:
    def layer(table: str, name: str) -> str:
        return (
            f"SELECT {name}, 6378137e0 * radians(lon) AS x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y "
            f"FROM ({sky.positions_sql(table, name, True)}) WHERE lat BETWEEN -85.06 AND 85.06"
        )

    return (
        f"WITH c AS ({layer('orders', 'source_id')}), p AS ({layer('customer', 'point_id')}) SELECT {listed_sql(METRES, 'x', 'y')} "
        f"FROM c, p WHERE (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= {METRES} * {METRES} "
        "GROUP BY ALL"
    )


NEAR_METRES = 2_000.0


def distance_projected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in projected metres over a written cell layout, whose cells were made from degrees."""
    path = work_folder(spark, "projected-cells")
    write_cells(cell_layout(sky.primary(spark, sf_dir)), path)
    layer, circles = projected_layout(attach_catalog(spark, path)), projected_layout(sky.points(spark, sf_dir))
    pairs = cone_pairs(layer, circles, NEAR_METRES, x="x", y="y")
    return pairs.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("query_point_id").alias("point_id"))


def projected_sql(select: str, metres: float) -> str:
    def layer(table: str, name: str) -> str:
        return (
            f"SELECT {name}, 6378137e0 * radians(lon) AS x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y "
            f"FROM ({sky.positions_sql(table, name)})"
        )

    near = f"(c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= {metres} * {metres}"
    return f"WITH c AS ({layer('orders', 'source_id')}), p AS ({layer('customer', 'point_id')}) SELECT {select} FROM c, p WHERE {near}"


def match_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer written as packed CSV with header and read back."""
    path = work_folder(spark, "answer-csv")
    write_csv(cone_match(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), MINUTE), path, mode="overwrite", header=True, compression="gzip")
    return _numbers(read_csv(spark, path, {"point": "string", "query_point": "string"}, header=True))


def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_matches(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), [MINUTE], distinct_points=True)
    return counts.select("matches")


def match_count_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions folded onto a coarse grid, so that copies abound, by the shuffle plan with hot cells split."""
    layers = snapped(sky.sources(spark, sf_dir), COPIES), snapped(sky.points(spark, sf_dir), COPIES)
    return count_matches(*layers, [0.25, 0.5], strategy="shuffle", pair_target=5_000)


def match_count_copies_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {sky.number(r)} AS radius, count(*) AS matches FROM ({snapped_search_sql(PAIR, sky.disc_sql(r), COPIES)})" for r in (0.25, 0.5)
    )


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_sweep(sky.sources(spark, sf_dir), sky.points(spark, sf_dir))


def sweep_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius_sweep(sky.sources(spark, sf_dir), sky.points(spark, sf_dir), shape="polygon")


def sweep_sql(predicate) -> str:
    pairs = sky.search_sql(f"{sky.DX} AS dx, {sky.DY} AS dy, {PAIR}", sky.disc_sql(MINUTE))
    inner = predicate.replace(sky.DX, "dx").replace(sky.DY, "dy")
    return (
        f"SELECT a.arcseconds, count(m.source_id) AS matches FROM "
        f"(SELECT CAST(unnest({list(ARCSECONDS)}) AS DOUBLE) AS arcseconds) a LEFT JOIN ({pairs}) m ON {inner} "
        "GROUP BY a.arcseconds"
    )


R = "(a.arcseconds / 3600e0)"
SWEEP_DISC = f"dx * dx + dy * dy <= {R} * {R}"
SWEEP_POLYGON = sky.polygon_sql(0.0).replace(sky.number(0.0), R)

SETS = ("customer", "supplier", "part")


def set_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {table: sky.positions(spark, sf_dir, table, "point_id") for table in SETS}
    # No source lies near this one.
    sets["nowhere"] = sets["supplier"].withColumn("dec", F.col("dec") + 60)
    return point_set_sweep(sky.sources(spark, sf_dir), sets)


def set_sweep_sql() -> str:
    points = " UNION ALL ".join(
        f"SELECT '{table}' AS set_name, lon, lat FROM ({sky.positions_sql(table, 'point_id')})" for table in SETS
    )
    points += f" UNION ALL SELECT 'nowhere' AS set_name, lon, lat + 60e0 AS lat FROM ({sky.positions_sql('supplier', 'point_id')})"
    return (
        f"WITH c AS ({sky.positions_sql('orders', 'source_id')}), p AS ({points}), "
        f"m AS (SELECT p.set_name, {sky.DX} AS dx, {sky.DY} AS dy FROM c, p WHERE {sky.disc_sql(MINUTE)}), "
        f"a AS (SELECT set_name, arcseconds FROM (SELECT DISTINCT set_name FROM p), "
        f"(SELECT CAST(unnest({list(ARCSECONDS)}) AS DOUBLE) AS arcseconds)) "
        "SELECT a.set_name, a.arcseconds, count(m.dx) AS matches FROM a LEFT JOIN m "
        f"ON a.set_name = m.set_name AND {SWEEP_DISC} GROUP BY a.set_name, a.arcseconds"
    )


def wkt_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as WKT lines, read back, and matched with their carried fields."""
    path = work_folder(spark, "wkt-points")
    points = sky.points(spark, sf_dir)
    write_csv(points.select(point_wkt(F.col("lon"), F.col("lat")), "ra", "dec", "point_id"), path, mode="overwrite")
    # Numbers are made of text once a point, not once a pair.
    carried = read_points_wkt(spark, path).withColumn("_c3", F.col("_c3").cast("bigint"))
    pairs = cone_pairs(sky.sources(spark, sf_dir), carried, MINUTE)
    return pairs.select("source_id", F.col("query__c3").alias("point_id"))


def xy_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "xy-points")
    write_csv(sky.points(spark, sf_dir).select("point_id", "lon", "lat"), path, mode="overwrite")
    carried = read_points_xy(spark, path, offset=1).withColumn("_c0", F.col("_c0").cast("bigint"))
    pairs = cone_pairs(sky.sources(spark, sf_dir), carried, MINUTE)
    return pairs.select("source_id", F.col("query__c0").alias("point_id"))


REPEATS = 8


def nearest_grid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search after repeated positions of the point side were merged: the row of the least tag, then key, stays whole."""
    points = snapped(sky.points(spark, sf_dir), REPEATS).select("lon", "lat", (F.col("point_id") % 7).alias("tag"), "point_id")
    pairs = cone_pairs(sky.sources(spark, sf_dir), distinct_positions(points), MINUTE, index=PlaneGrid(0.1))
    return pairs.select("source_id", F.col("query_point_id").alias("point_id"), F.col("query_tag").alias("tag"))


def nearest_grid_sql() -> str:
    return (
        f"WITH c AS ({sky.positions_sql('orders', 'source_id')}), p AS (SELECT * FROM (SELECT *, point_id % 7 AS tag, "
        f"row_number() OVER (PARTITION BY lon, lat ORDER BY point_id % 7, point_id) AS place FROM ({snapped_sql('customer', 'point_id', REPEATS)})) "
        f"WHERE place = 1) SELECT {PAIR}, p.tag FROM c, p WHERE {sky.disc_sql(MINUTE)}"
    )


_disc = sky.search_sql(PAIR, sky.disc_sql(MINUTE))
_typed = sky.catalog_sql()
_strings = ", ".join(f"CAST(c.{c} AS VARCHAR) AS {c}" for c in STRING_COLUMNS)

QUERIES = {
    "cone_match": (cone, _disc),
    "cone_match_text": (cone_text, sky.search_sql(NUMBERS, sky.disc_sql(MINUTE))),
    "cone_match_cells": (cone_cells, _disc),
    "cone_match_polygon": (cone_polygon, sky.search_sql(PAIR, sky.polygon_sql(MINUTE))),
    "cone_match_interior": (cone_interior, snapped_search_sql(PAIR, sky.disc_sql(RIM, "<"))),
    "match_count_rim": (cone_rim, cone_rim_sql()),
    "match_csv": (match_csv, sky.search_sql(NUMBERS, sky.disc_sql(MINUTE))),
    "distance_join_projected_cells": (distance_projected_cells, projected_sql(PAIR, NEAR_METRES)),
    "cone_match_shuffled": (cone_shuffled, _disc),
    "cone_match_distinct_points": (nearest_grid_pairs, nearest_grid_sql()),
    "cone_match_own_radius": (
        cone_own_radius,
        sky.search_sql(PAIR, sky.disc_sql(0.0).replace(sky.number(0.0), "((p.point_id % 60 + 1) / 3600e0)")),
    ),
    "cone_match_catalog_strings": (
        cone_catalog_strings,
        f"WITH c AS (SELECT *, ra - 180e0 AS lon, \"dec\" AS lat FROM ({_typed})), "
        f"p AS ({sky.positions_sql('customer', 'point_id')}) SELECT {_strings}, c.ra, c.\"dec\", "
        f"p.lon AS query_lon, p.lat AS query_lat FROM c, p WHERE {sky.polygon_sql(MINUTE)}",
    ),
    "cone_match_hybrid": (cone_hybrid, sky.search_sql(NUMBERS, sky.disc_sql(MINUTE))),
    "cone_match_cell_layout": (cone_cell_layout, _disc),
    "cone_match_wkt": (cone_wkt, sky.search_sql("c.lon, c.lat", sky.disc_sql(0.001))),
    "cone_match_wkt_file": (wkt_file_match, _disc),
    "cone_match_xy_file": (xy_file_match, _disc),
    "cone_match_grouped": (cone_grouped, sky.search_sql(listed_sql(MINUTE), sky.disc_sql(MINUTE), "GROUP BY ALL")),
    "cone_match_grouped_parts": (cone_grouped_parts, sky.search_sql(listed_sql(MINUTE / 3), sky.disc_sql(MINUTE), "GROUP BY ALL")),
    "cone_match_grouped_runs": (cone_grouped_runs, cone_grouped_runs_sql()),
    "cone_match_geohash_layout": (
        cone_geohash_layout,
        f"WITH c AS ({geohash_sql('source_id, lon, lat, geohash', sky.positions_sql('orders', 'source_id'), 4)}), "
        f"p AS ({sky.positions_sql('customer', 'point_id')}) SELECT {PAIR}, c.geohash AS geohash4 "
        f"FROM c, p WHERE {sky.disc_sql(MINUTE)}",
    ),
    "distance_join_flat": (distance_flat, sky.search_sql(PAIR, sky.disc_sql(0.006))),
    "distance_join_mercator": (distance_mercator, distance_mercator_sql()),
    "great_circle_match": (great_circle, sky.search_sql(PAIR, GREAT_CIRCLE, whole_sky=True)),
    "match_count": (match_count, sky.search_sql("count(*) AS matches", sky.disc_sql(MINUTE))),
    "match_count_copies": (match_count_copies, match_count_copies_sql()),
    "radius_sweep": (sweep, sweep_sql(SWEEP_DISC)),
    "radius_sweep_polygon": (sweep_polygon, sweep_sql(SWEEP_POLYGON)),
    "point_set_sweep": (set_sweep, set_sweep_sql()),
}
