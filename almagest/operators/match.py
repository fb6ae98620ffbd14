"""Cone search: every catalog source within a radius of each query point.

All searches here are one plan. The catalog gets a cell per row, the points a row per cell their
circle may touch, the two meet in an equi-join on the cell, and an exact test on the coordinates
decides. The plan has no cross join, and each pair comes out once.

The point side is measured first (rows, bytes, extent: one aggregate row). When its cover is small
it is broadcast, the catalog is then not shuffled at all, and the points' extent and cells go to the
scan as filters. When it is not, catalog rows in cells that no circle touches are left out first, and
both sides are shuffled on the cell with hot cells split.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.functions import geometry as geo
from almagest.functions.cells import FINEST, HALVED_AT, PlaneGrid, RadiusClasses, Within, halvings, least_class, padded, radius_class
from almagest.functions.coords import haversine_limit, haversine_square
from almagest.operators.occurring import KEY_BYTES, with_occurring_keys
from almagest.operators.ranges import in_ranges, overlaps_ranges, touched_ranges
from almagest.operators.skew import (
    BROADCAST_BYTES,
    MOST_PARTITIONS,
    PAIR_TARGET,
    PLACE,
    bucket_counts,
    hot_of,
    join_partitions,
    salted_join,
    total_bytes,
    with_place,
)
from almagest.schema import CATALOG_COLUMNS, as_strings

QUERY = "query_"
# Circles from which on it pays to look how densely the catalog lies.
MANY_CIRCLES = 4096
# Cells of circles that one task lists, roughly.
COVER_ROWS = 1_000_000


@dataclass(frozen=True)
class Profile:
    """Measured facts about the point side."""

    rows: int
    size: int
    radius: float
    classes: tuple[int, ...]
    x: tuple[float | None, float | None]
    y: tuple[float | None, float | None]


def query_side(points: DataFrame, radius: float | str, x: str, y: str) -> DataFrame:
    """Points with a position and a radius that is a number and not negative, every column renamed ``query_*`` so that it cannot clash."""
    # NaN counts as greater than every number, so it must be named.
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    placed = points.where(number(x) & number(y))
    if isinstance(radius, str):
        placed = placed.where(number(radius) & (F.col(radius) >= 0))
    return placed.select(*[F.col(f"`{c}`").alias(QUERY + c) for c in points.columns])


def measure(query: DataFrame, radius: Column, x: str, y: str) -> Profile:
    """One aggregate row: the point side's size, extent and radii, which fall into few classes (powers of two)."""
    row = query.agg(
        F.count(F.lit(1)).alias("rows"),
        total_bytes(query).alias("size"),
        F.coalesce(F.max(radius), F.lit(0.0)).alias("radius"),
        F.collect_set(F.when(radius < math.inf, radius_class(radius))).alias("classes"),
        *[f(QUERY + axis).alias(f"{f.__name__}_{n}") for n, axis in enumerate((x, y)) for f in (F.min, F.max)],
    ).first()
    if not math.isfinite(row["radius"]):
        raise ValueError("a radius in the column has no bound; 180 degrees hold the whole sky")
    extents = (row["min_0"], row["max_0"]), (row["min_1"], row["max_1"])
    least = least_class(max((abs(v) for pair in extents for v in pair if v is not None), default=0.0))
    classes = {max(k, least) for k in row["classes"]} or {least}
    return Profile(row["rows"], row["size"], float(row["radius"]), tuple(sorted(classes)), *extents)


def cell_facts(catalog: DataFrame, x: str = "lon", y: str = "lat") -> dict:
    """What a layout noted with its ``cell_id``, if its cells were made from ``x`` and ``y``: S2 levels, whether ids are stored."""
    facts = catalog.schema["cell_id"].metadata if "cell_id" in catalog.columns else {}
    return facts if (facts.get("x", "lon"), facts.get("y", "lat")) == (x, y) else {}


def _measure(metric: str, shape: str, x: str, y: str):
    """Quantity that grows with the radius a pair needs, and its value at a given radius."""
    if metric == "great_circle":
        if shape != "disc":
            raise ValueError("the polygon shape is defined in the plane only")
        return haversine_square(F.col(x), F.col(y), F.col(QUERY + x), F.col(QUERY + y)), haversine_limit
    if metric != "planar":
        raise ValueError(f"unknown metric {metric!r}")
    dx, dy = F.col(x) - F.col(QUERY + x), F.col(y) - F.col(QUERY + y)
    if shape == "polygon":
        return geo.polygon_measure(dx, dy), geo.polygon_limit
    return geo.disc_measure(dx, dy), geo.disc_limit


def _within(metric: str, shape: str, boundary: bool, radius: Column, x: str, y: str) -> Column:
    got, limit = _measure(metric, shape, x, y)
    test = got <= limit(radius) if boundary else got < limit(radius)
    if shape != "polygon":
        return test
    # Two circle tests come first, as they need no trigonometry: the polygon lies between them, and nearly all pairs do not.
    inside = geo.well_inside(F.col(x) - F.col(QUERY + x), F.col(y) - F.col(QUERY + y), radius)
    return _within(metric, "disc", True, radius, x, y) & (inside | test)


def cone_pairs(
    catalog: DataFrame,
    points: DataFrame,
    radius: float | str,
    *,
    shape: str = "disc",
    boundary: bool = True,
    metric: str = "planar",
    index=None,
    x: str = "lon",
    y: str = "lat",
    strategy: str = "auto",
    pair_target: int = PAIR_TARGET,
    weight: str | None = None,
) -> DataFrame:
    """Matching pairs: the catalog's columns, then the points' columns as ``query_*``.

    ``radius`` is a number or the name of a column of ``points``, in the units of ``x`` and ``y``.
    ``shape='polygon'`` tests the inscribed 32-gon, ``boundary=False`` leaves out its rim.
    ``metric='great_circle'`` measures on the sphere, with the wrap at 0/360 and the poles.
    Points whose radius is null, negative or NaN match nothing; a negative number is an error, and so is a radius without bound.
    ``index`` defaults to grids whose cells follow from the radii, one per class of radii that occurs. Stored
    S2 cells prune the scan and, in the cell-partitioned layout, the folders, for any number of points; the join is on the grid.
    ``strategy='auto'`` broadcasts the point side when it measures small, ``'shuffle'`` always deals both sides.
    ``weight`` names a catalog column that counts copies; copies are then merged before a shuffle.
    """
    if not isinstance(radius, str) and not (math.isfinite(radius) and radius >= 0):
        raise ValueError("radius must be a finite number and not negative")
    query = query_side(points, radius, x, y)
    reach = F.col(QUERY + radius) if isinstance(radius, str) else F.lit(float(radius))
    profile = measure(query, reach, x, y)
    widest = profile.radius if isinstance(radius, str) else float(radius)
    if strategy not in ("auto", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")

    facts = cell_facts(catalog, x, y)
    placed = catalog.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = _scan_filters(placed, query, reach, profile, widest, metric, facts, x, y)
    index = _fitted(index, placed, profile, metric, x, y)
    keys = [*getattr(index, "keys", ()), "__cell"]
    located = index.with_cell(placed, "__cell", x, y)
    cover = lambda circles: index.explode_cover(circles, reach, "__cell", QUERY + x, QUERY + y)

    if strategy == "auto" and profile.size * index.cover_bound(widest) <= BROADCAST_BYTES:
        joined = located.join(F.broadcast(cover(query)), keys)
    else:
        # A short file is few tasks', however many cells its circles have.
        tasks = min(MOST_PARTITIONS, math.ceil(profile.rows * index.cover_bound(widest) / COVER_ROWS))
        dealt = query.repartition(tasks, *query.columns) if tasks > 1 else query
        joined = _shuffled(located, cover(dealt), keys, weight, pair_target)
    return joined.where(_within(metric, shape, boundary, reach, x, y)).select(
        *[F.col(f"`{c}`") for c in catalog.columns], *query.columns
    )


def _fitted(index, placed: DataFrame, profile: Profile, metric: str, x: str, y: str):
    """The index, its cells made finer where many circles meet a catalog that lies densely: else most rows they meet are outside.

    The catalog is measured in one aggregate row: rows and, roughly, cells that hold them.
    """
    grids = RadiusClasses(profile.classes, metric)
    if profile.rows < MANY_CIRCLES:
        return index or grids
    held = lambda cells: F.approx_count_distinct(F.xxhash64(*getattr(cells, "keys", ()), "__cell"))

    def density(cells) -> float:
        row = cells.with_cell(placed, "__cell", x, y).agg(F.count(F.lit(1)).alias("rows"), held(cells).alias("cells")).first()
        return row["rows"] / max(row["cells"], 1)

    if index is not None and density(index) < HALVED_AT[0]:
        return index
    times = halvings(density(grids))
    finer = RadiusClasses(profile.classes, metric, times)
    return finer if index is None else Within(index, finer) if times else index


def _shuffled(located: DataFrame, cover: DataFrame, keys: list[str], weight: str | None, pair_target: int) -> DataFrame:
    """Both sides dealt by cell, the catalog's rows only where a circle may touch their cell.

    Copies that ``weight`` counts merge on the way, in the shuffle that the join needs anyway.
    """
    placed, located = located, with_occurring_keys(located, cover, keys)
    counts = bucket_counts(located, cover, keys)
    hot, partitions = hot_of(counts, pair_target), join_partitions(counts)
    if hot and not weight:
        located = with_occurring_keys(with_place(placed), cover, keys)
    if weight:
        rest = [c for c in located.columns if c != weight and c not in keys]
        count = [partitions] if partitions else []
        dealt = located if hot else located.repartition(*count, *keys)
        located = dealt.groupBy(*keys, *rest).agg(F.sum(weight).alias(weight))
        if not hot:
            return located.join((cover.repartition(*count, *keys) if count else cover).hint("merge"), keys)
    return salted_join(located, cover, keys, pair_target, hot, partitions)


def _scan_filters(
    catalog: DataFrame,
    query: DataFrame,
    reach: Column,
    profile: Profile,
    radius: float,
    metric: str,
    facts: dict,
    x: str,
    y: str,
) -> DataFrame:
    """Filters that follow from the join, stated early so that they reach the Parquet reader.

    The points' box, and for stored cells the ranges of ids that their circles touch: on cells for row groups, on folders
    of the cell-partitioned layout. Ranges go around the poles and across 0/360 as the cells do.
    """
    if not profile.rows:
        return catalog.where(F.lit(False))
    r = padded(radius)
    catalog = catalog.where(F.col(y).between(profile.y[0] - r, profile.y[1] + r))
    if metric == "planar":
        catalog = catalog.where(F.col(x).between(profile.x[0] - r, profile.x[1] + r))
    if facts.get("stored") and "s2_level" in facts:
        ranges = touched_ranges(query, reach, facts["s2_level"], QUERY + x, QUERY + y, profile.rows)
        catalog = catalog.where(in_ranges("cell_id", ranges))
        if "s2_parent" in facts and "partition_id" in catalog.columns:
            catalog = catalog.where(overlaps_ranges("partition_id", ranges))
    return catalog


def distinct_positions(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row per position; repeats merge in the tasks that read them, before any shuffle.

    Of rows at one position the least stays, all its other columns taken together.
    """
    others = [c for c in points.columns if c not in (x, y)]
    if not others:
        return points.select(x, y).distinct()
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("__least")
    return points.groupBy(x, y).agg(least).select(*[F.col(f"__least.`{c}`") if c in others else F.col(c) for c in points.columns])


# Columns that hold a position's text on its way through a join, and their names in an answer: source, then query point.
TEXT = "__text"
TEXTS = {TEXT: "point", QUERY + TEXT: "query_point"}


def _with_text(df: DataFrame, x: str, y: str) -> DataFrame:
    """Positions as text, made once a row instead of once a pair."""
    return df.withColumn(TEXT, geo.point_wkt(F.col(x), F.col(y)))


def wkt_columns() -> list[Column]:
    """The answer's geometry pair as text: ``point`` (source) and ``query_point``."""
    return [F.col(held).alias(name) for held, name in TEXTS.items()]


def _text_pairs(catalog: DataFrame, points: DataFrame, radius: float | str, **options) -> DataFrame:
    """``cone_pairs`` with both positions' text."""
    x, y = options.get("x", "lon"), options.get("y", "lat")
    return cone_pairs(_with_text(catalog, x, y), _with_text(points, x, y), radius, **options)


def cone_match(catalog: DataFrame, points: DataFrame, radius: float | str, **options) -> DataFrame:
    """Geometry pairs of all matches. Repeated query points repeat their matches."""
    x, y = options.get("x", "lon"), options.get("y", "lat")
    kept = dict.fromkeys([x, y, *(c for c in ("cell_id", "partition_id", options.get("weight")) if c in catalog.columns)])
    sides = catalog.select(*[F.col(f"`{c}`") for c in kept]), points.select(*dict.fromkeys([x, y, *([radius] if isinstance(radius, str) else [])]))
    return _text_pairs(*sides, radius, **options).select(*wkt_columns())


def cell_match(catalog: DataFrame, points: DataFrame, radius: float, **options) -> DataFrame:
    """Geometry pair and every catalog column as text; repeated query points count once."""
    place = options.get("x", "lon"), options.get("y", "lat")
    told = [c for c in CATALOG_COLUMNS if c in catalog.columns]
    # Text is made before the join, but for what the join itself needs.
    early = [c for c in told if c not in (*place, options.get("weight"))]
    text = catalog.select(*[F.col(f"`{c}`") for c in catalog.columns if c not in early], *as_strings(early))
    pairs = _text_pairs(text, distinct_positions(points.select("lon", "lat")), radius, **options)
    return pairs.select(*wkt_columns(), *[F.col(c) if c in early else F.col(c).cast("string").alias(c) for c in told])


def hybrid_match(catalog: DataFrame, points: DataFrame, radius: float, **options) -> DataFrame:
    """``cone_match`` over the cell-partitioned layout, with repeated query points counted once.

    The catalog must carry ``partition_id`` and ``cell_id``; ranges of ids that the circles touch prune the
    folders that are read, of whatever level they are, and the row groups in them.
    """
    if "s2_parent" not in cell_facts(catalog) or "partition_id" not in catalog.columns:
        raise ValueError("not a cell-partitioned catalog: partition_id and cell_id with S2 levels needed")
    return cone_match(catalog, distinct_positions(points.select("lon", "lat")), radius, **options)


def wkt_match(
    catalog: DataFrame, points: DataFrame, radius: float = 0.001, geom: str = "geom", **options
) -> DataFrame:
    """Match against geometry held as WKT text; answers the catalog geometry of each match."""
    # ``inline`` parses each text once; filters on plain columns would repeat the parsing per use.
    others = [F.col(f"`{c}`") for c in catalog.columns if c not in ("lon", "lat")]
    parsed = catalog.select(*others, F.inline(F.array(geo.parse_point_wkt(F.col(geom)))))
    return cone_pairs(parsed, points, radius, **options).select(F.col(geom).alias("point"))


# Longest list in a row of ``grouped_match``, and how often a full part is cut in four at most.
LIST_ROWS = 10_000
DEEPEST_CUT = 12
# Sources that a row holds while lists are made, and how much wider one of them is than a circle, roughly.
HELD_ROWS = 10_000
HELD_WIDTH = 2


def _cut_parts(parted: DataFrame, circles: DataFrame, height: float, list_rows: int, x: str, y: str) -> DataFrame:
    """Adds ``__square``: where a row lies in its part, which is cut in four as often as its number of rows asks for.

    Only parts that a circle may touch are counted. A row's square follows from the whole layer's rows in its part
    alone, however many parts are full: few are sent along, many are joined by a shuffle.
    """
    touched = with_occurring_keys(parted.select("__part"), circles, ["__part"])
    cuts = F.least(F.ceil(F.log2(F.col("n") / list_rows) / 2).cast("int"), F.lit(DEEPEST_CUT))
    full = touched.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_rows).select("__part", cuts.alias("__cuts"))
    parts = full.count()
    if not parts:
        return parted.withColumn("__square", F.lit(0).cast("bigint"))
    few = parts * KEY_BYTES <= BROADCAST_BYTES
    parted = parted.join(F.broadcast(full) if few else full.hint("merge"), "__part", "left").withColumn("__cuts", F.coalesce("__cuts", F.lit(0)))
    inside = lambda axis: f"least(greatest(bigint(floor((`{axis}` / {height!r}D - floor(`{axis}` / {height!r}D)) * __side)), 0L), __side - 1)"
    sided = parted.withColumn("__side", F.expr("shiftleft(1L, __cuts)"))
    return sided.withColumn("__square", F.expr(f"{inside(y)} * __side + {inside(x)}")).drop("__cuts", "__side")


def grouped_match(
    catalog: DataFrame,
    points: DataFrame,
    radius: float | str,
    *,
    center: Sequence[str],
    attributes: Sequence[str],
    part_height: float | None = None,
    list_rows: int | None = LIST_ROWS,
    x: str = "lon",
    y: str = "lat",
    **options,
) -> DataFrame:
    """Matches listed per query circle and place: ``center`` columns, ``part``, ``square``, ``run``, ``matches`` (sorted structs).

    ``part`` is the number of the square cell, ``part_height`` high, in which a list's matches lie, by default as high as the widest
    radius. A part with more than ``list_rows`` sources is cut in four, and again, and ``square`` numbers the piece
    (0 where nothing is cut). What lies on one spot cannot be cut: there the sorted matches go on in numbered
    runs. No list is longer than ``list_rows``, no task holds more of a circle than one list, and rows do not depend
    on files, counts of partitions or plans. Circles without matches are absent. With ``list_rows=None`` nothing is cut: a circle
    has one list a part, as long as its matches there are many.

    In the plane the sources of a square are put in order once, and a circle's list is what the circle leaves of them: no
    pair is shuffled or sorted. A spot with more than ``HELD_ROWS`` sources is held in pieces of whole runs. Pairs are listed
    where that cannot be: for centers that several rows of ``points`` share, for squares with more than ``HELD_ROWS`` sources that
    are no single spot or must not be cut, on the sphere, and if an index, strategy or weight is asked for.
    """
    if part_height is None:
        finite = F.when(~F.isnan(F.col(radius).cast("double")) & (F.col(radius) >= 0), F.col(radius)) if isinstance(radius, str) else None
        part_height = float(radius) if finite is None else float(points.agg(F.max(finite)).first()[0] or 0)
    height = max(part_height, FINEST)
    grid = PlaneGrid(height)
    parted = grid.with_cell(catalog.where(F.col(x).isNotNull() & F.col(y).isNotNull()), "__part", x, y)
    if options.get("metric") == "great_circle":
        circles = parted.select("__part")  # circles of the sphere have no bounded cover in the plane: all parts count
    else:
        query = query_side(points, radius, x, y)
        reach = F.col(QUERY + radius) if isinstance(radius, str) else F.lit(float(radius))
        circles = grid.explode_cover(query, reach, "__part", QUERY + x, QUERY + y).select("__part")
    squared = _cut_parts(parted, circles, height, list_rows, x, y) if list_rows else parted.withColumn("__square", F.lit(0).cast("bigint"))
    listed = lambda layer, rows: _listed_pairs(layer, rows, radius, center, attributes, list_rows, x=x, y=y, **options)
    if options.get("metric", "planar") != "planar" or not options.keys() <= {"metric", "shape", "boundary"}:
        return listed(squared, points)
    lists, (alone, shared), squares = [], _shared_centers(points, center), _squares(squared, attributes, list_rows, x, y)
    if shared is not None:
        lists.append(listed(squared, shared))
    if squares.by_pairs is not None:
        lists.append(listed(squares.by_pairs, alone))
    lists.append(_cut_lists(squares, alone, radius, center, attributes, height, list_rows, x, y, **options))
    return reduce(DataFrame.unionByName, lists)


def _listed_pairs(
    squared: DataFrame, points: DataFrame, radius: float | str, center: Sequence[str], attributes: Sequence[str], list_rows: int | None, x: str, y: str, **options
) -> DataFrame:
    """Lists of ``grouped_match`` from its pairs, which are dealt by center and place, and sorted."""
    pairs = cone_pairs(squared, points, radius, x=x, y=y, **options).select(
        *[F.col(QUERY + c).alias(c) for c in center],
        F.col("__part").alias("part"),
        F.col("__square").alias("square"),
        F.struct(*[F.col(f"`{c}`") for c in attributes]).alias("match"),
    )
    place = [*center, "part", "square"]
    if not list_rows:
        whole = pairs.groupBy(*[F.col(f"`{c}`") for c in place]).agg(F.sort_array(F.collect_list("match")).alias("matches"))
        return whole.select(*[F.col(f"`{c}`") for c in place], F.lit(0).cast("bigint").alias("run"), "matches")
    run = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("match")) - 1) / list_rows)
    # The lists need no shuffle of their own: their rows are together already.
    return pairs.withColumn("run", run).groupBy(*place, "run").agg(F.sort_array(F.collect_list("match")).alias("matches"))


def _shared_centers(points: DataFrame, center: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Points whose center is theirs alone, and those that share it with others, if any."""
    names = {c: f"__shared_{n}" for n, c in enumerate(center)}
    shared = points.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 1)
    if shared.isEmpty():
        return points, None
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in names.items()])
    return points.join(shared, same, "left_anti"), points.join(shared, same, "left_semi")


@dataclass(frozen=True)
class Squares:
    """Rows with ``__part``, ``__square`` and ``__chunk``, of which one row can hold all, and those whose pairs are listed instead, if any."""

    held: DataFrame
    by_pairs: DataFrame | None
    # Rows in the fullest square, and runs that a chunk before the last holds.
    most: int
    chunk_runs: int


def _squares(squared: DataFrame, attributes: Sequence[str], list_rows: int | None, x: str, y: str) -> Squares:
    """Tells squares that one row can hold from fuller ones.

    Of a full square that is one spot a circle has all sources or none, so they are numbered in order and held in chunks of
    whole runs. Other full squares, which no cut has made smaller, go by pairs.
    """
    most = max(list_rows or 0, HELD_ROWS)
    place = ["__part", "__square"]
    ends = [F.min(F.col(f"`{axis}`")) == F.max(F.col(f"`{axis}`")) for axis in (x, y)]
    spot = ends[0] & ends[1] if list_rows else F.lit(False)
    counted = squared.groupBy(*place).agg(F.count(F.lit(1)).alias("__rows"), spot.alias("__spot"))
    full = counted.where(F.col("__rows") > most)
    kinds = [F.count(F.when((F.col("__rows") > most) & kind, 1)).alias(name) for kind, name in ((F.col("__spot"), "spots"), (~F.col("__spot"), "others"))]
    facts = counted.agg(F.coalesce(F.max("__rows"), F.lit(0)).alias("most"), *kinds).first()
    whole = squared.withColumn("__chunk", F.lit(0).cast("bigint"))
    if not facts["spots"] + facts["others"]:
        return Squares(whole, None, facts["most"], 0)

    def of(kind: Column, how: str = "left_semi") -> DataFrame:
        few = (facts["spots"] + facts["others"]) * KEY_BYTES <= BROADCAST_BYTES
        chosen = full.where(kind).select(*place)
        return squared.join(F.broadcast(chosen) if few else chosen, place, how)

    held = of(F.lit(True), "left_anti").withColumn("__chunk", F.lit(0).cast("bigint"))
    runs = most // list_rows if list_rows else 0
    if facts["spots"]:
        number = F.row_number().over(Window.partitionBy(*place).orderBy(F.struct(*[F.col(f"`{c}`") for c in attributes])))
        held = held.unionByName(of(F.col("__spot")).withColumn("__chunk", F.floor((number - 1) / (runs * list_rows))))
    return Squares(held, of(~F.col("__spot")) if facts["others"] else None, facts["most"], runs)


def _cut_lists(
    squares: Squares,
    points: DataFrame,
    radius: float | str,
    center: Sequence[str],
    attributes: Sequence[str],
    height: float,
    list_rows: int | None,
    x: str,
    y: str,
    shape: str = "disc",
    boundary: bool = True,
    metric: str = "planar",
) -> DataFrame:
    """Lists of ``grouped_match`` for centers of one row and squares that a row can hold.

    Sorted sources of a square, or of a chunk of one, are one row, and so is a circle in a block of parts; the two meet in a
    join on the block.
    """
    query = query_side(points, radius, x, y)
    reach = F.col(QUERY + radius) if isinstance(radius, str) else F.lit(float(radius))
    query = query.select(*dict.fromkeys([*[QUERY + c for c in center], QUERY + x, QUERY + y, *([QUERY + radius] if isinstance(radius, str) else [])]))
    blocks = PlaneGrid(height, 1 if isinstance(radius, str) else max(1, math.ceil(2 * padded(radius) / height)))
    cover = blocks.explode_cover(query, reach, "__cell", QUERY + x, QUERY + y)

    match = F.struct(*[F.col(f"`{c}`") for c in attributes]).alias("match")
    one = F.struct(match, F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    bounds = [f(F.col(f"`{axis}`").cast("double")).alias(f"__{f.__name__}_{n}") for n, axis in (("x", x), ("y", y)) for f in (F.min, F.max)]
    located = blocks.with_cell(squares.held, "__cell", x, y)
    rows = ["__cell", "__part", "__square", "__chunk"]
    held = located.groupBy(*rows).agg(F.sort_array(F.collect_list(one)).alias("__held"), *bounds)

    # Circles and sources are counted, since a row of the join stands for as many pairs as it holds sources. Pieces are no
    # smaller than an even share of the work needs, and as held sources are wide, circles are repeated rather than they are.
    counts = bucket_counts(cover, located, ["__cell"])
    target = max(PAIR_TARGET, math.ceil(sum(a * b for a, b in counts.values()) / MOST_PARTITIONS))
    hot = hot_of(counts, target, (1, HELD_WIDTH))
    # Rows of both sides are unique, so these tell them apart.
    sides = cover.withColumn(PLACE, F.xxhash64(*[F.col(f"`{c}`") for c in query.columns])), held.withColumn(PLACE, F.xxhash64(*rows[1:]))
    joined = salted_join(*sides, ["__cell"], target, hot, join_partitions(counts, target)).drop(PLACE)

    px, py = F.col(QUERY + x), F.col(QUERY + y)
    # Rounding keeps order, so what holds of a square's nearest and farthest corner holds of all that lies between.
    near = [F.greatest(F.col(f"__min_{n}") - p, p - F.col(f"__max_{n}"), F.lit(0.0)) for n, p in (("x", px), ("y", py))]
    far = [F.greatest(F.abs(F.col(f"__min_{n}") - p), F.abs(F.col(f"__max_{n}") - p)) for n, p in (("x", px), ("y", py))]
    touched = joined.where(geo.disc_measure(*near) <= geo.disc_limit(reach))
    within = geo.in_polygon if shape == "polygon" else geo.in_disc
    inscribed = reach * (math.cos(geo.STEP / 2) * (1 - 1e-9)) if shape == "polygon" else reach
    whole = geo.in_disc(*far, inscribed, boundary)
    inside = F.filter("__held", lambda one: within(one["x"] - px, one["y"] - py, reach, boundary))
    own = [F.col(QUERY + c).alias(c) for c in center]
    # ``explode`` sees to it that a list is made once; a filter on a plain column would make it again.
    once = F.explode(F.array(F.when(whole, F.col("__held")).otherwise(inside))).alias("__found")
    found = touched.select(*own, F.col("__part").alias("part"), F.col("__square").alias("square"), "__chunk", once)
    found = found.where(F.size("__found") > 0)
    place = [*[F.col(f"`{c}`") for c in center], "part", "square"]
    if not list_rows or squares.most <= list_rows:
        return found.select(*place, F.lit(0).cast("bigint").alias("run"), F.col("__found")["match"].alias("matches"))
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.size("__matches") - 1) / list_rows)))
    cut = found.select(*place, "__chunk", F.col("__found")["match"].alias("__matches")).withColumn("run", runs)
    # The second ``explode`` leaves the whole list behind: rows that kept it beside their run would copy it once a run.
    own_run = F.slice("__matches", (F.col("run") * list_rows + 1).cast("int"), F.lit(list_rows))
    number = (F.col("__chunk") * squares.chunk_runs + F.col("run")).alias("run")
    return cut.select(*place, number, F.explode(F.array(own_run)).alias("matches"))


def count_matches(
    catalog: DataFrame,
    points: DataFrame,
    radii: Iterable[float],
    *,
    by: Sequence[str] = (),
    shape: str = "disc",
    distinct_points: bool = False,
    boundary: bool = True,
    x: str = "lon",
    y: str = "lat",
    **options,
) -> DataFrame:
    """Number of matches at each radius: columns ``by``, ``radius``, ``matches``, for every group of points, with zeros.

    One join at the widest radius serves all radii. Query points at one position are merged first
    and counted through a weight, so copies cost nothing; so are sources, when the catalog has to be
    shuffled anyway.
    """
    radii = sorted(set(float(r) for r in radii))
    weight = F.lit(1).cast("bigint") if distinct_points else F.count(F.lit(1))
    merged = points.groupBy(x, y, *by).agg(weight.alias("weight"))
    sources = catalog.select(x, y, *[c for c in ("cell_id", "partition_id") if c in catalog.columns])
    sources = sources.withColumn("copies", F.lit(1).cast("bigint"))
    pairs = cone_pairs(sources, merged, radii[-1], shape=shape, boundary=boundary, x=x, y=y, weight="copies", **options)
    measure_, limit = _measure(options.get("metric", "planar"), shape, x, y)
    groups = [F.col(QUERY + c).alias(c) for c in by]
    n = F.col("copies") * F.col(QUERY + "weight")
    weighed = pairs.select(*groups, measure_.alias("__measure"), n.alias("__n"))
    inside = lambda r: F.col("__measure") <= limit(F.lit(r)) if boundary else F.col("__measure") < limit(F.lit(r))
    totals = [F.coalesce(F.sum(F.when(inside(r), F.col("__n"))), F.lit(0).cast("bigint")).alias(f"n{k}") for k, r in enumerate(radii)]
    if by:
        # Groups of points without a match count as well.
        none = [F.lit(None).cast(weighed.schema[c].dataType).alias(c) for c in ("__measure", "__n")]
        weighed = weighed.unionByName(points.select(*by).distinct().select(*by, *none))
    wide = weighed.groupBy(*by).agg(*totals)
    rows = F.array(
        *[F.struct(F.lit(r).alias("radius"), F.col(f"n{k}").alias("matches")) for k, r in enumerate(radii)]
    )
    return wide.select(*by, F.inline(rows))


def first_pair(pairs: DataFrame) -> DataFrame:
    """Any one pair."""
    return pairs.limit(1)
