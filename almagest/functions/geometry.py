"""Planar points, search rings and membership tests as column expressions.

A point is ``struct<lon, lat>``; a ring is an array of such structs whose last vertex repeats the
first. Nothing here needs an extension: Catalyst sees ordinary arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: segments of a buffered point (8 per quadrant).
RING_SEGMENTS = 32
STEP = 2 * math.pi / RING_SEGMENTS


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def _wkt_pieces(text: Column) -> tuple[Column, Column]:
    """What stands between the marks of text as ``point_wkt`` makes it; cutting at marks is several times as fast as a pattern."""
    return F.substring_index(F.substring_index(text, " ", 2), "(", -1), F.substring_index(F.substring_index(text, " ", -1), ")", 1)


def _parsed(text: Column, pieces: Sequence[Column], numbers: Sequence[Column]) -> Column:
    """The numbers where the pieces are all there is, else what a pattern finds."""
    pattern = r"(?i)^\s*POINT\s*\(\s*(\S+)\s+([^\s)]+)\s*\)\s*$"
    any_form = [F.regexp_extract(text, pattern, n).try_cast("double") for n in (1, 2)]
    marks = len("POINT ( )")
    plain = (
        numbers[0].isNotNull() & numbers[1].isNotNull() & text.startswith("POINT (") & text.endswith(")")
        & (F.octet_length(pieces[0]) + F.octet_length(pieces[1]) + marks == F.octet_length(text))
    )
    return point(*[F.when(plain, number).otherwise(other) for number, other in zip(numbers, any_form)])


def parse_point_wkt(text: Column) -> Column:
    """``POINT (x y)`` to a point; text of another form gives NULL coordinates."""
    pieces = _wkt_pieces(text)
    return _parsed(text, pieces, [p.try_cast("double") for p in pieces])


def with_parsed_points(df: DataFrame, points: Mapping[str, str]) -> DataFrame:
    """``df`` with the points, named by the values, of the text columns that are the keys, as ``parse_point_wkt`` gives them.

    Pieces and numbers are columns of their own for a while: an expression that names them twice makes them twice, which
    tells where there is a text a pair.
    """
    names = {text: [f"__{n}_{axis}" for axis in ("lon", "lat")] for n, text in enumerate(points)}
    held = lambda prefix: {text: [F.col(prefix + name) for name in both] for text, both in names.items()}
    cut = df.withColumns({"__piece" + n: c for text, both in names.items() for n, c in zip(both, _wkt_pieces(F.col(f"`{text}`")))})
    read = cut.withColumns({"__number" + n: F.col("__piece" + n).try_cast("double") for both in names.values() for n in both})
    found = {out: _parsed(F.col(f"`{text}`"), held("__piece")[text], held("__number")[text]) for text, out in points.items()}
    return read.withColumns(found).drop(*[p + n for p in ("__piece", "__number") for both in names.values() for n in both])


def buffer_ring(lon: Column, lat: Column, radius) -> Column:
    """Closed 32-gon inscribed in the circle of this radius."""
    r = _col(radius)

    def vertex(k: Column) -> Column:
        angle = (k % RING_SEGMENTS) * STEP
        return point(lon + r * F.cos(angle), lat + r * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(RING_SEGMENTS)), vertex)


def ring_wkt(ring: Column) -> Column:
    pairs = F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))"))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring in square degrees, by the shoelace sum about its first vertex."""

    def area(vertices: Column) -> Column:
        first = vertices[0]

        def edge(a: Column, b: Column) -> Column:
            cross = (a["lon"] - first["lon"]) * (b["lat"] - first["lat"])
            return cross - (b["lon"] - first["lon"]) * (a["lat"] - first["lat"])

        ahead = F.slice(vertices, F.lit(2), F.size(vertices) - 1)
        edges = F.slice(F.zip_with(vertices, ahead, edge), F.lit(1), F.size(vertices) - 1)
        return F.abs(F.aggregate(edges, F.lit(0.0), lambda total, part: total + part)) / 2

    # A one-element ``transform`` makes sure the ring is worked out once.
    return F.get(F.transform(F.array(ring), area), 0)


def buffer_area(radius) -> Column:
    """Area of ``buffer_ring`` without building it."""
    r = _col(radius)
    return r * r * (RING_SEGMENTS / 2 * math.sin(STEP))


def disc_measure(dx: Column, dy: Column) -> Column:
    """Grows with the circle an offset needs: its squared length."""
    return dx * dx + dy * dy


def disc_limit(radius):
    """Largest ``disc_measure`` inside the circle of this radius."""
    return radius * radius


def polygon_measure(dx: Column, dy: Column) -> Column:
    """Grows with the ``buffer_ring`` an offset needs: its length along the normal of its edge.

    Within one sector of the regular polygon the edge is a straight line across the sector's middle.
    """
    turn = F.pmod(F.atan2(dy, dx), F.lit(STEP)) - STEP / 2
    return F.sqrt(dx * dx + dy * dy) * F.cos(turn)


def polygon_limit(radius):
    """Largest ``polygon_measure`` inside the ring of this radius: the distance of its edges."""
    return radius * math.cos(STEP / 2)


def well_inside(dx: Column, dy: Column, radius) -> Column:
    """Offset inside the circle within ``buffer_ring``, by more than rounding can matter: true for most that are inside, and needs no trigonometry."""
    return disc_measure(dx, dy) < disc_limit(_col(radius) * (math.cos(STEP / 2) * (1 - 1e-9)))


def in_disc(dx: Column, dy: Column, radius, boundary: bool = True) -> Column:
    """Offset inside the true circle; ``boundary=False`` leaves out the rim."""
    got, limit = disc_measure(dx, dy), disc_limit(_col(radius))
    return got <= limit if boundary else got < limit


def in_polygon(dx: Column, dy: Column, radius, boundary: bool = True) -> Column:
    """Offset inside ``buffer_ring``; the circle test runs first because it needs no trigonometry."""
    got, limit = polygon_measure(dx, dy), polygon_limit(_col(radius))
    return in_disc(dx, dy, radius) & (well_inside(dx, dy, radius) | (got <= limit if boundary else got < limit))
