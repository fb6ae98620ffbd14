"""S2 cell ids of positions and of search circles, as plain Spark expressions.

The sphere is projected on the six faces of a cube, each face is halved ``level`` times along both
axes, and cells are numbered along a Hilbert curve (the public S2 cell numbering). The work is laid
out as a chain of projections so that each step is computed once per row inside generated code.
Formulas are given as SQL text: one call each, where a tree of column objects would take hundreds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.cells import padded

MAX_LEVEL = 30
# Fixed value: id of no cell, given to rows without a position.
NO_CELL = 0
# For each curve orientation, the (i, j) quadrant visited at each position, and the
# change of orientation at each position.
QUADRANT_AT = [[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]]
ORIENTATION_CHANGE = [1, 0, 0, 3]
# Fixed value: shortest width of a cell, in radians, times 2^level.
MIN_WIDTH = 2 * math.sqrt(2) / 3
# Levels of the curve handled by one table lookup.
CHUNK = 3


@lru_cache(maxsize=None)
def _curve_table(width: int) -> tuple[int, ...]:
    """For orientation, ``width`` bits of i and of j: position bits and the orientation after them."""
    table = []
    for start in range(4):
        for i in range(1 << width):
            for j in range(1 << width):
                orientation, position = start, 0
                for k in reversed(range(width)):
                    quadrant = (i >> k & 1) * 2 + (j >> k & 1)
                    step = QUADRANT_AT[orientation].index(quadrant)
                    position = position * 4 + step
                    orientation ^= ORIENTATION_CHANGE[step]
                table.append(position * 4 + orientation)
    return tuple(table)


def _with_id(df: DataFrame, level: int, out: str, start: str, valid: str = "true") -> DataFrame:
    """Cell id from the columns ``__face``, ``__i``, ``__j`` and the curve's first orientation."""
    widths = ([level % CHUNK] if level % CHUNK else []) + [CHUNK] * (level // CHUNK)
    orientation, position, left = start, "bigint(__face)", level
    for n, width in enumerate(widths):
        left -= width
        mask = (1 << width) - 1
        index = (
            f"{orientation} * {1 << 2 * width} + (shiftright(__i, {left}) & {mask}) * {1 << width}"
            f" + (shiftright(__j, {left}) & {mask})"
        )
        df = df.withColumn(f"__k{n}", F.expr(f"get(array{_curve_table(width)}, int({index}))"))
        orientation = f"(__k{n} & 3)"
        position = f"(shiftleft({position}, {2 * width}) | bigint(shiftright(__k{n}, 2)))"
    left = 2 * (MAX_LEVEL - level)
    # Never NULL: otherwise a join on the cell would add a null filter that repeats the whole chain.
    cell = f"coalesce(if({valid}, shiftleft({position}, {left + 1}) | {1 << left}L, {NO_CELL}L), {NO_CELL}L)"
    return df.withColumn(out, F.expr(cell))


def _along_axis(level: int) -> str:
    """Number of cells along an axis of a face."""
    return f"{1 << level}L"


def _cell_index(u: str, cells: str) -> str:
    """Cell number along an axis, which has ``cells``, of a face coordinate in [-1, 1].

    The coordinate is first taken to [0, 1] by the quadratic rule that evens out cell sizes.
    """
    unit = f"((1 - signum({u})) / 2 + signum({u}) * (sqrt(1 + 3 * abs({u})) * 0.5D))"
    return f"least(greatest(floor({unit} * {cells}), 0L), {cells} - 1L)"


def _face_bound(index: str, cells: str) -> str:
    """Face coordinate of the lower edge of a cell: the quadratic rule undone."""
    s = f"(({index}) / {cells})"
    return f"CASE WHEN {s} >= 0.5D THEN (4 * {s} * {s} - 1) / 3 ELSE (1 - 4 * (1 - {s}) * (1 - {s})) / 3 END"


def _with_vector(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns(
        {
            "__x": F.expr(f"cos(radians(`{y}`)) * cos(radians(`{x}`))"),
            "__y": F.expr(f"cos(radians(`{y}`)) * sin(radians(`{x}`))"),
            "__z": F.expr(f"sin(radians(`{y}`))"),
        }
    )


# Per face, the vector's parts along the face normal and along the face's two axes.
FACE_FRAMES = [
    ("__x", "__y", "__z"),
    ("__y", "-__x", "__z"),
    ("__z", "-__x", "-__y"),
    ("-__x", "-__z", "-__y"),
    ("-__y", "-__z", "__x"),
    ("-__z", "__y", "__x"),
]


def with_s2_cell(df: DataFrame, level: int, out: str = "cell_id", x: str = "lon", y: str = "lat") -> DataFrame:
    """Add the S2 cell that holds the position, as a signed 64-bit id."""
    columns = [c for c in df.columns if c != out]
    df = _with_vector(df.select(*columns), x, y).withColumn(
        "__axis",
        F.expr(
            "CASE WHEN abs(__x) > abs(__y) THEN CASE WHEN abs(__x) > abs(__z) THEN 0 ELSE 2 END"
            " WHEN abs(__y) > abs(__z) THEN 1 ELSE 2 END"
        ),
    )

    def by_axis(first: str, second: str, third: str) -> str:
        return f"(CASE __axis WHEN 0 THEN {first} WHEN 1 THEN {second} ELSE {third} END)"

    # A face on the negative side has its two axes exchanged. That equals starting the curve in its
    # mirrored orientation, so the sign enters the face number only.
    df = df.withColumns(
        {
            "__face": F.expr(f"__axis + CASE WHEN {by_axis('__x', '__y', '__z')} < 0 THEN 3 ELSE 0 END"),
            "__i": F.expr(_cell_index(by_axis("__y / __x", "-__x / __y", "-__x / __z"), _along_axis(level))),
            "__j": F.expr(_cell_index(by_axis("__z / __x", "__z / __y", "-__y / __z"), _along_axis(level))),
        }
    )
    # ``least`` and ``greatest`` pass over NULL, hence the explicit test.
    placed = f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL"
    return _with_id(df, level, out, "(__axis & 1)", placed).select(*columns, out)


def s2_parent(cell: Column, level: int) -> Column:
    """Cell of a coarser level that holds this cell."""
    mark = 1 << 2 * (MAX_LEVEL - level)
    return cell.bitwiseAND(F.lit(-2 * mark)).bitwiseOR(F.lit(mark))


def _on_faces(df: DataFrame, radius: Column, kept: list[str], x: str, y: str) -> DataFrame:
    """One row per circle and cube face that it may meet, with the angles that bound it along both axes of the face."""
    frames = ", ".join(
        f"named_struct('face', {face}, 'n', {n}, 'p', {p}, 'q', {q})" for face, (n, p, q) in enumerate(FACE_FRAMES)
    )
    df = _with_vector(df.withColumn("__r", padded(radius)), x, y).withColumn(
        # Two is beyond every sine: all tests below then hold.
        "__sin", F.when(F.col("__r") >= 90, F.lit(2.0)).otherwise(F.sin(F.radians("__r")))
    )
    df = df.selectExpr(*kept, "__r", "__sin", f"explode(array({frames})) AS __frame").selectExpr(
        *kept, "__r", "__sin", "__frame.face AS __face", "__frame.n AS __n", "__frame.p AS __p", "__frame.q AS __q"
    )

    def interval(along: str, across: str) -> tuple[str, str]:
        """Angles about the other axis, clipped to the face; all of it when the circle holds that axis."""
        spread = f"sqrt(greatest(1 - {across} * {across}, 0D))"
        centre, half = f"atan2({along}, __n)", f"asin(least(__sin / {spread}, 1D))"
        return (
            f"CASE WHEN __sin >= {spread} THEN -pi() / 4 ELSE greatest({centre} - {half}, -pi() / 4) END",
            f"CASE WHEN __sin >= {spread} THEN pi() / 4 ELSE least({centre} + {half}, pi() / 4) END",
        )

    (p_low, p_high), (q_low, q_high) = interval("__p", "__q"), interval("__q", "__p")
    return df.selectExpr(
        "*", f"{p_low} AS __pl", f"{p_high} AS __ph", f"{q_low} AS __ql", f"{q_high} AS __qh"
    ).where("__pl <= __ph AND __ql <= __qh")


def _explode_rectangle(df: DataFrame, cells: str) -> DataFrame:
    for name, low, high in (("__i", "__pl", "__ph"), ("__j", "__ql", "__qh")):
        span = f"sequence({_cell_index(f'tan({low})', cells)}, {_cell_index(f'tan({high})', cells)})"
        df = df.withColumn(name, F.expr(f"explode({span})"))
    return df.where(f"__sin >= 2 OR {_cell_meets_circle(cells)}")


def explode_s2_cover(
    df: DataFrame, radius: Column, level: int, out: str = "cell_id", x: str = "lon", y: str = "lat"
) -> DataFrame:
    """One row per S2 cell that meets the circle of ``radius`` degrees on the sphere.

    For each cube face the circle's extent along a face axis is an angle interval, so the cells to
    look at form a rectangle of (i, j); faces are clipped, which settles cube edges and corners. A
    cell stays when it holds the centre or one of its edges comes within the radius.
    A circle in the plane lies inside this one: its straight-line distances are never shorter.
    A circle of 90 degrees or more is a hemisphere or larger and takes every cell of the level.
    """
    columns = [c for c in df.columns if c != out]
    met = _explode_rectangle(_on_faces(df.select(*columns), radius, [f"`{c}`" for c in columns], x, y), _along_axis(level))
    return _with_id(met, level, out, "(__face & 1)").select(*columns, out)


def explode_s2_covering(
    df: DataFrame, radius: Column, finest: int, out: str = "cell_id", x: str = "lon", y: str = "lat", steps: int = 2, coarsest: int = 0
) -> DataFrame:
    """One row per S2 cell of a covering by cells of several levels, with the cell and its level as ``__level``.

    Each circle begins with the cells that meet it at a level where they are no narrower than the circle: a handful, whatever the
    radius. Cells that reach beyond its rim are cut in four, ``steps`` times, and parts that do not meet it are left out;
    cells inside stay whole. No level is finer than ``finest``, none coarser than ``coarsest``. Cells of a circle do
    not overlap, and their number is bounded by ``covering_bound``.
    """
    columns = [c for c in df.columns if c not in (out, "__level")]
    kept = [f"`{c}`" for c in columns]
    base = f"int(least(greatest(floor(log2({MIN_WIDTH!r}D / (2 * radians(__r)))), {coarsest}), {finest}))"
    placed = _on_faces(df.select(*columns), radius, kept, x, y).withColumn("__level", F.expr(base))
    met = _explode_rectangle(placed.withColumn("__cells", F.expr("shiftleft(1L, __level)")), "__cells")
    part = lambda level, i, j: f"named_struct('level', {level}, 'i', {i}, 'j', {j})"
    four = ", ".join(part("__level + 1", f"2 * __i + {a}", f"2 * __j + {b}") for a in (0, 1) for b in (0, 1))
    whole = f"__level >= {finest} OR __sin >= 2 OR {_cell_in_circle('__cells')}"
    state = ["__face", "__n", "__p", "__q", "__sin"]
    for _ in range(steps):
        parted = met.selectExpr(*kept, *state, f"explode(if({whole}, array({part('__level', '__i', '__j')}), array({four}))) AS __part")
        met = parted.selectExpr(
            *kept, *state, "__part.level AS __level", "__part.i AS __i", "__part.j AS __j", "shiftleft(1L, __part.level) AS __cells"
        ).where(f"__sin >= 2 OR {_cell_meets_circle('__cells')}")
    # The finest cell at the corner of each, and from it the cell itself.
    corner = met.withColumns({c: F.expr(f"shiftleft({c}, {finest} - __level)") for c in ("__i", "__j")})
    found = _with_id(corner, finest, out, "(__face & 1)")
    mark = f"shiftleft(1L, 2 * ({MAX_LEVEL} - __level))"
    return found.withColumn(out, F.expr(f"(`{out}` & (-2 * {mark})) | {mark}")).select(*columns, out, "__level")


def covering_bound(steps: int = 2) -> int:
    """Most cells of one circle's covering: a circle no wider than its cells meets at most six of them."""
    return 6 << (2 * steps)


def _face_bounds(cells: str) -> str:
    return ", ".join(
        f"'{name}', {_face_bound(index, cells)}"
        for name, index in (("u0", "__i"), ("u1", "__i + 1"), ("v0", "__j"), ("v1", "__j + 1"))
    )


def _corner_tests() -> list[str]:
    """For each corner of a cell, whether it lies within the radius: the sine of the distance is the length of a cross product."""
    n, p, q = "__n", "__p", "__q"
    tests = []
    for a in ("c.u0", "c.u1"):
        for b in ("c.v0", "c.v1"):
            parts = [f"({a} * {q} - {b} * {p})", f"({b} * {n} - {q})", f"({p} - {a} * {n})"]
            square = " + ".join(f"{part} * {part}" for part in parts)
            tests.append(
                f"{square} <= __sin * __sin * (1 + {a} * {a} + {b} * {b}) AND {n} + {a} * {p} + {b} * {q} > 0"
            )
    return tests


def _cell_in_circle(cells: str) -> str:
    """Cell ``(__i, __j)`` lies inside the circle, which is less than a hemisphere: all its corners do."""
    return f"exists(array(named_struct({_face_bounds(cells)})), c -> ({') AND ('.join(_corner_tests())}))"


def _cell_meets_circle(cells: str) -> str:
    """Cell ``(__i, __j)`` holds the centre, or an edge or corner of it lies within the radius.

    The cell bounds are handed to a one-element ``exists`` so that they are worked out once per row.
    """
    n, p, q = "__n", "__p", "__q"
    u, v = ("c.u0", "c.u1"), ("c.v0", "c.v1")
    tests = [f"{n} > 0 AND {p} BETWEEN {u[0]} * {n} AND {u[1]} * {n} AND {q} BETWEEN {v[0]} * {n} AND {v[1]} * {n}"]
    for own, other, line, ends in [(p, q, u[0], v), (p, q, u[1], v), (q, p, v[0], u), (q, p, v[1], u)]:
        # Edges are arcs of great circles: compare the sine of the distance to that circle, and ask
        # whether the foot of the perpendicular falls between the ends.
        scale, offset, foot = f"(1 + {line} * {line})", f"({own} - {line} * {n})", f"({n} + {line} * {own})"
        tests.append(
            f"{offset} * {offset} <= __sin * __sin * {scale} AND {foot} > 0"
            f" AND {other} * {scale} BETWEEN {ends[0]} * {foot} AND {ends[1]} * {foot}"
        )
    tests += _corner_tests()
    return f"exists(array(named_struct({_face_bounds(cells)})), c -> ({') OR ('.join(tests)}))"


@dataclass(frozen=True)
class S2Cells:
    """S2 cells of one level, offered as a cell index."""

    level: int

    def with_cell(self, df: DataFrame, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        return with_s2_cell(df, self.level, out, x, y)

    def explode_cover(
        self, df: DataFrame, radius: Column, out: str, x: str = "lon", y: str = "lat"
    ) -> DataFrame:
        return explode_s2_cover(df, radius, self.level, out, x, y)

    def cover_bound(self, radius: float) -> int:
        if padded(radius) >= 90:
            return 6 << (2 * self.level)
        across = math.floor(2 * math.radians(padded(radius)) * (1 << self.level) / MIN_WIDTH) + 2
        return 3 * across * across


@dataclass(frozen=True)
class S2Covering:
    """S2 cells of several levels: few large ones inside a circle, small ones at its rim. Joins are on ``__level`` beside the cell.

    ``levels`` are those that coverings of the circles searched can have; ``for_radii`` finds them.
    """

    levels: tuple[int, ...]
    steps: int = 2

    keys = ("__level",)

    @classmethod
    def for_radii(cls, least: float, widest: float, finest: int, steps: int = 2) -> S2Covering:
        low, high = (
            min(max(math.floor(math.log2(MIN_WIDTH / (2 * math.radians(padded(r))))), 0), finest) for r in (widest, least)
        )
        return cls(tuple(range(low, min(high + steps, finest) + 1)), steps)

    def with_cell(self, df: DataFrame, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        located = with_s2_cell(df, max(self.levels), out, x, y)
        cells = [F.struct(F.lit(n).alias("__level"), s2_parent(F.col(out), n).alias(out)) for n in self.levels]
        return located.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, "__level")], F.inline(F.array(*cells)))

    def explode_cover(
        self, df: DataFrame, radius: Column, out: str, x: str = "lon", y: str = "lat"
    ) -> DataFrame:
        return explode_s2_covering(df, radius, max(self.levels), out, x, y, self.steps, min(self.levels))

    def cover_bound(self, radius: float) -> int:
        return max(covering_bound(self.steps), 6 << (2 * min(self.levels)))
