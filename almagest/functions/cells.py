"""Cell indexes that turn a radius search into an equi-join.

An index gives every catalog position one cell, and every search circle the full list of cells it
may touch. A pair within the radius therefore always shares a cell, and at most once, because a
catalog row has a single cell. All three indexes offer the same three methods:

``with_cell(df, out)``            add the cell of a position
``explode_cover(df, radius, out)`` one row per cell that a circle may touch
``cover_bound(radius)``           largest number of cells for one circle
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells of a plane grid are numbered row * ROW_STRIDE + column; columns stay below half of it.
ROW_STRIDE = 1 << 32


def padded(radius):
    """Radius made a hair larger, so that rounding in the cover can never lose a cell."""
    return radius * (1 + 1e-9) + 1e-12


def _cell_number(value: str, height: float) -> str:
    return f"floor(({value}) / {height!r}D)"


def _never_null(cell: str) -> str:
    """Keeps a join on the cell from adding a null filter that works the cell out a second time."""
    return f"coalesce({cell}, 0L)"


def _with_reach(df: DataFrame, radius: Column) -> DataFrame:
    return df.withColumn("__r", padded(radius))


@dataclass(frozen=True)
class PlaneGrid:
    """Square cells of side ``height`` in the units of the plane (degrees, or projected metres).

    ``block`` joins so many cells a side into one; a cell lies in one block, whatever rounding does.
    """

    height: float
    block: int = 1

    def _number(self, value: str) -> str:
        cell = _cell_number(value, self.height)
        return cell if self.block == 1 else f"floor({cell} / {self.block})"

    def with_cell(self, df: DataFrame, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        row, column = self._number(f"`{y}`"), self._number(f"`{x}`")
        return df.withColumn(out, F.expr(_never_null(f"{row} * {ROW_STRIDE} + {column}")))

    def explode_cover(
        self, df: DataFrame, radius: Column, out: str, x: str = "lon", y: str = "lat"
    ) -> DataFrame:
        def span(axis: str) -> str:
            low, high = (self._number(f"`{axis}` {sign} __r") for sign in "-+")
            return f"explode(sequence({low}, {high}))"

        kept = [f"`{c}`" for c in df.columns]
        return (
            _with_reach(df, radius)
            .selectExpr("*", f"{span(y)} AS __row")
            .selectExpr("*", f"{span(x)} AS __column")
            .selectExpr(*kept, f"{_never_null(f'__row * {ROW_STRIDE} + __column')} AS `{out}`")
        )

    def cover_bound(self, radius: float) -> int:
        return (math.floor(2 * padded(radius) / (self.height * self.block)) + 2) ** 2


@dataclass(frozen=True)
class SphereGrid:
    """Declination zones of ``height`` degrees, each cut into equal bins of right ascension.

    A zone has as many bins as fit at its polar edge, so no bin is narrower than ``height`` on the
    sky and zones near a pole have few. A circle's half-width in right ascension is
    ``asin(sin r / cos dec)``; a circle that holds a pole takes every bin of its zones.
    """

    height: float

    @property
    def zones(self) -> int:
        return math.ceil(180 / self.height)

    @property
    def stride(self) -> int:
        return math.floor(360 / self.height) + 1

    def _zone(self, lat: str) -> str:
        return f"least(greatest({_cell_number(f'{lat} + 90D', self.height)}, 0L), {self.zones - 1}L)"

    def _with_bins(self, df: DataFrame) -> DataFrame:
        low = f"(__zone * {self.height!r}D - 90D)"
        edge = f"least(greatest(abs({low}), abs({low} + {self.height!r}D)), 90D)"
        bins = f"greatest(floor(cos(radians({edge})) * {360 / self.height!r}D), 1L)"
        return df.withColumn("__bins", F.expr(bins))

    @staticmethod
    def _turn(lon: str) -> str:
        return f"(pmod(`{lon}` + 180D, 360D) / 360D)"

    def with_cell(self, df: DataFrame, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        kept = [f"`{c}`" for c in df.columns if c != out]
        cell = f"__zone * {self.stride} + least(floor({self._turn(x)} * __bins), __bins - 1)"
        zoned = self._with_bins(df.selectExpr(*kept, f"{self._zone(f'`{y}`')} AS __zone"))
        return zoned.selectExpr(*kept, f"{_never_null(cell)} AS `{out}`")

    def explode_cover(
        self, df: DataFrame, radius: Column, out: str, x: str = "lon", y: str = "lat"
    ) -> DataFrame:
        kept = [f"`{c}`" for c in df.columns]
        width = f"asin(least(sin(radians(__r)) / cos(radians(`{y}`)), 1D)) / {2 * math.pi!r}D"
        # Padded like the radius: the half-width is rounded as well.
        half = f"(CASE WHEN abs(`{y}`) + __r < 90D THEN {width} ELSE 0.5D END * {1 + 1e-9!r}D + 1e-12D)"
        zoned = _with_reach(df, radius).selectExpr(
            "*", f"explode(sequence({self._zone(f'`{y}` - __r')}, {self._zone(f'`{y}` + __r')})) AS __zone"
        )
        bounded = self._with_bins(zoned).selectExpr(
            "*",
            f"floor(({self._turn(x)} - {half}) * __bins) AS __low",
            f"floor(({self._turn(x)} + {half}) * __bins) AS __high",
        )
        whole = "__high - __low + 1 >= __bins"
        spread = f"explode(sequence(if({whole}, 0L, __low), if({whole}, __bins - 1, __high))) AS __bin"
        cell = f"__zone * {self.stride} + pmod(__bin, __bins)"
        return bounded.selectExpr("*", spread).selectExpr(*kept, f"{_never_null(cell)} AS `{out}`")

    def cover_bound(self, radius: float) -> int:
        zones = min(math.floor(2 * padded(radius) / self.height) + 2, self.zones)
        # The widest zone a pole circle meets lies within 2r + height of the pole.
        polar = math.radians(min(90.0, 2 * padded(radius) + 2 * self.height))
        return zones * (math.floor(math.sin(polar) * 360 / self.height) + 2)


# Cells of the finest grid are this high (degrees, or the plane's own unit); circles of no radius use it.
FINEST = 1e-4
# A grid's cells are at least this many times as high as the largest radius searched on it.
CELL_RADII = 2.0


def radius_class(radius: Column, least: int = 0) -> Column:
    """Power of two, times ``FINEST``, of the grid on which a circle of this radius is searched."""
    wide = F.greatest(CELL_RADII * padded(radius) * (1 + 1e-6), F.lit(FINEST)) / FINEST
    return F.greatest(F.ceil(F.log2(wide)).cast("int"), F.lit(least))


def least_class(extent: float) -> int:
    """First class whose grid can number cells over this extent; it matters for planes in metres only."""
    return max(0, math.ceil(math.log2(max(extent, FINEST) / FINEST / (ROW_STRIDE >> 2))))


@dataclass(frozen=True)
class RadiusClasses:
    """Several grids, one per class of radii that occurs, so that one wide circle does not widen all cells.

    A circle is searched on the grid of its class only; a position has a cell on each grid that occurs, so
    a pair still meets once. With several classes joins are on ``__class`` beside the cell. ``halvings`` makes the cells
    of all grids finer: a circle then has more cells, and they hold fewer rows that are not in it.
    """

    numbers: tuple[int, ...]
    metric: str = "planar"
    halvings: int = 0

    @property
    def keys(self) -> list[str]:
        return ["__class"] if len(self.numbers) > 1 else []

    def height(self, number: int) -> float:
        return FINEST * 2.0**number

    def grid(self, number: int):
        height = self.height(number) / 2**self.halvings
        if self.metric == "great_circle":
            return SphereGrid(min(height, 180.0))
        return PlaneGrid(height)

    def with_cell(self, df: DataFrame, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        kept = [F.col(f"`{c}`") for c in df.columns if c != out]
        if len(self.numbers) == 1:
            return self.grid(self.numbers[0]).with_cell(df, out, x, y)
        frame = df
        for number in self.numbers:
            frame = self.grid(number).with_cell(frame, f"__cell_{number}", x, y)
        cells = [F.struct(F.lit(n).alias("__class"), F.col(f"__cell_{n}").alias(out)) for n in self.numbers]
        return frame.select(*kept, F.inline(F.array(*cells)))

    def explode_cover(self, df: DataFrame, radius: Column, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        if len(self.numbers) == 1:
            return self.grid(self.numbers[0]).explode_cover(df, radius, out, x, y)
        own = radius_class(radius, min(self.numbers))
        covers = [
            self.grid(n).explode_cover(df.where(own == n), radius, out, x, y).withColumn("__class", F.lit(n))
            for n in self.numbers
        ]
        return reduce(DataFrame.unionByName, covers)

    def cover_bound(self, radius: float) -> int:
        return max(self.grid(n).cover_bound(min(radius, self.height(n) / CELL_RADII)) for n in self.numbers)


@dataclass(frozen=True)
class Within:
    """The cells of ``outer``, each cut by those of ``inner``: rows meet where they share both, which they do once."""

    outer: object
    inner: RadiusClasses

    @property
    def keys(self) -> list[str]:
        return [*getattr(self.outer, "keys", ()), "__outer", *self.inner.keys]

    def with_cell(self, df: DataFrame, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        return self.inner.with_cell(self.outer.with_cell(df, "__outer", x, y), out, x, y)

    def explode_cover(self, df: DataFrame, radius: Column, out: str, x: str = "lon", y: str = "lat") -> DataFrame:
        return self.inner.explode_cover(self.outer.explode_cover(df, radius, "__outer", x, y), radius, out, x, y)

    def cover_bound(self, radius: float) -> int:
        return self.outer.cover_bound(radius) * self.inner.cover_bound(radius)


# Rows that a cell holds on average from which on cells are halved once, twice and three times: joining a cell of a circle
# costs about as much as testing twenty rows.
HALVED_AT = (40, 200, 1200)


def halvings(rows_per_cell: float) -> int:
    """How often cells are halved that hold so many rows on average."""
    return sum(rows_per_cell >= n for n in HALVED_AT)
