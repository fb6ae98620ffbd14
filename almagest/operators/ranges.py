"""Ranges of S2 ids that a set of circles touches, for filters on stored cells.

A cell of any level is a range of the ids of the cells inside it. However many circles there are, the cells that
cover them are taken at the finest level at which they are few, and neighbours are united: a short list of ranges, which
the Parquet reader can hold against the statistics of its row groups, and which tells the folders of a
cell-partitioned layout that may hold a match, whatever their level.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.functions.s2 import MAX_LEVEL, covering_bound, explode_s2_covering

# Cells fetched to make ranges of, roughly at most, and ranges in a filter.
CELLS = 4096
RANGES = 64
# Circles that are covered one by one, roughly at most; more are merged with their neighbours first.
MERGED = 4096

Ranges = list[tuple[int, int]]


def ancestor(cell: str, level: int) -> Column:
    """The cell of ``level`` that holds a cell; the cell itself if it is no finer."""
    mark = f"greatest({cell} & -{cell}, {1 << 2 * (MAX_LEVEL - level)}L)"
    return F.expr(f"({cell} & (-2 * {mark})) | {mark}")


def united(cells: Iterable[int], most: int = RANGES) -> Ranges:
    """Sorted ranges of ids that hold the cells: neighbours united, then across the smallest gaps until there are ``most``."""
    ranges: Ranges = []
    for low, high in sorted((c - ((c & -c) - 1), c + ((c & -c) - 1)) for c in cells):
        # Ids are odd at the finest level: ranges two apart have nothing between them.
        if ranges and low <= ranges[-1][1] + 2:
            ranges[-1] = ranges[-1][0], max(ranges[-1][1], high)
        else:
            ranges.append((low, high))
    if len(ranges) > most:
        gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k][0] - ranges[k - 1][1])
        kept = [0, *sorted(gaps[len(ranges) - most :]), len(ranges)]
        ranges = [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(kept, kept[1:])]
    return ranges


def merged_circles(circles: DataFrame, radius: Column, x: str, y: str) -> tuple[DataFrame, Column]:
    """About ``MERGED`` circles at most that hold all of ``circles``, and their radius.

    Circles whose centers share a square of a grid become one about the box of those centers. Distances on the sphere are no
    longer than in the plane, so it holds them in either.
    """
    ends = [f(axis).alias(f"{f.__name__}_{axis}") for axis in (x, y) for f in (F.min, F.max)]
    box = circles.agg(*ends).first()
    wide, high = (box[f"max_{axis}"] - box[f"min_{axis}"] for axis in (x, y))
    side = max(math.sqrt(wide * high / MERGED), wide / MERGED, high / MERGED)
    if not (0 < side < math.inf):
        return circles, radius
    squares = circles.groupBy(*[F.floor(F.col(axis) / side).alias(f"__of_{axis}") for axis in (x, y)]).agg(*ends, F.max(radius).alias("__widest"))
    across = [(F.col(f"max_{axis}") - F.col(f"min_{axis}")) / 2 for axis in (x, y)]
    reach = (F.col("__widest") + F.sqrt(across[0] * across[0] + across[1] * across[1])).alias("__reach")
    return squares.select(*[(F.col(f"min_{axis}") + half).alias(axis) for axis, half in zip((x, y), across)], reach), F.col("__reach")


def touched_ranges(circles: DataFrame, radius: Column, finest: int, x: str, y: str, rows: int) -> Ranges:
    """Ranges of ids that hold all cells the circles touch. ``rows`` is the number of circles."""
    if rows > MERGED:
        circles, radius = merged_circles(circles, radius, x, y)
    cover = explode_s2_covering(circles, radius, finest, "__cell", x, y).select("__cell")
    level = finest
    if rows * covering_bound() > CELLS:
        counts = cover.agg(*[F.approx_count_distinct(ancestor("__cell", n)).alias(f"n{n}") for n in range(finest + 1)]).first()
        level = max([n for n in range(finest + 1) if counts[f"n{n}"] <= CELLS], default=0)
    found = cover.select(ancestor("__cell", level).alias("cell")).distinct()
    return united(row["cell"] for row in found.collect())


def in_ranges(column: str, ranges: Ranges) -> Column:
    return F.expr(" OR ".join(f"`{column}` BETWEEN {low}L AND {high}L" for low, high in ranges) or "false")


def overlaps_ranges(column: str, ranges: Ranges) -> Column:
    """For ids of cells of any level, such as folders: whether a cell shares ids with a range."""
    reach = f"((`{column}` & -`{column}`) - 1L)"
    return F.expr(" OR ".join(f"`{column}` - {reach} <= {high}L AND `{column}` + {reach} >= {low}L" for low, high in ranges) or "false")
