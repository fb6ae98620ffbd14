"""Per-tile corrections of positions and proper motions, and unions of tiles."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions.coords import with_point_columns
from almagest.operators.skew import lookup_join
from almagest.schema import CATALOG_TYPES

# Corrected column and the offset added to it.
CORRECTIONS = {"ra": "offsetra", "dec": "offsetdec", "pmra": "offsetpmra", "pmdec": "offsetpmdec"}


def one_per_key(table: DataFrame, key: str, repeated: str = "stop") -> DataFrame:
    """A lookup table with one row per key, so that a join with it repeats nothing.

    Equal rows are one. Different rows of a key stop the job, in the job that reads them, or with ``repeated='least'`` the
    least row stays, by its columns from left to right, null first.
    """
    if repeated not in ("stop", "least"):
        raise ValueError(f"unknown rule {repeated!r} for repeated keys")
    others = [c for c in table.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    merged = table.groupBy(key).agg(F.min(row).alias("__least"), F.max(row).alias("__greatest"))
    least = F.col("__least")
    if repeated == "stop":
        message = F.concat(F.lit(f"different rows for one {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
        least = F.when(least.eqNullSafe(F.col("__greatest")), least).otherwise(F.raise_error(message).cast(table.select(row).schema[0].dataType))
    chosen = merged.select(key, least.alias("__row"))
    return chosen.select(*[F.col(f"__row.`{c}`") if c != key else F.col(c) for c in table.columns])


def apply_offsets(catalog: DataFrame, offsets: DataFrame, tile: str = "tile", repeated: str = "stop") -> DataFrame:
    """Corrected catalog of all tiles in one job, led by ``ra_point`` and ``dec_point``.

    Sources of a tile that has no offsets are left out; ``dropped_tiles`` lists them. A tile with two different rows of
    offsets stops the job, or by ``repeated='least'`` has the least of them: no source comes out twice.
    """
    table = one_per_key(offsets.select(F.col("tile").alias(tile), *CORRECTIONS.values()), tile, repeated)
    joined = lookup_join(catalog, table, [tile])
    corrected = joined.withColumns(
        {c: (F.col(c) + F.col(offset)).cast(CATALOG_TYPES[c]) for c, offset in CORRECTIONS.items()}
    )
    return with_point_columns(corrected.select(*catalog.columns))


def dropped_tiles(catalog: DataFrame, offsets: DataFrame, tile: str = "tile") -> DataFrame:
    """Tiles with sources but without offsets, and the number of their sources."""
    counts = catalog.groupBy(tile).agg(F.count(F.lit(1)).alias("sources"))
    return counts.join(offsets.select(F.col("tile").alias(tile)), tile, "left_anti")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, each once, columns matched by name."""
    return reduce(DataFrame.unionByName, frames)


def union_tiles(frames: Iterable[DataFrame]) -> DataFrame:
    """One catalog from many tile frames, led by the position pair."""
    return with_point_columns(union_all(frames))
