"""Cover statistics, density, extents, geometry report and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions import geometry as geo
from almagest.functions.coords import mercator_ordinate, radius_degrees, shifted_lon
from almagest.functions.geohash import with_geohash


def cover_expansion(points: DataFrame, radius: float, index, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row: query points, rows after giving each distinct point its cells, and their ratio.

    The ratio is NULL without points.
    """
    zero = F.lit(0).cast("bigint")
    before = points.agg(F.count(F.lit(1)).alias("original_count"), zero.alias("new_count"))
    distinct = points.select(x, y).distinct().where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cover = index.explode_cover(distinct, F.lit(float(radius)), "cell", x, y)
    after = cover.agg(zero.alias("original_count"), F.count(F.lit(1)).alias("new_count"))
    totals = before.unionByName(after).agg(
        F.sum("original_count").alias("original_count"), F.sum("new_count").alias("new_count")
    )
    ratio = F.col("new_count") / F.nullif(F.col("original_count"), zero)
    return totals.withColumn("relative_diff", ratio)


def geometry_report(points: DataFrame, arcseconds: float, arcminutes: float = 0.0) -> DataFrame:
    """Search geometry per distinct query point, drawn at three times the radius."""
    radius = radius_degrees(arcminutes, arcseconds) * 3
    lon, lat = shifted_lon(F.col("ra").cast("double")), F.col("dec").cast("double")
    return points.select("ra", "dec").distinct().select(
        F.col("ra").alias("pointRa"),
        F.col("dec").alias("pointDec"),
        mercator_ordinate(F.lit(radius)).alias("degrees"),
        F.lit(float(arcseconds)).alias("arcseconds"),
        geo.buffer_area(radius).cast("string").alias("area"),
        geo.point_wkt(lon, lat).alias("point"),
        geo.ring_wkt(geo.buffer_ring(lon, lat, radius)).alias("geom"),
    )


def layer_extent(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """One row: bounding box and number of rows."""
    return df.agg(
        F.min(x).alias("min_x"),
        F.max(x).alias("max_x"),
        F.min(y).alias("min_y"),
        F.max(y).alias("max_y"),
        F.count(F.lit(1)).alias("rows"),
    )


def density(df: DataFrame, key: str) -> DataFrame:
    """Rows per cell or geohash, fullest first."""
    return df.groupBy(key).count().orderBy(F.desc("count"), F.asc(key))


def geohash_density(df: DataFrame, length: int = 9, x: str = "lon", y: str = "lat") -> DataFrame:
    return density(with_geohash(df.select(x, y), length, "geohash", x, y), "geohash")


def describe_points(df: DataFrame, columns: Sequence[str] = ("ra_point", "dec_point")) -> DataFrame:
    """Count, mean, standard deviation, least and greatest value of each column, one row each."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.mean(c).alias("mean"),
                F.stddev(c).alias("stddev"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*columns)))


def distinct_sources(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Equal rows merged; copies collapse in the tasks that read them, before the shuffle."""
    return df.dropDuplicates(list(columns) if columns else df.columns)


def bernoulli_sample(df: DataFrame, fraction: float = 0.5, seed: int | None = None) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Sample decided by the key's digest: the same rows on every run, plan and engine."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    limit = format(int(fraction * 16**8), "08x")
    if fraction == 1:
        return df
    return df.where(F.substring(F.md5(F.col(key).cast("string")), 1, 8) < limit)


def sample_one(df: DataFrame, key: str) -> DataFrame:
    """One row, chosen by digest; each task hands on a single candidate."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(1)


def respread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even partitions: a given number of them, or of a good size when left to adaptive execution."""
    return df.repartition(partitions) if partitions else df.hint("rebalance")
