"""Random points, radius sweeps and sweeps over several point sets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.coords import with_lon_lat
from almagest.functions.geometry import point_wkt
from almagest.operators.calibrate import union_all
from almagest.operators.match import count_matches

# The radii of the experiments, in arcseconds.
ARCSECONDS = (1, 2, 4, 8, 16, 32, 60)


def random_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Uniform points: ra in [0, 1), dec in [-90, 90), with their WKT text."""
    points = spark.range(n).select(
        F.col("id").alias("point_id"),
        F.rand(seed).alias("ra"),
        (F.rand(seed + 1) * 180 - 90).alias("dec"),
    )
    return points.withColumn("geometry", point_wkt(F.col("ra"), F.col("dec")))


def keyed_points(table: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A uniform point per row, fixed by the digest of its key: the same points on every run, plan and engine."""
    def uniform(part: str) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}{part}"), F.col(key).cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    points = table.select(F.col(key).alias("point_id"), uniform("a").alias("ra"), (uniform("b") * 180 - 90).alias("dec"))
    return points.withColumn("geometry", point_wkt(F.col("ra"), F.col("dec")))


def radius_sweep(
    catalog: DataFrame, points: DataFrame, arcseconds: Iterable[float] = ARCSECONDS, **options
) -> DataFrame:
    """Matches at each radius: ``arcseconds``, ``matches``."""
    counts = count_matches(catalog, points, [a / 3600.0 for a in arcseconds], **options)
    keys = [c for c in counts.columns if c not in ("radius", "matches")]
    return counts.select(*keys, F.round(F.col("radius") * 3600.0, 6).alias("arcseconds"), "matches")


def point_set_sweep(
    catalog: DataFrame,
    sets: Mapping[str, DataFrame],
    arcseconds: Iterable[float] = ARCSECONDS,
    **options,
) -> DataFrame:
    """``radius_sweep`` for several named sets of ``ra``, ``dec`` points in one job."""
    named = union_all(
        df.select("ra", "dec", F.lit(name).alias("set_name")) for name, df in sets.items()
    )
    return radius_sweep(catalog, with_lon_lat(named), arcseconds, by=["set_name"], **options)
