"""Angles, longitude shift, and map projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sphere radius of the Web Mercator projection (m) and its usable latitude band.
MERCATOR_RADIUS = 6378137.0
MERCATOR_MAX_LAT = 85.06


def radius_degrees(arcminutes, arcseconds):
    """``arcminutes/60 + arcseconds/3600``; plain numbers or columns."""
    return arcminutes / 60.0 + arcseconds / 3600.0


def shifted_lon(ra: Column) -> Column:
    """Right ascension [0, 360) turned into x in [-180, 180); a rotation, not a wrap."""
    return ra - F.lit(180.0)


def with_lon_lat(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Add the plane position ``lon``, ``lat``. Casts first, so text columns work under ANSI rules."""
    return df.withColumns(
        {
            "lon": shifted_lon(F.col(ra).cast("double")),
            "lat": F.col(dec).cast("double"),
        }
    )


def with_point_columns(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Prepend ``ra_point`` and ``dec_point``, copies of the position columns."""
    return df.select(F.col(ra).alias("ra_point"), F.col(dec).alias("dec_point"), "*")


def sky_to_lon_lat(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Longitude and latitude with the sky frame taken as it is: ``lon_wgs84``, ``lat_wgs84``."""
    return df.withColumns(
        {
            "lon_wgs84": F.pmod(F.col(ra).cast("double"), F.lit(360.0)),
            "lat_wgs84": F.col(dec).cast("double"),
        }
    )


def parse_lon_lat(text: Column) -> Column:
    """Two leading numbers of ``"(lon, lat, ...)"`` as a ``lon``/``lat`` struct."""
    pattern = r"^\s*\(*\s*([^,()\s]+)\s*,\s*([^,()\s]+)"
    return F.struct(
        F.regexp_extract(text, pattern, 1).try_cast("double").alias("lon"),
        F.regexp_extract(text, pattern, 2).try_cast("double").alias("lat"),
    )


def mercator_band(lat: Column) -> Column:
    """Latitudes that Web Mercator can show."""
    return lat.between(-MERCATOR_MAX_LAT, MERCATOR_MAX_LAT)


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_ordinate(degrees: Column) -> Column:
    """``ln(tan d + sec d)``: Mercator ordinate of an angle on the unit sphere."""
    angle = F.radians(degrees)
    return F.log(F.tan(angle) + F.sec(angle))


def haversine_square(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """``sin^2(d/2)`` of the great-circle distance d; grows with d, so it compares without ``asin``."""
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    return half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon


def haversine_limit(radius: Column) -> Column:
    """``haversine_square`` at a distance of ``radius`` degrees; beyond 180 as at 180, where it is largest."""
    half = F.sin(F.radians(F.least(radius, F.lit(180.0))) / 2)
    return half * half
