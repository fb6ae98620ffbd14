"""Typed schema of the sky catalog and the casts that apply it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Catalog columns in file order with their Spark SQL types.
CATALOG_TYPES: dict[str, str] = {
    "source_name": "string",
    "source_id": "string",
    "ra": "double",
    "dec": "double",
    "sigra": "decimal(13,4)",
    "sigdec": "decimal(13,4)",
    "w1mag": "decimal(10,2)",
    "w1sigm": "decimal(10,2)",
    "w1flg": "int",
    "w2mag": "decimal(10,2)",
    "w2sigm": "decimal(10,2)",
    "w2flg": "int",
    "pmra": "decimal(15,5)",
    "pmdec": "decimal(15,5)",
    "sigpmra": "decimal(13,4)",
    "sigpmdec": "decimal(13,4)",
    "w1k": "decimal(17,5)",
    "w2k": "decimal(17,5)",
    "w1mlq": "decimal(8,2)",
    "w2mlq": "decimal(8,2)",
}
# The per-tile offset table.
OFFSET_TYPES: dict[str, str] = {
    "tile": "string",
    "offsetra_ta": "double",
    "offsetra": "double",
    "offsetdec": "double",
    "offsetpmra": "decimal(15,5)",
    "offsetpmdec": "decimal(15,5)",
}
# Position columns that lead the primary layer.
POINT_TYPES: dict[str, str] = {"ra_point": "double", "dec_point": "double"}

CATALOG_COLUMNS = list(CATALOG_TYPES)
OFFSET_COLUMNS = list(OFFSET_TYPES)


def struct_of(types: Mapping[str, str]) -> T.StructType:
    """``StructType`` for a ``{name: type}`` mapping."""
    return T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in types.items()))


def string_struct(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def typed(df: DataFrame, types: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Select the mapped columns in order, cast; text that does not parse (``null``) becomes NULL.

    Columns named in ``keep`` follow unchanged.
    """
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()], *keep)


def typed_catalog(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return typed(df, CATALOG_TYPES, keep)


def typed_offsets(df: DataFrame) -> DataFrame:
    return typed(df, OFFSET_TYPES)


def named_by_position(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rename every column by position."""
    return df.toDF(*names)


def without_point_columns(df: DataFrame) -> DataFrame:
    """Catalog columns without the leading position pair."""
    return df.drop(*POINT_TYPES)


def as_strings(columns: Iterable[str]) -> list[Column]:
    """Each column cast to string under its own name."""
    return [F.col(c).cast("string").alias(c) for c in columns]
