"""A sky made of the given tables, as frames and as the same SQL.

Positions come from keys by integer arithmetic and one division, so every engine gets the same
doubles. ``field`` is a 2 x 2 degree patch at ra 150..152, dec -1..1; ``sphere`` is the whole sky.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.coords import with_lon_lat, with_point_columns
from almagest.schema import CATALOG_COLUMNS, typed_catalog

# Table, key column and the two key multipliers of each set of positions.
POSITIONS = {
    "orders": ("o_orderkey", 7919, 104729),
    "customer": ("c_custkey", 15485863, 32452843),
    "supplier": ("s_suppkey", 49979687, 67867967),
    "part": ("p_partkey", 86028121, 104395301),
}
# Tiles are the customer key modulo this; ``nation`` holds the offsets of all tiles but the last.
TILES = 25
# Text columns of the made catalog as (whole modulus, fraction modulus, digits).
TEXT_COLUMNS = {
    "sigra": (10, 9973, 4),
    "sigdec": (10, 9967, 4),
    "w1mag": (20, 97, 2),
    "w1sigm": (3, 89, 2),
    "w2mag": (19, 83, 2),
    "w2sigm": (4, 79, 2),
    "pmra": (7, 99991, 5),
    "pmdec": (5, 99989, 5),
    "sigpmra": (6, 9949, 4),
    "sigpmdec": (8, 9941, 4),
    "w1k": (30, 99971, 5),
    "w2k": (31, 99961, 5),
    "w1mlq": (50, 73, 2),
    "w2mlq": (51, 71, 2),
}


def _angles(table: str, whole_sky: bool) -> tuple[str, str, str]:
    """Key column and SQL for ra and dec, readable by both engines."""
    key, a, b = POSITIONS[table]
    if whole_sky:
        return key, f"(({key} * {a}) % 3600000) / 10000e0", f"(({key} * {b}) % 1800001) / 10000e0 - 90e0"
    return key, f"150 + (({key} * {a}) % 2000003) / 1000001e0", f"(({key} * {b}) % 2000003) / 1000001e0 - 1e0"


def positions(spark: SparkSession, sf_dir: str, table: str, name: str, whole_sky: bool = False) -> DataFrame:
    """``name`` (the key), ``ra``, ``dec``, ``lon``, ``lat`` of every row of a table."""
    key, ra, dec = _angles(table, whole_sky)
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return with_lon_lat(
        frame.select(F.col(key).alias(name), F.expr(ra).alias("ra"), F.expr(dec).alias("dec"))
    )


def positions_sql(table: str, name: str, whole_sky: bool = False) -> str:
    key, ra, dec = _angles(table, whole_sky)
    return (
        f'SELECT {name}, ra, "dec", ra - 180e0 AS lon, "dec" AS lat '
        f'FROM (SELECT {key} AS {name}, {ra} AS ra, {dec} AS "dec" FROM {table})'
    )


def sources(spark: SparkSession, sf_dir: str, whole_sky: bool = False) -> DataFrame:
    return positions(spark, sf_dir, "orders", "source_id", whole_sky)


def points(spark: SparkSession, sf_dir: str, whole_sky: bool = False) -> DataFrame:
    return positions(spark, sf_dir, "customer", "point_id", whole_sky)


def search_sql(select: str, where: str, tail: str = "", whole_sky: bool = False) -> str:
    """Brute force: every source ``c`` against every point ``p``."""
    return (
        f"WITH c AS ({positions_sql('orders', 'source_id', whole_sky)}), "
        f"p AS ({positions_sql('customer', 'point_id', whole_sky)}) "
        f"SELECT {select} FROM c, p WHERE {where} {tail}"
    )


def number(value: float) -> str:
    """A double in SQL, digit for digit."""
    return f"CAST('{value!r}' AS DOUBLE)"


DX, DY = "(c.lon - p.lon)", "(c.lat - p.lat)"


def disc_sql(radius: float, less: str = "<=") -> str:
    r = number(radius)
    return f"{DX} * {DX} + {DY} * {DY} {less} {r} * {r}"


def polygon_sql(radius: float) -> str:
    step = "(pi() / 16)"
    angle = f"atan2({DY}, {DX})"
    turn = f"({angle} - floor({angle} / {step}) * {step} - {step} / 2)"
    return f"sqrt({DX} * {DX} + {DY} * {DY}) * cos({turn}) <= {number(radius)} * cos({step} / 2)"


def _text_sql(column: str) -> str:
    """SQL of a text column, for both engines; some values are the token ``null``."""
    k = "o_orderkey"
    if column in ("w1flg", "w2flg"):
        n = 11 if column == "w1flg" else 17
        return f"CASE WHEN {k} % {n} = 0 THEN 'null' ELSE CAST({k} % 4 AS STRING) END"
    if column == "source_name":
        return f"concat('J', CAST({k} AS STRING))"
    if column == "source_id":
        return f"CAST({k} AS STRING)"
    whole, fraction, digits = TEXT_COLUMNS[column]
    value = f"concat(CAST({k} % {whole} AS STRING), '.', lpad(CAST({k} % {fraction} AS STRING), {digits}, '0'))"
    if column.startswith("pm"):
        value = f"CASE WHEN {k} % 2 = 0 THEN concat('-', {value}) ELSE {value} END"
    if column in ("w2mag", "w1k"):
        value = f"CASE WHEN {k} % 13 = 0 THEN 'null' ELSE {value} END"
    return value


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty catalog columns as text, as a tile file holds them, then ``tile``."""
    _, ra, dec = _angles("orders", False)
    angles = {"ra": F.expr(ra).cast("string"), "dec": F.expr(dec).cast("string")}
    columns = [(angles[c] if c in angles else F.expr(_text_sql(c))).alias(c) for c in CATALOG_COLUMNS]
    tile = (F.col("o_custkey") % TILES).cast("string").alias("tile")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*columns, tile)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed catalog, then ``tile``."""
    return typed_catalog(raw_catalog(spark, sf_dir), keep=["tile"])


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog led by its position pair: the input of the layouts."""
    return with_point_columns(catalog(spark, sf_dir).drop("tile"))


def catalog_sql() -> str:
    from almagest.schema import CATALOG_TYPES

    _, ra, dec = _angles("orders", False)
    parts = []
    for column, kind in CATALOG_TYPES.items():
        if column in ("ra", "dec"):
            parts.append(f'{ra if column == "ra" else dec} AS "{column}"')
        else:
            parts.append(f"TRY_CAST({_text_sql(column)} AS {kind}) AS {column}")
    return f"SELECT {', '.join(parts)}, CAST(o_custkey % {TILES} AS VARCHAR) AS tile FROM orders"


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset table of every tile but the last."""
    n = F.col("n_nationkey")
    return (
        spark.read.parquet(f"{sf_dir}/nation.parquet")
        .where(n < TILES - 1)
        .select(
            n.cast("string").alias("tile"),
            (n / 1e3).alias("offsetra_ta"),
            ((n - 12) / 1e6).alias("offsetra"),
            ((n - 7) / 1e6).alias("offsetdec"),
            F.expr("concat(CAST(n_nationkey % 3 AS STRING), '.00', CAST(100 + n_nationkey AS STRING))")
            .cast("decimal(15,5)")
            .alias("offsetpmra"),
            F.expr("concat('-0.00', CAST(200 + n_nationkey AS STRING))").cast("decimal(15,5)").alias("offsetpmdec"),
        )
    )


def offsets_sql() -> str:
    return (
        "SELECT CAST(n_nationkey AS VARCHAR) AS tile, n_nationkey / 1e3 AS offsetra_ta, "
        "(n_nationkey - 12) / 1e6 AS offsetra, (n_nationkey - 7) / 1e6 AS offsetdec, "
        "CAST(concat(CAST(n_nationkey % 3 AS VARCHAR), '.00', CAST(100 + n_nationkey AS VARCHAR)) AS DECIMAL(15,5)) "
        "AS offsetpmra, CAST(concat('-0.00', CAST(200 + n_nationkey AS VARCHAR)) AS DECIMAL(15,5)) AS offsetpmdec "
        f"FROM nation WHERE n_nationkey < {TILES - 1}"
    )
