"""Catalog work: files, types, corrections, layouts, cells, statistics and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions import geometry as geo
from almagest.functions.cells import PlaneGrid, SphereGrid
from almagest.functions.coords import parse_lon_lat, sky_to_lon_lat, with_point_columns
from almagest.functions.s2 import QUADRANT_AT, ORIENTATION_CHANGE, S2Cells, S2Covering, s2_parent, with_s2_cell
from almagest.functions.geohash import ALPHABET, with_geohash
from almagest.operators.calibrate import apply_offsets, dropped_tiles, union_tiles
from almagest.operators.match import cone_pairs
from almagest.operators.stats import (
    cover_expansion,
    density,
    describe_points,
    distinct_sources,
    geohash_density,
    geometry_report,
    hash_sample,
    layer_extent,
    respread,
    sample_one,
)
from almagest.plans.experiments import keyed_points
from almagest.plans.ingest import prepare_offsets, primary_catalog
from almagest.plans.layouts import (
    cell_layout,
    geohash_layout,
    hybrid_layout,
    plain_layout,
    projected_layout,
    write_cells,
    write_geohash,
    write_hybrid,
    write_plain,
)
from almagest.queries import sky
from almagest.schema import CATALOG_COLUMNS, CATALOG_TYPES, OFFSET_COLUMNS, OFFSET_TYPES, typed_catalog
from almagest.session import work_folder
from almagest.sources.tables import (
    add_tiles,
    attach_catalog,
    read_catalog_csv,
    read_csv,
    read_offsets_csv,
    read_tile_folders,
    tile_manifest,
    unfinished_tiles,
    write_by_tile,
    write_csv,
    write_small_csv,
    write_text_csv,
)
from almagest.sources.tiles import is_rejected, read_catalog_tiles, rejected_rows, renamed_file, tile_of

TYPES = {**CATALOG_TYPES, **OFFSET_TYPES, "ra_point": "double", "dec_point": "double"}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines print them alike."""
    decimals = {f.name for f in df.schema.fields if f.dataType.typeName() == "decimal"}
    return df.select(
        *[F.col(c).cast("double").alias(c) if c in decimals else F.col(c) for c in df.columns]
    )


def _plain_sql(columns: list[str], source: str) -> str:
    parts = [f'CAST("{c}" AS DOUBLE) AS "{c}"' if "decimal" in TYPES.get(c, "") else f'"{c}"' for c in columns]
    return f"SELECT {', '.join(parts)} FROM ({source})"


TILED = [*CATALOG_COLUMNS, "tile"]


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(typed_catalog(sky.raw_catalog(spark, sf_dir), keep=["tile"]))


def _tile_lines(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Text lines of tile files: a comment, lines of names, types, units and null marks, then the rows.

    Every other key has its columns in the opposite order, so that only a tile's own header can read it.
    """
    def head(order: list[str]) -> Column:
        lines = [[n.upper() for n in order], ["char" for _ in order], ["--" for _ in order], ["null" for _ in order]]
        return F.array(F.lit("\\ made tile"), *[F.lit("| " + " | ".join(line) + " |") for line in lines])

    turned = F.pmod(F.xxhash64(*keys), F.lit(2)) == 1
    orders = (names, names[::-1])
    forth, back = (F.concat(F.lit("  "), F.concat_ws("  ", *order)) for order in orders)
    rows = df.select(*keys, F.when(turned, back).otherwise(forth).alias("value"))
    tops = df.select(*keys).distinct()
    heads = tops.select(*keys, F.explode(F.when(turned, head(orders[1])).otherwise(head(orders[0]))).alias("value"))
    return rows.unionByName(heads)


def tile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog written as gzip tile text by Spark, and read back typed."""
    path = work_folder(spark, "tile-text")
    raw = sky.raw_catalog(spark, sf_dir)
    # Each tile is one task's, so each of its files begins in a task that also has the tile's header.
    lines = _tile_lines(raw, CATALOG_COLUMNS, ["tile"]).repartition("tile")
    lines.write.mode("overwrite").partitionBy("tile").option("compression", "gzip").text(path)
    read = read_catalog_tiles(spark, path, files="*.txt.gz", tile_pattern=r"tile=([^/]+)/")
    return _plain(read)


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile, output name and fate of a file per order: every fifth holds rejected sources."""
    key = F.col("o_orderkey")
    kind = F.when(key % 5 == 0, "_rej_opt1.tbl.gz").otherwise("_opt1.tbl.gz")
    path = F.concat(F.lit("file:/raw_tiles/"), F.lpad((key % 360).cast("string"), 4, "0"), F.lit("p000"), kind)
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", path.alias("path"))
    name = F.substring_index("path", "/", -1)
    return files.select("o_orderkey", tile_of(F.col("path")).alias("tile"), renamed_file(F.col("path"), "csv").alias("renamed"), is_rejected(name).alias("rejected"))


TILE_NAMES = (
    "SELECT o_orderkey, tile, concat(tile, CASE WHEN o_orderkey % 5 = 0 THEN '_rej' ELSE '' END, '_opt1.csv') AS renamed, o_orderkey % 5 = 0 AS rejected "
    "FROM (SELECT o_orderkey, concat(lpad(CAST(o_orderkey % 360 AS VARCHAR), 4, '0'), 'p000') AS tile FROM orders)"
)


def offset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset table from tile text to CSV with header, and read back typed."""
    text, csv = work_folder(spark, "offset-text"), work_folder(spark, "offset-csv")
    lines = _tile_lines(sky.offsets(spark, sf_dir).withColumn("part", F.lit(0)), OFFSET_COLUMNS, ["part"])
    lines.drop("part").coalesce(1).write.mode("overwrite").text(text)
    prepare_offsets(spark, text, csv, files="*.txt")
    return _plain(read_offsets_csv(spark, csv))


# Every so many keys a row of the tiles has a field less, a field more, or a position that is no number.
SHORT, LONG, BROKEN = 97, 89, 83
HEAD_LINES = 5


def _damaged_tiles(spark: SparkSession, sf_dir: str) -> str:
    """Tile text with rows that do not fit their header, each tile one file in order of the keys."""
    path = work_folder(spark, "ragged")
    key = F.col("source_id").cast("bigint")
    raw = sky.raw_catalog(spark, sf_dir).withColumn("dec", F.when(key % BROKEN == 0, "n/a").otherwise(F.col("dec")))
    fields = F.array(*CATALOG_COLUMNS)
    kept = F.when(key % SHORT == 0, F.slice(fields, 1, len(CATALOG_COLUMNS) - 1)).when(key % LONG == 0, F.concat(fields, F.array(F.lit("9")))).otherwise(fields)
    rows = raw.select("tile", key.alias("place"), F.array_join(kept, " ").alias("value"))
    names = [[n.upper() for n in CATALOG_COLUMNS], ["char"] * 20, ["--"] * 20, ["null"] * 20]
    head = ["\\ made tile", *["| " + " | ".join(line) + " |" for line in names]]
    heads = raw.select("tile").distinct().select("tile", F.posexplode(F.array(*[F.lit(line) for line in head])).alias("place", "value"))
    lines = heads.select("tile", (F.col("place") - HEAD_LINES).cast("bigint").alias("place"), "value").unionByName(rows)
    # Many more partitions than tiles, so that few tasks have two of them.
    ordered = lines.repartition(8 * sky.TILES, "tile").sortWithinPartitions("tile", "place").select("tile", "value")
    ordered.write.mode("overwrite").partitionBy("tile").text(path)
    return path


TILE_FOLDER = r"tile=([^/]+)/"


def tile_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of which tiles cannot be read as they stand, and why."""
    found = rejected_rows(spark, _damaged_tiles(spark, sf_dir), CATALOG_TYPES, files="*.txt")
    return found.select(
        tile_of(F.col("file_path"), TILE_FOLDER).alias("tile"), "line", "reason", F.split("value", " ")[1].cast("bigint").alias("source_id")
    )


def tile_rejects_sql() -> str:
    k = "o_orderkey"
    reason = f"CASE WHEN {k} % {SHORT} = 0 THEN 'too few fields' WHEN {k} % {LONG} = 0 THEN 'too many fields' WHEN {k} % {BROKEN} = 0 THEN 'dec does not parse' END"
    line = f"row_number() OVER (PARTITION BY o_custkey % {sky.TILES} ORDER BY {k}) + {HEAD_LINES}"
    return (
        f"SELECT * FROM (SELECT CAST(o_custkey % {sky.TILES} AS VARCHAR) AS tile, {line} AS line, {reason} AS reason, {k} AS source_id FROM orders) "
        "WHERE reason IS NOT NULL"
    )


def tile_whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tiles without their ragged rows; a position that is no number is NULL."""
    path = _damaged_tiles(spark, sf_dir)
    return _plain(read_catalog_tiles(spark, path, files="*.txt", tile_pattern=TILE_FOLDER, ragged="reject"))


def tile_whole_rows_sql() -> str:
    columns = [f'CASE WHEN CAST(source_id AS BIGINT) % {BROKEN} <> 0 THEN "dec" END AS "dec"' if c == "dec" else f'"{c}"' for c in TILED]
    return _plain_sql(
        TILED, f"SELECT {', '.join(columns)} FROM ({sky.catalog_sql()}) WHERE CAST(source_id AS BIGINT) % {SHORT} <> 0 AND CAST(source_id AS BIGINT) % {LONG} <> 0"
    )


def _batched_tiles(spark: SparkSession, sf_dir: str) -> str:
    """Tiles written in two batches, the second first with wrong rows, then again."""
    path = work_folder(spark, "batches")
    catalog = sky.catalog(spark, sf_dir)
    odd = F.col("tile").cast("int") % 2 == 1
    # What an earlier run of this query left is replaced as well: no tile is ever doubled.
    add_tiles(catalog.where(~odd), path)
    add_tiles(catalog.where(odd).withColumn("w1flg", F.lit(99)), path)
    for _ in range(2):
        add_tiles(catalog.where(odd), path)
    return path


def tile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(read_tile_folders(spark, _batched_tiles(spark, sf_dir)))


def tile_batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and their sources by the manifest, and whether the rows are those it was written for."""
    path = _batched_tiles(spark, sf_dir)
    wrong = unfinished_tiles(spark, path).withColumn("wrong", F.lit(True))
    return tile_manifest(spark, path).join(wrong, "tile", "left").select("tile", "sources", F.col("wrong").isNull().alias("finished"))


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile text and offset CSV to the corrected primary catalog."""
    path, csv = work_folder(spark, "raw"), work_folder(spark, "offsets")
    lines = _tile_lines(sky.raw_catalog(spark, sf_dir), CATALOG_COLUMNS, ["tile"]).repartition("tile")
    lines.write.mode("overwrite").partitionBy("tile").text(path)
    write_small_csv(sky.offsets(spark, sf_dir), csv)
    return _plain(primary_catalog(spark, path, csv, files="*.txt", tile_pattern=r"tile=([^/]+)/"))


def tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(apply_offsets(sky.catalog(spark, sf_dir), sky.offsets(spark, sf_dir)))


def tile_offsets_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset table that has some tiles twice: each source comes out once, with the least row of its tile."""
    offsets = sky.offsets(spark, sf_dir)
    moved = offsets.where(F.col("tile").cast("int") % 3 == 0).withColumn("offsetra", F.col("offsetra") + 1)
    same = offsets.where(F.col("tile").cast("int") % 3 == 1)
    return _plain(apply_offsets(sky.catalog(spark, sf_dir), moved.unionByName(offsets).unionByName(same), repeated="least"))


PRIMARY = ["ra_point", "dec_point", *TILED]


def _corrected_sql() -> str:
    moved = {"ra": "offsetra", "dec": "offsetdec", "pmra": "offsetpmra", "pmdec": "offsetpmdec"}
    columns = [f'c."{c}" + o.{moved[c]} AS "{c}"' if c in moved else f'c."{c}"' for c in TILED]
    joined = (
        f"SELECT {', '.join(columns)} FROM ({sky.catalog_sql()}) c JOIN ({sky.offsets_sql()}) o ON c.tile = o.tile"
    )
    return _plain_sql(PRIMARY, f'SELECT ra AS ra_point, "dec" AS dec_point, * FROM ({joined})')


def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_tiles(sky.catalog(spark, sf_dir), sky.offsets(spark, sf_dir))


UNITED = ["orders", "customer", "supplier", "part"]


def tile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_tiles(
        sky.positions(spark, sf_dir, table, "id").select("id", "ra", "dec", F.lit(table).alias("origin"))
        for table in UNITED
    )


def tile_union_sql() -> str:
    return " UNION ALL ".join(
        f'SELECT ra AS ra_point, "dec" AS dec_point, id, ra, "dec", \'{table}\' AS origin '
        f"FROM ({sky.positions_sql(table, 'id')})"
        for table in UNITED
    )


def catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless CSV out and in: rows once typed, then all as text with the leading position pair."""
    first, second = work_folder(spark, "csv"), work_folder(spark, "csv-text")
    write_csv(sky.catalog(spark, sf_dir).drop("tile"), first, mode="overwrite")
    write_text_csv(with_point_columns(read_catalog_csv(spark, first)), second)
    return _plain(read_csv(spark, second, {"ra_point": "double", "dec_point": "double", **CATALOG_TYPES}))


def tile_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Parquet folder per tile, read back whole."""
    path = work_folder(spark, "tiles")
    write_by_tile(sky.catalog(spark, sf_dir), path)
    return _plain(attach_catalog(spark, path).withColumn("tile", F.col("tile").cast("string")))


LAID_OUT = [*CATALOG_COLUMNS, "lon", "lat"]


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "plain")
    write_plain(plain_layout(sky.primary(spark, sf_dir)), path)
    return _plain(attach_catalog(spark, path, view="sky_catalog")).select(*LAID_OUT)


def _laid_out_sql() -> str:
    return f'SELECT * EXCLUDE (tile), ra - 180e0 AS lon, "dec" AS lat FROM ({sky.catalog_sql()})'


def geohash_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geohash layout read back: rows in range order per file, so neighbours share files."""
    path = work_folder(spark, "geohash")
    write_geohash(geohash_layout(sky.primary(spark, sf_dir)), path)
    place = geo.parse_point_wkt(F.col("geom"))
    return attach_catalog(spark, path).select(
        "source_id", "geohash", place["lon"].alias("lon"), place["lat"].alias("lat")
    )


def sphere_geohash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_geohash(sky.sources(spark, sf_dir, True)).select("source_id", "geohash")


def geohash_sql(select: str, source: str, length: int) -> str:
    """Bit by bit: the k-th bit of the text is taken from longitude and latitude in turn."""
    x_bits, y_bits = (5 * length + 1) // 2, 5 * length // 2
    quantised = (
        f"SELECT *, least(CAST(floor((lon + 180) / 360 * {1 << x_bits}) AS BIGINT), {(1 << x_bits) - 1}) AS gx, "
        f"least(CAST(floor((lat + 90) / 180 * {1 << y_bits}) AS BIGINT), {(1 << y_bits) - 1}) AS gy FROM ({source})"
    )
    chars = []
    for n in range(length):
        bits = []
        for k in range(5 * n, 5 * n + 5):
            axis, width = ("gx", x_bits) if k % 2 == 0 else ("gy", y_bits)
            bits.append(f"(({axis} >> {width - 1 - k // 2}) & 1) * {1 << (4 - k % 5)}")
        chars.append(f"substr('{ALPHABET}', CAST(1 + {' + '.join(bits)} AS INTEGER), 1)")
    return f"SELECT {select} FROM (SELECT *, concat({', '.join(chars)}) AS geohash FROM ({quantised}))"


def s2_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = with_s2_cell(sky.sources(spark, sf_dir, True), 9)
    return located.select("source_id", "cell_id", s2_parent(F.col("cell_id"), 4).alias("partition_id"))


def s2_sql(level: int, source: str) -> str:
    """Face, face coordinates, cell coordinates, then one curve step per level."""
    xyz = (
        "SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, "
        f"sin(radians(lat)) AS z FROM ({source})"
    )
    face = (
        "SELECT *, axis + CASE WHEN (CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) < 0 THEN 3 ELSE 0 END AS face "
        "FROM (SELECT *, CASE WHEN abs(x) > abs(y) AND abs(x) > abs(z) THEN 0 "
        f"WHEN abs(y) >= abs(x) AND abs(y) > abs(z) THEN 1 ELSE 2 END AS axis FROM ({xyz}))"
    )
    uv = (
        "SELECT *, CASE face WHEN 0 THEN y/x WHEN 1 THEN -x/y WHEN 2 THEN -x/z WHEN 3 THEN z/x WHEN 4 THEN z/y "
        "ELSE -y/z END AS u, CASE face WHEN 0 THEN z/x WHEN 1 THEN z/y WHEN 2 THEN -y/z WHEN 3 THEN y/x "
        f"WHEN 4 THEN -x/y ELSE -x/z END AS v FROM ({face})"
    )

    def index(c: str) -> str:
        unit = f"CASE WHEN {c} >= 0 THEN 0.5e0 * sqrt(1 + 3 * {c}) ELSE 1 - 0.5e0 * sqrt(1 - 3 * {c}) END"
        return f"least(greatest(CAST(floor(({unit}) * {1 << level}) AS BIGINT), 0), {(1 << level) - 1})"

    step = f"SELECT *, face & 1 AS o, CAST(face AS HUGEINT) AS r FROM (SELECT *, {index('u')} AS i, {index('v')} AS j FROM ({uv}))"
    inverse = [[row.index(ij) for ij in range(4)] for row in QUADRANT_AT]
    for k in reversed(range(level)):
        pos = f"{inverse}[o + 1][2 * ((i >> {k}) & 1) + ((j >> {k}) & 1) + 1]"
        step = (
            f"SELECT * EXCLUDE (o, r, pos), xor(o, {ORIENTATION_CHANGE}[pos + 1]) AS o, r * 4 + pos AS r "
            f"FROM (SELECT *, {pos} AS pos FROM ({step}))"
        )
    whole = f"(r * {1 << (61 - 2 * level)} + {1 << (60 - 2 * level)})"
    signed = f"CAST(CASE WHEN {whole} >= 9223372036854775808 THEN {whole} - 18446744073709551616 ELSE {whole} END AS BIGINT)"
    return f"SELECT * EXCLUDE (x, y, z, axis, u, v, o, r), {signed} AS cell_id FROM ({step})"


def s2_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources per level-4 cell, read from a written cell layout."""
    path = work_folder(spark, "cells")
    primary = with_point_columns(
        typed_catalog(sky.raw_catalog(spark, sf_dir)).drop("ra", "dec").withColumns(
            {"ra": F.expr("((bigint(source_id) * 7919) % 3600000) / 10000e0"),
             "dec": F.expr("((bigint(source_id) * 104729) % 1800001) / 10000e0 - 90e0")}
        ).select(*CATALOG_COLUMNS)
    )
    write_cells(cell_layout(primary, 4), path)
    return density(attach_catalog(spark, path), "cell_id")


def hybrid_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of a catalog held twice, per coarse cell of the written hybrid layout."""
    path = work_folder(spark, "hybrid")
    primary = sky.primary(spark, sf_dir)
    write_hybrid(hybrid_layout(primary.unionByName(primary)), path)
    return attach_catalog(spark, path).groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("sources"), F.countDistinct("cell_id").alias("cells")
    )


# A folder of this many sources at most, where the deepest level lets it.
DENSE_ROWS = 400
DENSE = {"coarse": 2, "deepest": 5, "folder_rows": DENSE_ROWS}


def density_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that follow density: cells of levels 2 to 5, each as large as its number of sources lets it be."""
    path = work_folder(spark, "density")
    # Half the sources in a sixtieth of the sky.
    primary = _skewed_primary(spark, sf_dir)
    write_hybrid(hybrid_layout(primary.unionByName(primary), **DENSE), path)
    return attach_catalog(spark, path).groupBy("partition_id").agg(
        F.count(F.lit(1)).alias("sources"), F.countDistinct("cell_id").alias("cells")
    )


def _skewed_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("source_id").cast("bigint")
    ra = F.when(key % 2 == 0, F.expr("((bigint(source_id) * 7919) % 3600000) / 10000e0")).otherwise(F.expr("((bigint(source_id) * 7919) % 600000) / 10000e0"))
    dec = F.when(key % 2 == 0, F.expr("((bigint(source_id) * 104729) % 1800001) / 10000e0 - 90e0")).otherwise(F.expr("((bigint(source_id) * 104729) % 180001) / 10000e0"))
    moved = typed_catalog(sky.raw_catalog(spark, sf_dir)).withColumns({"ra": ra, "dec": dec})
    return with_point_columns(moved.select(*CATALOG_COLUMNS))


def skewed_sql() -> str:
    near = "o_orderkey % 2 = 0"
    return (
        "SELECT source_id, ra - 180e0 AS lon, \"dec\" AS lat FROM (SELECT o_orderkey AS source_id, "
        f"CASE WHEN {near} THEN ((o_orderkey * 7919) % 3600000) / 10000e0 ELSE ((o_orderkey * 7919) % 600000) / 10000e0 END AS ra, "
        f"CASE WHEN {near} THEN ((o_orderkey * 104729) % 1800001) / 10000e0 - 90e0 ELSE ((o_orderkey * 104729) % 180001) / 10000e0 END AS \"dec\" FROM orders)"
    )


def density_folders_sql() -> str:
    parent = lambda level: f"((cell_id & {-(2 << (60 - 2 * level))}) | {1 << (60 - 2 * level)})"
    # Every source is held twice, and counted so, until equal rows merge.
    counts = ", ".join(f"2 * count(*) OVER (PARTITION BY {parent(n)}) AS n{n}" for n in range(2, 5))
    folder = " ".join(f"WHEN n{n} <= {DENSE_ROWS} THEN {parent(n)}" for n in range(2, 5))
    return (
        f"SELECT partition_id, count(*) AS sources, count(DISTINCT cell_id) AS cells FROM (SELECT cell_id, CASE {folder} ELSE {parent(5)} END AS partition_id "
        f"FROM (SELECT cell_id, {counts} FROM ({s2_sql(9, skewed_sql())}))) GROUP BY partition_id"
    )


def density_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches over folders of several levels; the circles are wider than some folders and smaller than others."""
    path = work_folder(spark, "density-search")
    write_hybrid(hybrid_layout(_skewed_primary(spark, sf_dir), **DENSE), path)
    pairs = cone_pairs(attach_catalog(spark, path), sky.points(spark, sf_dir, True), 1.5)
    return pairs.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("query_point_id").alias("point_id"))


def density_search_sql() -> str:
    return (
        f"WITH c AS ({skewed_sql()}), p AS ({sky.positions_sql('customer', 'point_id', True)}) "
        f"SELECT c.source_id, p.point_id FROM c, p WHERE {sky.disc_sql(1.5)}"
    )


def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = projected_layout(sky.sources(spark, sf_dir, True))
    return layer.select("source_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cover_expansion(sky.points(spark, sf_dir), 60 / 3600.0, PlaneGrid(0.05))
    return stats.withColumn("relative_diff", F.round("relative_diff", 9))


def expansion_sql() -> str:
    r = "(CAST('0.016666666666666666' AS DOUBLE) * (1 + 1e-9) + 1e-12)"
    spans = [
        f"(floor(({c} + {r}) / 0.05e0) - floor(({c} - {r}) / 0.05e0) + 1)" for c in ("lon", "lat")
    ]
    return (
        "SELECT n AS original_count, m AS new_count, round(CAST(m AS DOUBLE) / n, 9) AS relative_diff FROM "
        f"(SELECT count(*) AS n FROM ({sky.positions_sql('customer', 'point_id')})), "
        f"(SELECT CAST(sum({spans[0]} * {spans[1]}) AS BIGINT) AS m "
        f"FROM (SELECT DISTINCT lon, lat FROM ({sky.positions_sql('customer', 'point_id')})))"
    )


def s2_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cover_expansion(sky.points(spark, sf_dir, True), 1.0, S2Cells(4))
    return stats.withColumn("relative_diff", F.round("relative_diff", 9))


def s2_expansion_sql() -> str:
    """Every cell of the level against every point: nearest point of the cell by its edges and corners."""
    size, sin = 16, "sin(radians(1e0 * (1 + 1e-9) + 1e-12))"

    def face_coordinate(s: str) -> str:
        return f"CASE WHEN {s} >= 0.5 THEN (4 * {s} * {s} - 1) / 3 ELSE (1 - 4 * (1 - {s}) * (1 - {s})) / 3 END"

    bounds = ", ".join(
        f"{face_coordinate(f'(({k}) / {size}e0)')} AS {name}"
        for name, k in (("u0", "i"), ("u1", "i + 1"), ("v0", "j"), ("v1", "j + 1"))
    )
    cells = (
        f"SELECT face, {bounds} FROM (SELECT unnest(range(6)) AS face), (SELECT unnest(range({size})) AS i), "
        f"(SELECT unnest(range({size})) AS j)"
    )
    points = (
        "SELECT point_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, "
        f"sin(radians(lat)) AS z FROM ({sky.positions_sql('customer', 'point_id', True)})"
    )
    axes = {"n": "x,y,z,-x,-y,-z", "p": "y,-x,-x,-z,-z,y", "q": "z,z,-y,-y,x,x"}
    parts = ", ".join(f"([{values}])[face + 1] AS {name}" for name, values in axes.items())
    tests = ["n > 0 AND p / n BETWEEN u0 AND u1 AND q / n BETWEEN v0 AND v1"]
    for own, other, lines, ends in (("p", "q", ("u0", "u1"), ("v0", "v1")), ("q", "p", ("v0", "v1"), ("u0", "u1"))):
        for line in lines:
            foot = f"((n + {line} * {own}) / (1 + {line} * {line}))"
            tests.append(
                f"abs({own} - {line} * n) / sqrt(1 + {line} * {line}) <= {sin} AND {foot} > 0 "
                f"AND {other} / {foot} BETWEEN {ends[0]} AND {ends[1]}"
            )
    for a in ("u0", "u1"):
        for b in ("v0", "v1"):
            dot = f"((n + {a} * p + {b} * q) / sqrt(1 + {a} * {a} + {b} * {b}))"
            tests.append(f"acos(least(1e0, {dot})) <= radians(1e0 * (1 + 1e-9) + 1e-12)")
    return (
        f"WITH m AS (SELECT count(*) AS m FROM (SELECT *, {parts} FROM ({cells}), ({points})) "
        f"WHERE ({') OR ('.join(tests)})), n AS (SELECT count(*) AS n FROM customer) "
        "SELECT n AS original_count, m AS new_count, round(CAST(m AS DOUBLE) / n, 9) AS relative_diff FROM n, m"
    )


MIXED = S2Covering((4, 5), steps=1)


def mixed_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover statistics of cells of two levels: whole ones of level 4 inside a circle, those of level 5 at its rim."""
    stats = cover_expansion(sky.points(spark, sf_dir, True), MIXED_RADIUS, MIXED)
    return stats.withColumn("relative_diff", F.round("relative_diff", 9))


MIXED_RADIUS = 1.5


def mixed_expansion_sql() -> str:
    """Every cell of level 4 against every point, and those not inside the circle again as their four parts."""
    sin = f"sin(radians({MIXED_RADIUS}e0 * (1 + 1e-9) + 1e-12))"
    limit = f"radians({MIXED_RADIUS}e0 * (1 + 1e-9) + 1e-12)"

    def face_coordinate(s: str) -> str:
        return f"CASE WHEN {s} >= 0.5 THEN (4 * {s} * {s} - 1) / 3 ELSE (1 - 4 * (1 - {s}) * (1 - {s})) / 3 END"

    def bounds(size: int) -> str:
        ends = (("u0", "i"), ("u1", "i + 1"), ("v0", "j"), ("v1", "j + 1"))
        return ", ".join(f"{face_coordinate(f'(({k}) / {size}e0)')} AS {name}" for name, k in ends)

    corners = [f"acos(least(1e0, (n + {a} * p + {b} * q) / sqrt(1 + {a} * {a} + {b} * {b}))) <= {limit}" for a in ("u0", "u1") for b in ("v0", "v1")]
    tests = ["n > 0 AND p / n BETWEEN u0 AND u1 AND q / n BETWEEN v0 AND v1", *corners]
    for own, other, lines, ends in (("p", "q", ("u0", "u1"), ("v0", "v1")), ("q", "p", ("v0", "v1"), ("u0", "u1"))):
        for line in lines:
            foot = f"((n + {line} * {own}) / (1 + {line} * {line}))"
            tests.append(
                f"abs({own} - {line} * n) / sqrt(1 + {line} * {line}) <= {sin} AND {foot} > 0 AND {other} / {foot} BETWEEN {ends[0]} AND {ends[1]}"
            )
    meets = f"({') OR ('.join(tests)})"
    axes = {"n": "x,y,z,-x,-y,-z", "p": "y,-x,-x,-z,-z,y", "q": "z,z,-y,-y,x,x"}
    points = (
        "SELECT point_id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, "
        f"sin(radians(lat)) AS z FROM (SELECT DISTINCT ON (lon, lat) * FROM ({sky.positions_sql('customer', 'point_id', True)}))"
    )
    faces = f"SELECT point_id, face, {', '.join(f'([{values}])[face + 1] AS {name}' for name, values in axes.items())} FROM ({points}), (SELECT unnest(range(6)) AS face)"
    # A cell of level 4 is met only on faces that the point's direction comes near.
    large = f"SELECT *, {bounds(16)} FROM ({faces}), (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j)"
    met = f"SELECT point_id, face, n, p, q, i, j, {' AND '.join(corners)} AS inside FROM ({large}) WHERE {meets}"
    small = (
        f"SELECT *, {bounds(32)} FROM (SELECT point_id, face, n, p, q, 2 * i + a AS i, 2 * j + b AS j FROM m, (SELECT unnest(range(2)) AS a), "
        "(SELECT unnest(range(2)) AS b) WHERE NOT inside)"
    )
    return (
        f"WITH m AS ({met}), s AS (SELECT count(*) AS k FROM ({small}) WHERE {meets}), l AS (SELECT count(*) AS k FROM m WHERE inside), "
        "n AS (SELECT count(*) AS n FROM customer) "
        "SELECT n AS original_count, l.k + s.k AS new_count, round(CAST(l.k + s.k AS DOUBLE) / n, 9) AS relative_diff FROM n, l, s"
    )


def sphere_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover statistics of the zone grid that serves the great-circle search."""
    stats = cover_expansion(sky.points(spark, sf_dir, True), 1.0, SphereGrid(2.0))
    return stats.withColumn("relative_diff", F.round("relative_diff", 9))


def sphere_cover_sql() -> str:
    """Zones a circle touches, and per zone the bins within its half-width or all of them."""
    r = "(1e0 * (1 + 1e-9) + 1e-12)"
    turn = "((ra % 360e0) / 360e0)"
    zones = (
        f"SELECT ra, lat, unnest(range(CAST(greatest(floor((lat - {r} + 90) / 2), 0) AS BIGINT), "
        f"CAST(least(floor((lat + {r} + 90) / 2), 89) AS BIGINT) + 1)) AS zone "
        f"FROM (SELECT DISTINCT ra, lat FROM ({sky.positions_sql('customer', 'point_id', True)}))"
    )
    bins = (
        "SELECT *, greatest(floor(cos(radians(least(greatest(abs(zone * 2 - 90), abs(zone * 2 - 88)), 90))) * 180), 1) "
        f"AS bins, CASE WHEN abs(lat) + {r} < 90 THEN asin(least(sin(radians({r})) / cos(radians(lat)), 1)) / (2 * pi()) "
        f"ELSE 0.5e0 END * (1 + 1e-9) + 1e-12 AS half FROM ({zones})"
    )
    spans = f"floor(({turn} + half) * bins) - floor(({turn} - half) * bins) + 1"
    return (
        "SELECT n AS original_count, m AS new_count, round(CAST(m AS DOUBLE) / n, 9) AS relative_diff FROM "
        "(SELECT count(*) AS n FROM customer), "
        f"(SELECT CAST(sum(least({spans}, bins)) AS BIGINT) AS m FROM ({bins}))"
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry report with its texts read back as rounded numbers."""
    found = geometry_report(sky.points(spark, sf_dir), 60.0)
    place = geo.parse_point_wkt(F.col("point"))
    corners = F.split(F.regexp_extract("geom", r"\(\(([^)]*)\)\)", 1), ", ")
    pairs = F.transform(corners, lambda c: F.split(c, " "))
    vertices = F.transform("pairs", lambda c: geo.point(c[0].cast("double"), c[1].cast("double")))
    ring = F.col("ring")
    return found.withColumn("pairs", pairs).withColumn("ring", vertices).select(
        "pointRa",
        "pointDec",
        F.round("degrees", 9).alias("degrees"),
        "arcseconds",
        F.round(F.col("area").cast("double"), 12).alias("area"),
        F.round(geo.ring_area(ring), 9).alias("ring_area"),
        F.size(ring).cast("bigint").alias("ring_points"),
        F.round(ring[4]["lat"], 9).alias("vertex_lat"),
        place["lon"].alias("lon"),
        place["lat"].alias("lat"),
    )


def report_sql() -> str:
    d = "CAST('0.05' AS DOUBLE)"
    area = f"16 * {d} * {d} * sin(pi() / 16)"
    return (
        f'SELECT ra AS "pointRa", "dec" AS "pointDec", '
        f"round(ln(tan(radians({d})) + 1 / cos(radians({d}))), 9) AS degrees, 60e0 AS arcseconds, "
        f"round({area}, 12) AS area, round({area}, 9) AS ring_area, CAST(33 AS BIGINT) AS ring_points, "
        f"round(lat + {d} * sin(pi() / 4), 9) AS vertex_lat, lon, lat "
        f"FROM (SELECT DISTINCT ra, \"dec\", lon, lat FROM ({sky.positions_sql('customer', 'point_id')}))"
    )


def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer_extent(sky.sources(spark, sf_dir))


def point_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = describe_points(sky.primary(spark, sf_dir))
    return summary.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


def point_summary_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, max({c}) AS max "
        f"FROM ({sky.positions_sql('orders', 'source_id')})"
        for name, c in (("ra_point", "ra"), ("dec_point", "lat"))
    )


def dedup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on a coarse raster, where repeats are many."""
    points = sky.points(spark, sf_dir)
    raster = points.select(*[(F.floor(F.col(c) * 10) / 10).alias(c) for c in ("lon", "lat")])
    return distinct_sources(raster)


def dedup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = sky.catalog(spark, sf_dir)
    return _plain(distinct_sources(respread(catalog.unionByName(catalog), 16)))


def digest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_sample(sky.sources(spark, sf_dir).select("source_id", "lon", "lat"), "source_id", 0.5)


def digest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_one(sky.points(spark, sf_dir).select("point_id", "lon", "lat"), "point_id")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a Bernoulli half: rows of the catalog, none twice, the same for one seed, a share near a half."""
    primary = sky.primary(spark, sf_dir)
    taken, again = (geohash_layout(primary, fraction=0.5, seed=10).select("source_id", "geohash") for _ in range(2))
    every = geohash_layout(primary).select("source_id", "geohash")
    marks = F.count_if("taken").alias("n"), F.count_if("again").alias("m"), F.count_if("listed").alias("all")
    side = lambda df, name: df.select("source_id", "geohash", *[F.lit(name == c).alias(c) for c in ("taken", "again", "listed")])
    rows = side(taken, "taken").unionByName(side(again, "again")).unionByName(side(every, "listed"))
    each = rows.groupBy("source_id", "geohash").agg(*marks)
    share = F.sum("n") / F.sum("all")
    return each.agg(
        F.count_if(F.col("n") > F.col("all")).alias("strangers_or_repeats"), F.count_if(F.col("n") != F.col("m")).alias("changed"),
        F.sum("all").alias("sources"), share.between(0.45, 0.55).alias("near_half"),
    )


def random_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random point per customer, by the digest of its key, through its text form."""
    place = geo.parse_point_wkt(F.col("geometry"))
    points = keyed_points(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", seed=7)
    return points.select("point_id", place["lon"].alias("ra"), place["lat"].alias("dec"))


def random_sky_sql() -> str:
    part = "CAST(('0x' || substr(md5(concat('7{0}', CAST(c_custkey AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296e0"
    return f'SELECT c_custkey AS point_id, {part.format("a")} AS ra, {part.format("b")} * 180 - 90 AS "dec" FROM customer'


def sky_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky frame taken as longitude and latitude, by column and through its text form."""
    frame = sky_to_lon_lat(sky.sources(spark, sf_dir, True))
    text = F.concat(
        F.lit("("), F.col("lon_wgs84").cast("string"), F.lit(", "), F.col("lat_wgs84").cast("string"), F.lit(", 0.) deg")
    )
    place = parse_lon_lat(text)
    return frame.select(
        "source_id", "lon_wgs84", "lat_wgs84", place["lon"].alias("lon"), place["lat"].alias("lat")
    )


_field = sky.positions_sql("orders", "source_id")
_sphere = sky.positions_sql("orders", "source_id", True)

QUERIES = {
    "tile_names": (tile_names, TILE_NAMES),
    "typed_catalog": (typed, _plain_sql(TILED, sky.catalog_sql())),
    "tile_text": (tile_text, _plain_sql(TILED, sky.catalog_sql())),
    "tile_rejects": (tile_rejects, tile_rejects_sql()),
    "tile_whole_rows": (tile_whole_rows, tile_whole_rows_sql()),
    "tile_batches": (tile_batches, _plain_sql(TILED, sky.catalog_sql())),
    "tile_batch_manifest": (tile_batch_manifest, f"SELECT tile, count(*) AS sources, true AS finished FROM ({sky.catalog_sql()}) GROUP BY tile"),
    "tile_offsets_repeated": (tile_offsets_repeated, _corrected_sql()),
    "density_folders": (density_folders, density_folders_sql()),
    "density_search": (density_search, density_search_sql()),
    "cover_expansion_mixed": (mixed_expansion, mixed_expansion_sql()),
    "offset_text": (offset_text, _plain_sql(OFFSET_COLUMNS, sky.offsets_sql())),
    "ingest": (ingest, _corrected_sql()),
    "tile_offsets": (tile_offsets, _corrected_sql()),
    "dropped_tiles": (
        missing_tiles,
        f"SELECT tile, count(*) AS sources FROM ({sky.catalog_sql()}) WHERE tile NOT IN "
        f"(SELECT tile FROM ({sky.offsets_sql()})) GROUP BY tile",
    ),
    "tile_union": (tile_union, tile_union_sql()),
    "catalog_csv": (
        catalog_csv,
        _plain_sql(
            ["ra_point", "dec_point", *CATALOG_COLUMNS],
            f'SELECT ra AS ra_point, "dec" AS dec_point, * FROM ({sky.catalog_sql()})',
        ),
    ),
    "tile_parquet": (tile_parquet, _plain_sql(TILED, sky.catalog_sql())),
    "plain_layout": (plain, _plain_sql(LAID_OUT, _laid_out_sql())),
    "geohash_layout": (
        geohash_clustered,
        geohash_sql("CAST(source_id AS VARCHAR) AS source_id, geohash, lon, lat", _field, 9),
    ),
    "geohash": (sphere_geohash, geohash_sql("source_id, geohash", _sphere, 9)),
    "geohash_density": (
        lambda spark, sf_dir: geohash_density(sky.sources(spark, sf_dir), 5),
        geohash_sql("geohash, count(*) AS count", _field, 5) + " GROUP BY geohash",
    ),
    "s2_cells": (
        s2_ids,
        "SELECT source_id, cell_id, (cell_id & -9007199254740992) | 4503599627370496 AS partition_id "
        f"FROM ({s2_sql(9, _sphere)})",
    ),
    "s2_cell_density": (
        s2_density,
        f"SELECT cell_id, count(*) AS count FROM ({s2_sql(4, _sphere)}) GROUP BY cell_id",
    ),
    "hybrid_layout": (
        hybrid_folders,
        "SELECT (cell_id & -9007199254740992) | 4503599627370496 AS partition_id, count(*) AS sources, "
        f"count(DISTINCT cell_id) AS cells FROM ({s2_sql(9, _field)}) GROUP BY ALL",
    ),
    "mercator_layout": (
        mercator,
        "SELECT source_id, round(6378137e0 * radians(lon), 3) AS x, "
        f"round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM ({_sphere}) "
        "WHERE lat BETWEEN -85.06 AND 85.06",
    ),
    "cover_expansion": (expansion, expansion_sql()),
    "cover_expansion_s2": (s2_expansion, s2_expansion_sql()),
    "cover_expansion_sphere": (sphere_cover, sphere_cover_sql()),
    "query_geometry_report": (report, report_sql()),
    "layer_extent": (
        extent,
        "SELECT min(lon) AS min_x, max(lon) AS max_x, min(lat) AS min_y, max(lat) AS max_y, count(*) AS rows "
        f"FROM ({_field})",
    ),
    "point_summary": (point_summary, point_summary_sql()),
    "dedup_points": (
        dedup_points,
        "SELECT DISTINCT floor(lon * 10) / 10 AS lon, floor(lat * 10) / 10 AS lat "
        f"FROM ({sky.positions_sql('customer', 'point_id')})",
    ),
    "dedup_sources": (dedup_sources, _plain_sql(TILED, sky.catalog_sql())),
    "hash_sample": (
        digest_sample,
        f"SELECT source_id, lon, lat FROM ({_field}) WHERE md5(CAST(source_id AS VARCHAR))[1:8] < '80000000'",
    ),
    "sample_one": (
        digest_one,
        f"SELECT point_id, lon, lat FROM ({sky.positions_sql('customer', 'point_id')}) "
        "ORDER BY md5(CAST(point_id AS VARCHAR)) LIMIT 1",
    ),
    "seeded_sample": (
        seeded_sample,
        "SELECT 0 AS strangers_or_repeats, 0 AS changed, count(*) AS sources, true AS near_half FROM orders",
    ),
    "random_points": (random_sky, random_sky_sql()),
    "sky_frame": (
        sky_frame,
        'SELECT source_id, ra AS lon_wgs84, "dec" AS lat_wgs84, ra AS lon, "dec" AS lat '
        f"FROM ({_sphere})",
    ),
}
