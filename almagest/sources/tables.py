"""CSV and Parquet tables of catalogs, offsets and match results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.operators.skew import row_spread
from almagest.schema import CATALOG_COLUMNS, OFFSET_COLUMNS, as_strings, string_struct, typed_catalog, typed_offsets


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = False, compression: str = "none") -> None:
    """CSV files, without header, plain and refusing to overwrite unless told otherwise. Readers know packed files by their names.

    Packing takes the fast level: half the time for a tenth more bytes, as measured on geometry pairs.
    """
    df.write.mode(mode).option("header", header).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").csv(path)


def write_text_csv(df: DataFrame, path: str) -> None:
    """Headerless CSV of every column as text, replacing what was there."""
    write_csv(df.select(*as_strings(df.columns)), path, mode="overwrite")


def write_small_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with header, replacing what was there: as many files as the frame has partitions, or as the caller wants."""
    write_csv(df.coalesce(files) if files else df, path, mode="overwrite", header=True)


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, header: bool = False) -> DataFrame:
    """CSV as text columns ``_c0..``, or under the given names and types; NULL for what does not parse."""
    if types is None:
        return spark.read.option("header", header).csv(path)
    frame = spark.read.schema(string_struct(types)).option("header", header).csv(path)
    return frame.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless catalog CSV, typed."""
    return typed_catalog(spark.read.schema(string_struct(CATALOG_COLUMNS)).csv(path))


def read_offsets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Offset table from CSV with header, typed."""
    return typed_offsets(spark.read.schema(string_struct(OFFSET_COLUMNS)).option("header", True).csv(path))


def write_by_tile(df: DataFrame, path: str, tile: str = "tile") -> None:
    """Parquet with one folder per tile, all tiles in one job; adaptive execution splits a large tile."""
    df.hint("rebalance", tile).write.mode("overwrite").partitionBy(tile).parquet(path)


# Folder beside the tiles that holds one row per tile; readers of the tiles pass over names that begin so.
MANIFEST = "_manifest"


def tile_facts(df: DataFrame, tile: str = "tile") -> DataFrame:
    """(tile, sources, digest) per tile; the digest is of its rows in any order."""
    columns = [F.col(f"`{c}`") for c in sorted(c for c in df.columns if c != tile)]
    digest = F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string")
    return df.groupBy(F.col(tile).cast("string").alias("tile")).agg(F.count(F.lit(1)).alias("sources"), digest.alias("digest"))


def add_tiles(df: DataFrame, path: str, tile: str = "tile") -> None:
    """Adds a batch of tiles to those written below ``path``: a tile that is there already is replaced, others stay.

    The manifest is written last, from what was written: a batch that broke off has tiles that it lacks or that do not fit
    it (``unfinished_tiles``). Running the batch again mends that, however often.
    """
    names = [row["tile"] for row in df.select(F.col(tile).cast("string").alias("tile")).distinct().collect()]
    _replace_tiles(df, path, tile, names)


def _replace_tiles(df: DataFrame, path: str, tile: str, names: list[str]) -> None:
    if None in names:
        raise ValueError("rows without a tile belong to no folder")

    def replace(rows: DataFrame, to: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(to)

    batch = df.withColumn("tile", F.col(tile).cast("string"))
    replace((batch if tile == "tile" else batch.drop(tile)).hint("rebalance", "tile"), path)
    written = read_tile_folders(df.sparkSession, path).where(F.col("tile").isin(names))
    replace(tile_facts(written).coalesce(1), f"{path.rstrip('/')}/{MANIFEST}")


def read_tile_folders(spark: SparkSession, path: str) -> DataFrame:
    """Tiles written by ``add_tiles`` or ``write_by_tile``, the tile as text whatever its name looks like."""
    frame = spark.read.parquet(path)
    typed = frame.schema["tile"].dataType.simpleString()
    if typed == "string":
        return frame
    # Types of folder names are guessed ("007" is a number); the stated schema keeps them as they are.
    schema = T.StructType([T.StructField("tile", T.StringType()) if f.name == "tile" else f for f in frame.schema.fields])
    return spark.read.schema(schema).parquet(path)


def tile_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(tile, sources, digest) of every tile whose batch was finished."""
    return read_tile_folders(spark, f"{path.rstrip('/')}/{MANIFEST}").select("tile", "sources", "digest")


def unfinished_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles that the manifest lacks, or whose rows are not those it was written for; only the tiles' ids and digests are shuffled."""
    found = tile_facts(read_tile_folders(spark, path))
    same = ["tile", "sources", "digest"]
    return found.join(tile_manifest(spark, path), same, "left_anti").select("tile").unionByName(
        tile_manifest(spark, path).join(found, "tile", "left_anti").select("tile")
    )


def write_in_batches(df: DataFrame, path: str, size: int = 50, tile: str = "tile", again: bool = False) -> list[list[str]]:
    """Writes the tiles of ``df`` in batches of ``size``, in order of their names; returns the batches.

    Tiles that the manifest has already are passed over unless ``again`` is set, so a run that broke off goes on
    where it stopped. The list of tiles comes to the driver: one short text per tile.
    """
    spark = df.sparkSession
    name = F.col(tile).cast("string")
    names = sorted(row["tile"] for row in df.select(name.alias("tile")).where("tile IS NOT NULL").distinct().collect())
    if not again:
        try:
            done = {row["tile"] for row in tile_manifest(spark, path).select("tile").collect()}
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            done = set()
        names = [n for n in names if n not in done]
    batches = [names[k : k + size] for k in range(0, len(names), size)]
    for batch in batches:
        _replace_tiles(df.where(name.isin(batch)), path, tile, batch)
    return batches


def write_clustered(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Parquet in global order of ``key``, so that row-group statistics prune on it.

    Rows are cut into ranges of the key and, within equal keys, of a row hash: one key may fill
    several files.
    """
    order = [key, "__spread"]
    spread = df.withColumn("__spread", row_spread(df))
    ranged = spread.repartitionByRange(*([partitions] if partitions else []), *order)
    ranged.sortWithinPartitions(key).drop("__spread").write.mode("overwrite").parquet(path)


def attach_catalog(
    spark: SparkSession, path: str, view: str | None = None, storage: StorageLevel | None = None
) -> DataFrame:
    """Read a written catalog; optionally keep it at a storage level and name it for SQL.

    Its schema, with the cell levels of the layout, is on the returned frame.
    """
    catalog = spark.read.parquet(path)
    if "cell_id" in catalog.columns:
        # Says that cells are read, not worked out, so filters on them are worth sending to the scan.
        levels = {**catalog.schema["cell_id"].metadata, "stored": True}
        catalog = catalog.withColumn("cell_id", F.col("cell_id").alias("cell_id", metadata=levels))
    if storage is not None:
        catalog = catalog.persist(storage)
    if view:
        catalog.createOrReplaceTempView(view)
    return catalog
