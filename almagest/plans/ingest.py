"""From per-tile text tables to the corrected primary catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from almagest.operators.calibrate import apply_offsets
from almagest.sources.tables import read_offsets_csv, write_by_tile, write_small_csv
from almagest.sources.tiles import read_catalog_tiles, read_offset_tiles


def prepare_offsets(spark: SparkSession, text_path: str, csv_path: str, **options) -> None:
    """Offset table, a row per tile, from its text form to one CSV file with header."""
    write_small_csv(read_offset_tiles(spark, text_path, **options), csv_path, files=1)


def primary_catalog(spark: SparkSession, tiles_path: str, offsets_csv: str, **options) -> DataFrame:
    """Corrected sources of every tile, with ``tile`` last."""
    return apply_offsets(read_catalog_tiles(spark, tiles_path, **options), read_offsets_csv(spark, offsets_csv))


def write_primary(spark: SparkSession, tiles_path: str, offsets_csv: str, out: str, **options) -> None:
    """The whole ingest in one job, one output folder per tile; the raw files are left alone."""
    write_by_tile(primary_catalog(spark, tiles_path, offsets_csv, **options), out)
