"""Per-tile text tables: comment lines, a piped header line, rows split by blanks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.operators.skew import BROADCAST_BYTES, total_bytes
from almagest.schema import CATALOG_COLUMNS, OFFSET_COLUMNS, typed_catalog, typed_offsets

# Marks of comment and header lines, white space between fields, and the word in the
# name of files that hold rejected sources.
COMMENT_MARK = "\\"
HEADER_MARK = "|"
WHITE_SPACE = " \t\r\n\f\x0b"
REJECTED = "rej"


def tile_of(path: Column, pattern: str = r"([^/_]+)_[^/]*$") -> Column:
    """Tile id from a file path: the file name up to its first underscore, unless told otherwise."""
    return F.regexp_extract(path, pattern, 1)


def renamed_file(path: Column, new_suffix: str, old_suffix: str = "tbl.gz") -> Column:
    """File name with its suffix replaced."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.replace(name, F.lit(old_suffix), F.lit(new_suffix))


def is_rejected(name: Column) -> Column:
    """True for the name of a file that holds rejected sources."""
    return name.contains(REJECTED)


def header_names(line: Column) -> Column:
    """Column names of a header line: lower case, no blanks, the outer empty pieces cut off."""
    pieces = F.split(F.lower(F.translate(line, WHITE_SPACE, "")), rf"\{HEADER_MARK}")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))


def _is_data(line: Column) -> Column:
    """True for rows of values: not for comments, for any header line (names, types, units, null marks) or for blanks."""
    marked = line.startswith(HEADER_MARK) | line.startswith(COMMENT_MARK)
    return ~marked & (F.trim(line, F.lit(WHITE_SPACE)) != "")


def tile_headers(lines: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """(file_path, names): the names line of each file, known by its content.

    It is the header line that holds all ``wanted`` columns; without them, the only one there is. Of several that fit, the
    first by text counts, so that a rerun finds the same.
    """
    heads = lines.where(F.col("value").startswith(HEADER_MARK)).select("file_path", header_names(F.col("value")).alias("names"))
    if wanted is not None:
        heads = heads.where(F.size(F.array_except(F.array(*[F.lit(c) for c in wanted]), "names")) == 0)
    return heads.groupBy("file_path").agg(F.min("names").alias("names"))


def tile_lines(spark: SparkSession, path: str | list[str], files: str = "*.tbl*") -> DataFrame:
    """(value, file_path) of all lines of the tile files below ``path``; files of rejected sources are skipped by name."""
    return (
        spark.read.option("pathGlobFilter", files)
        .option("recursiveFileLookup", "true")
        .text(path)
        .where(~is_rejected(F.col("_metadata.file_name")))
        .select("value", F.col("_metadata.file_path").alias("file_path"))
    )


def _fields(value: Column) -> Column:
    return F.split(F.trim(value, F.lit(WHITE_SPACE)), r"\s+")


def _with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows with what is known of their file, if anything: one small row per file, sent along when it measures small."""
    size = heads.agg(total_bytes(heads).alias("size")).first()["size"]
    return rows.join(F.broadcast(heads) if size <= BROADCAST_BYTES else heads, "file_path", "left")


def read_tiles(
    spark: SparkSession,
    path: str | list[str],
    *,
    files: str = "*.tbl*",
    tile_pattern: str | None = None,
    wanted: Sequence[str] | None = None,
    ragged: str = "stop",
) -> DataFrame:
    """All tile files below ``path``: every wanted column as text, by each file's own names line, then ``tile``.

    Plain and gzip files are read alike. A file may have several header lines and its columns in any order; one with
    rows but without a names line stops the job. A row with more or fewer fields than its file has names stops the
    job as well; with ``ragged='reject'`` both are left to ``rejected_rows``. Without ``wanted``, the columns are those of the first
    names line by text, and every file must have them. Headers are looked up in one pass over the files.
    """
    if ragged not in ("stop", "reject"):
        raise ValueError(f"unknown rule {ragged!r} for ragged rows")
    lines = tile_lines(spark, path, files)
    if wanted is None:
        first = tile_headers(lines).agg(F.min("names").alias("names")).first()["names"]
        if first is None:
            raise ValueError(f"no header line in the tile files of {path}")
        wanted = list(first)
    heads = tile_headers(lines, wanted)
    places = F.transform(F.array(*[F.lit(c) for c in wanted]), lambda c: (F.array_position("names", c) - 1).cast("int"))
    heads = heads.select("file_path", places.alias("places"), F.size("names").alias("names"))
    rows = lines.where(_is_data(F.col("value"))).select(_fields(F.col("value")).alias("fields"), "file_path")
    found = _with_heads(rows, heads)
    stop = lambda what, kind: F.raise_error(F.concat(F.lit(f"{what} in tile file "), "file_path")).cast(kind)
    whole = F.size("fields") == F.col("names")
    if ragged == "reject":
        found = found.where(whole)
    else:
        ragged_row = stop("a row with too few or too many fields", "array<int>")
        no_names = stop("no names line", "array<int>")
        found = found.withColumn("places", F.when(whole, F.col("places")).when(F.col("names").isNull(), no_names).otherwise(ragged_row))
    tile = tile_of(F.col("file_path"), tile_pattern) if tile_pattern else tile_of(F.col("file_path"))
    return found.select(*[F.get("fields", F.get("places", F.lit(n))).alias(name) for n, name in enumerate(wanted)], tile.alias("tile"))


def rejected_rows(
    spark: SparkSession, path: str | list[str], types: Mapping[str, str], *, files: str = "*.tbl*", null: str = "null"
) -> DataFrame:
    """Rows of tile files that cannot be read as they stand: file_path, line (from 1), reason, value (the line).

    Reasons: ``no names line`` (the file has none with all columns of ``types``), ``too few fields``, ``too many fields``, and
    ``<column> does not parse`` for the first column, in the order of ``types``, whose text is neither of its type nor ``null``. The last kind is
    still read, with NULL there. Lines are counted per part of a file that one task reads, and the parts' counts added up, so
    large files are read in parallel.
    """
    place = "_metadata.file_block_start"
    raw = (
        spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", "true").text(path)
        .where(~is_rejected(F.col("_metadata.file_name")))
        .select("value", F.col("_metadata.file_path").alias("file_path"), F.col(place).alias("block"), F.monotonically_increasing_id().alias("id"))
    )
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file_path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    blocks = blocks.select("file_path", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("above"))
    # Where a file has its columns is found once a file.
    places = F.transform(F.array(*[F.lit(c) for c in types]), lambda c: (F.array_position("names", c) - 1).cast("int"))
    heads = tile_headers(raw.select("value", "file_path"), list(types)).select("file_path", "names", places.alias("places"))
    rows = _with_heads(raw.where(_is_data(F.col("value"))).withColumn("fields", _fields(F.col("value"))), heads)
    more = F.size("fields") - F.size("names")
    text = [F.get("fields", F.get("places", F.lit(n))) for n in range(len(types))]
    broken = [F.when((t != null) & t.try_cast(kind).isNull(), F.lit(f"{c} does not parse")) for t, (c, kind) in zip(text, types.items())]
    reason = (
        F.when(F.col("names").isNull(), "no names line").when(more < 0, "too few fields").when(more > 0, "too many fields").otherwise(F.coalesce(*broken))
    )
    # ``explode`` sees to it that a row is judged once; a filter on a plain column would judge it again.
    found = rows.select("value", "file_path", "block", "id", F.explode(F.array(reason)).alias("reason")).where(F.col("reason").isNotNull())
    line = F.col("id") - F.col("first") + F.col("above") + 1
    return found.join(blocks, ["file_path", "block"]).select("file_path", line.alias("line"), "reason", "value")


def read_catalog_tiles(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """The twenty typed catalog columns of all tiles, then ``tile``."""
    return typed_catalog(read_tiles(spark, path, wanted=CATALOG_COLUMNS, **options), keep=["tile"])


def read_offset_tiles(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Typed offset table from its text form, where ``tile`` is a column of the file."""
    lines = read_tiles(spark, path, wanted=OFFSET_COLUMNS, **options)
    # The file's own ``tile`` column comes first; the one taken from the file name is last.
    return typed_offsets(lines.toDF(*lines.columns[:-1], "file_tile"))
