"""Size checks and salting, shared by every join here."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
# Join keys are counted in this many hash buckets, so the count table has a fixed size limit.
KEY_BUCKETS = 16384
# A hot bucket is cut so that each piece makes at most about this many pairs.
PAIR_TARGET = 20_000_000
# Times its even share of a side that a bucket must hold to count as hot.
HOT_SHARE = 4
# Rows that dealing hot buckets in pieces may add, as a multiple of both sides' rows.
REPEATS = 8
# Most partitions of a join whose work is known.
MOST_PARTITIONS = 4096

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def row_width(df: DataFrame) -> Column:
    """Bytes a row takes, roughly: fixed-width columns at 16, the others at their text length."""
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if not isinstance(field.dataType, _FIXED_WIDTH):
            width = width + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    return width


def total_bytes(df: DataFrame) -> Column:
    """Aggregate of ``row_width``; 0 for no rows."""
    return F.coalesce(F.sum(row_width(df)), F.lit(0).cast("bigint"))


# Column that holds a row's place where the hidden one is lost on the way.
PLACE = "__place"


def _file_place(df: DataFrame) -> Column | None:
    """Hash of a row's place in its Parquet file, or None for other frames."""
    if PLACE in df.columns:
        return F.col(PLACE)
    try:
        df.select("_metadata.row_index").schema  # noqa: B018 - resolves the hidden column
        return F.xxhash64(F.col("_metadata.row_index"), F.col("_metadata.file_name"))
    except AnalysisException:
        return None


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with the place of its rows as a column that joins keep, if they come from Parquet files."""
    place = _file_place(df)
    return df if place is None else df.withColumn(PLACE, place)


def row_spread(df: DataFrame) -> Column:
    """Hash that is the same when a task runs again: of the place in a Parquet file, which parts even equal rows, else of the content."""
    place = _file_place(df)
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if place is None else place


def bucket_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> dict[int, list[int]]:
    """Rows of both sides per bucket of the keys: at most ``KEY_BUCKETS`` rows, whatever the data, so collecting them is safe."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).alias("bucket")
    sides = [
        side.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit(n))
        for n, side in enumerate((left, right))
    ]
    counts: dict[int, list[int]] = {}
    for row in sides[0].unionByName(sides[1]).collect():
        counts.setdefault(row["bucket"], [0, 0])[row["side"]] = row["rows"]
    return counts


def hot_of(counts: dict[int, list[int]], pair_target: int = PAIR_TARGET, widths: tuple[float, float] = (1, 1)) -> list[tuple[int, int, int]]:
    """Hot key buckets with the number of pieces for the left and for the right side, whose rows are ``widths`` wide.

    A bucket is hot when a side holds well over its even share there and the product of both sides, which bounds
    its pairs, passes ``pair_target``. Pieces keep each product below it, with as little repeated as can be. Where that
    would add more than ``REPEATS`` times the rows there are, pieces are larger: what is moved grows as the input does.
    """
    totals = [sum(c[side] for c in counts.values()) for side in (0, 1)]
    wide, other = widths
    shares = [HOT_SHARE * math.ceil(total / KEY_BUCKETS) for total in totals]
    held = {number: (a, b) for number, (a, b) in counts.items() if a > shares[0] or b > shares[1]}
    while True:
        hot, added = [], 0
        for number, (a, b) in held.items():
            need = math.ceil(a * b / pair_target)
            if need > 1:
                pieces = min(a, need, max(1, round(math.sqrt(need * a * wide / (b * other)))))
                others = min(b, math.ceil(need / pieces))
                hot.append((number, pieces, others))
                added += a * wide * (others - 1) + b * other * (pieces - 1)
        if added <= REPEATS * (totals[0] * wide + totals[1] * other):
            return hot
        pair_target *= 2


def hot_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], pair_target: int = PAIR_TARGET) -> list[tuple[int, int, int]]:
    """Hot key buckets of two frames, see ``hot_of``."""
    return hot_of(bucket_counts(left, right, keys), pair_target)


def join_partitions(counts: dict[int, list[int]], pairs: int = PAIR_TARGET) -> int | None:
    """Partitions that leave about so many pairs to each, or None for few pairs.

    Sides may be small in bytes and their pairs many, which sizes of partitions do not tell. Keys that share a bucket make
    the number larger than need be, so it is bounded.
    """
    number = math.ceil(sum(a * b for a, b in counts.values()) / pairs)
    return min(number, MOST_PARTITIONS) if number > 1 else None


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    pair_target: int = PAIR_TARGET,
    hot: list[tuple[int, int, int]] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Inner equi-join on ``keys``, never by broadcast, in which no key is left to one task.

    Rows of a hot key are dealt into pieces on their own side and repeated once per piece of the other side,
    so every pair meets exactly once. Equal rows that do not come from Parquet have no place to part them:
    they are merged with their number first and repeated after the join. Keys that are not hot are joined as usual.
    ``partitions`` sets the number of tasks that share the join.
    """
    keys = list(keys)
    parted = lambda df, by: df.repartition(partitions, *by) if partitions else df
    if hot is None:
        hot = hot_buckets(left, right, keys, pair_target)
    if not hot:
        return parted(left, keys).join(parted(right, keys).hint("merge"), keys)
    splits = F.broadcast(  # at most KEY_BUCKETS rows
        left.sparkSession.createDataFrame(hot, "__bucket int, __pieces_left int, __pieces_right int")
    )
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    most = (max(h[1] for h in hot), max(h[2] for h in hot))

    def dealt(side: DataFrame, own: str, other: str, repeat: bool) -> DataFrame:
        mine, theirs = (F.coalesce(F.col(f"__pieces_{name}"), F.lit(1)) for name in (own, other))
        place, copies = _file_place(side), F.lit(1).cast("bigint")
        if place is None:
            merged = side.groupBy(*[F.col(f"`{c}`") for c in side.columns]).agg(F.count(F.lit(1)).alias(f"__copies_{own}"))
            frame, copies = merged.withColumn("__spread", F.xxhash64(*[F.col(f"`{c}`") for c in side.columns])), F.col(f"__copies_{own}")
        else:
            frame = side.withColumn("__spread", place)
        frame = (
            frame.withColumn("__bucket", bucket)
            .join(splits, "__bucket", "left")
            .withColumn(f"__salt_{own}", F.pmod(F.col("__spread"), mine).cast("int"))
        )
        pieces = F.explode(F.sequence(F.lit(0), theirs - 1)) if repeat else F.lit(0)
        frame = frame.withColumn(f"__salt_{other}", pieces)
        kept = [F.col(f"`{c}`") for c in side.columns if c != PLACE]
        return frame.select(*kept, *salted[len(keys) :], copies.alias(f"__copies_{own}"))

    # A salt that is 0 throughout is no key: as a constant it would leave the join, and all rows would be dealt once more, over too few tasks.
    salted = [*keys, *[f"__salt_{name}" for name, pieces in zip(("left", "right"), most) if pieces > 1]]
    joined = parted(dealt(left, "left", "right", most[1] > 1), salted).join(
        parted(dealt(right, "right", "left", most[0] > 1), salted).hint("merge"), salted
    )
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, *left.columns, *right.columns]) if c != PLACE]
    if _file_place(left) is None or _file_place(right) is None:
        times = F.col("__copies_left") * F.col("__copies_right")
        joined = joined.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).drop("__again")
    return joined.select(*columns)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a table that is small as a rule: broadcast when it measures small, else salted."""
    size = right.agg(total_bytes(right).alias("size")).first()["size"]
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), list(keys))
    return salted_join(left, right, keys)
