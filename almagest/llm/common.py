"""Helpers the operators share: table access, reliable cuts in lineage, words as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bytes of text that one task turns into arrays at a time.
SLICE_BYTES = 4 << 20

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_ODD_1, _ODD_2, _SEED = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where it names none, a folder
    beside the warehouse is set.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{frame.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return frame.checkpoint()


# Rows of a table that is sent to every task at most: a few megabytes.
SENT_ROWS = 100_000


def sent(frame: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A table that is small as a rule, marked to be sent to the tasks if it has at most ``most`` rows; it is written first."""
    frame = cut(frame)
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def remainder(key: str, of: int) -> Column:
    """CRC-32 of the key as text, modulo ``of``: splits rows into folds that do not change between runs."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def drawn(frame: DataFrame, by: str, draw: str, sample: int) -> DataFrame:
    """At most ``sample`` rows for each value of ``by``: those of the least ``draw``, a 64-bit hash; ties fall together.

    Only rows whose hash lies in a part of the hash's range that holds about twice the sample are ranked, so a value
    that a third of all rows share is no burden to the task that ranks it.
    """
    wanted = 2 * sample + 1_000
    counts = sent(frame.groupBy(by).agg(F.count(F.lit(1)).alias("all_rows")))
    part = F.least(F.lit(1.0), F.lit(float(wanted)) / F.col("all_rows"))
    near = frame.join(counts, by).where((F.col(draw).cast("double") + 2.0**63) / 2.0**64 <= part).drop("all_rows")
    order = Window.partitionBy(by).orderBy(draw)
    return near.withColumn("draw_rank", F.rank().over(order)).where(F.col("draw_rank") <= sample).drop("draw_rank")


def packed(frame: DataFrame) -> Column:
    """All columns of ``frame`` as one struct, out of reach of names added beside it."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in frame.columns])


def unpacked(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(f"{name}.*")


def byte_table(kept, lower: bool = True) -> np.ndarray:
    """256 bytes: 0 for bytes that part words, else the byte itself, A-Z lowered."""
    out = np.array([b if kept(b) else 0 for b in range(256)], dtype=np.uint8)
    if lower:
        out[65:91] = np.where(np.array([kept(b) for b in range(97, 123)]), np.arange(97, 123), 0)
    return out


# Words of letters, digits and anything beyond ASCII; words of all but white space. A-Z count as a-z.
WORD_BYTES = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
SPACED_BYTES = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row offsets) of consecutive rows, about ``size`` bytes each; null counts as empty.

    A row is never split: one longer than ``size`` is a slice of its own.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, len(column))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """Words of consecutive rows: where each lies in ``data``, its 64-bit hash, and where each row's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # row -> number of its first word; one more entry than rows

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _ODD_1
    values = (values ^ (values >> np.uint64(27))) * _ODD_2
    return values ^ (values >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes a step; only spans that reach a step take part in it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = end - start
    hashes = mixed(length.astype(np.uint64) * _SEED + _SEED)
    live, step = np.arange(len(start)), 0
    while len(live):
        left = length[live] - step
        hashes[live] = mixed((hashes[live] + _SEED) ^ (eight[start[live] + step] & _MASKS[np.minimum(left, 8)]))
        step += 8
        live = live[left > 8]
    return hashes


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Words:
    """Words of a slice, by a table from ``byte_table``. No word crosses rows."""
    mapped = kinds[data]
    inside = mapped != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(mapped, start, end, span_hashes(mapped, start, end), np.searchsorted(start, offsets))


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
