"""Exact duplicates by Grace hashing.

Equal texts are found by comparing complete contents, never digests alone. Every task first merges the
copies it holds itself, so a text that a third of all rows share leaves each task once. The merged rows are
dealt by digest; a task that gets more than fits its table parts them into spill files by further hash
bits, again and again, until each bucket fits an open-addressing table.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import packed, unpacked

# Bytes of content that one open-addressing table may hold.
TABLE_BYTES = 64 << 20
# Spill files that one pass over a bucket writes.
FAN_OUT = 16

_MERGED = "text_digest binary, text string, top long, copies long"


class ContentTable:
    """Open addressing with linear probing; a slot names an entry, whose complete content decides."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[str] = []
        self.digests: list[bytes] = []
        self.top: list[int | None] = []
        self.copies: list[int] = []

    def _place(self, hashed: int, content: str | None) -> int:
        mask = len(self.slots) - 1
        at = (hashed >> 7) & mask
        while (entry := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[entry] == hashed and self.contents[entry] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: str, top: int | None, copies: int) -> None:
        hashed = int.from_bytes(digest[:8], "big")
        at = self._place(hashed, content)
        if (entry := int(self.slots[at])) >= 0:
            self.copies[entry] += copies
            if top is not None and (self.top[entry] is None or top > self.top[entry]):
                self.top[entry] = top
            return
        self.slots[at] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.digests.append(digest)
        self.top.append(top)
        self.copies.append(copies)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for entry, h in enumerate(self.hashes):
                self.slots[self._place(h, None)] = entry

    def batches(self, rows: int = 1024) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.contents), rows):
            part = slice(at, at + rows)
            yield _batch(self.digests[part], self.contents[part], self.top[part], self.copies[part])


def _batch(digests, contents, top, copies) -> pa.RecordBatch:
    columns = [
        pa.array(digests, pa.binary()), pa.array(contents, pa.string()),
        pa.array(top, pa.int64()), pa.array(copies, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["text_digest", "text", "top", "copies"])


def _bucket_of(digest: bytes, level: int) -> int:
    """Each level takes four other bits of the digest, from its end."""
    return (digest[-1 - level // 2] >> (4 * (level % 2))) % FAN_OUT


def grace(batches: Iterator[pa.RecordBatch], table_bytes: int, folder: str, level: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows merged by complete content. Beyond ``table_bytes``, what the table has no entry for goes to spill files.

    The deepest level keeps all in its table: by then only texts of equal digests are left together.
    """
    table, held, files, sinks = ContentTable(), 0, {}, {}
    deepest = level >= 2 * 24
    for batch in batches:
        aside: dict[int, list[int]] = {}
        digests, contents, top, copies = (batch.column(k).to_pylist() for k in range(4))
        for k, digest in enumerate(digests):
            content = contents[k] or ""
            if held < table_bytes or deepest or table.slots[table._place(int.from_bytes(digest[:8], "big"), content)] >= 0:
                size = len(table.contents)
                table.add(digest, content, top[k], copies[k])
                held += (len(table.contents) - size) * (2 * len(content) + 200)
            else:
                aside.setdefault(_bucket_of(digest, level), []).append(k)
        for bucket, rows in aside.items():
            if bucket not in files:
                handle, files[bucket] = tempfile.mkstemp(suffix=".arrow", dir=folder)
                os.close(handle)
                sinks[bucket] = pa.ipc.new_stream(files[bucket], batch.schema)
            sinks[bucket].write_batch(batch.take(pa.array(rows)))
    for sink in sinks.values():
        sink.close()
    yield from table.batches()
    del table
    for path in files.values():
        with pa.OSFile(path) as source, pa.ipc.open_stream(source) as stream:
            yield from grace(iter(stream), table_bytes, folder, level + 1)
        os.unlink(path)


def _merger(table_bytes: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spill files belong to this attempt of the task alone and go with it; a rerun starts from its input.
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            yield from grace(batches, table_bytes, folder)

    return merge


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per different text: ``text_digest``, ``keep_id`` (largest key, null if no row has one), ``group_size``.

    A null text is an empty one. An empty table gives no rows. Two contents with one SHA-256 would be two
    rows here; they stop the job rather than being mixed up.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("text_digest"), content.alias("text"),
        F.col(key).cast("long").alias("top"), F.lit(1).cast("long").alias("copies"),
    )
    merge = _merger(table_bytes)
    local = rows.mapInArrow(merge, _MERGED)
    whole = local.repartition("text_digest").mapInArrow(merge, _MERGED)
    contents = whole.groupBy("text_digest").agg(
        F.max("top").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )
    one = F.when(F.col("contents") == 1, F.col("group_size"))
    stop = F.raise_error(F.lit("two contents share a SHA-256")).cast("long")
    return contents.select("text_digest", "keep_id", F.coalesce(one, stop).alias("group_size"))


def decisions(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts, rows with the largest key stay. Rows that repeat key and text are told apart by nothing,
    so all of them carry the same decision; ``unique`` leaves one of them. Other columns are not read.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), F.sha2(content, 256).alias("text_sha256"))
    found = groups(docs, text, key, table_bytes).withColumn("text_sha256", F.lower(F.hex("text_digest"))).drop("text_digest")
    return rows.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def unique(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with one row per different text, all its columns as they were.

    Where key and text repeat, the row with the least hash over all columns stays.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        packed(docs).alias("row"), F.col(key).cast("long").alias("row_key"), F.unhex(F.sha2(content, 256)).alias("row_digest")
    )
    kept = groups(docs, text, key, table_bytes).select("text_digest", "keep_id", "group_size")
    same = (F.col("row_digest") == F.col("text_digest")) & F.col("row_key").eqNullSafe(F.col("keep_id"))
    found = rows.join(kept, same)
    single = found.where("group_size = 1").select("row")
    several = found.where("group_size > 1").groupBy("row_digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return unpacked(single.unionByName(several.select("row")), "row")
