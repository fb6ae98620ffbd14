"""Near duplicates by HyperMinHash.

A document's set of word shingles becomes 128 registers, each the number of leading zeros and ten more bits
of a minimum. Small sets take the minima of 128 permutations, as buckets would stay empty; larger ones
split one permutation into 128 buckets; in an overlap of sizes that no link can jump, documents carry both.
Registers are banded by fours, 32 bands: two documents at the least similarity miss every band with a
chance of 5e-11. Documents that share a band, directly or through others, form a family. Only within
families are pairs looked at: first by the collision-corrected estimate from registers, 4.5 standard
deviations below the limit, then on the full sets.

Documents with equal sets are one class from the start. Large families are dealt into pieces of bounded size,
and each pair of pieces is one task's work that returns only links that unite; no pairs are ever listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import SPACED_BYTES, cut, mixed, packed, run_starts, text_slices, unpacked, words
from almagest.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS, BAND = 128, 4
MANTISSA = 10
# Sets up to the larger size use permutations, from the smaller size on buckets.
PERMUTED, BUCKETED = 320, 256
# Classes in a piece of a family.
PIECE = 2_000

_EIGHT = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _EIGHT) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each row's word shingles, where each row begins). Fewer words: one shingle of all."""
    found = words(data, offsets, SPACED_BYTES)
    count = np.diff(found.first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(shingles)])
    start = np.repeat(found.first[:-1], shingles) + np.arange(first[-1]) - np.repeat(first[:-1], shingles)
    length = np.repeat(np.minimum(count, size), shingles)
    hashes = mixed(length.astype(np.uint64) * _EIGHT)
    for k in range(size):
        live = np.flatnonzero(length > k)
        hashes[live] = mixed((hashes[live] + _EIGHT) ^ found.hashes[start[live] + k])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        hashes[a:b].sort()
    row = np.repeat(np.arange(len(count)), shingles)
    keep = np.zeros(len(hashes), bool)
    keep[run_starts(hashes)] = True
    keep[first[:-1][shingles > 0]] = True
    return hashes[keep], np.searchsorted(row[keep], np.arange(len(count) + 1))


def _compressed(minima: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros and mantissa of numbers of ``bits`` bits, as one number above zero."""
    _, exponent = np.frexp(minima.astype(np.float64))
    exponent = exponent.astype(np.int64)
    # Rounding to 53 bits may lift a number to the next power of two.
    exponent -= (exponent > 0) & ((minima >> np.maximum(exponent - 1, 0).astype(np.uint64)) == 0)
    zeros = bits - exponent
    rest = minima & ((np.uint64(1) << np.maximum(exponent - 1, 0).astype(np.uint64)) - np.uint64(1))
    shift = exponent - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64))
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16) + np.uint16(1)


def permuted(values: np.ndarray) -> np.ndarray:
    """Registers of a small set: minima of many permutations."""
    return _compressed((values[:, None] * _FACTORS).min(0) >> np.uint64(7), 57)


def bucketed(values: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: minima of its buckets, zero where a bucket is empty."""
    bucket = (values >> np.uint64(57)).astype(np.int64)
    starts = run_starts(bucket)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[starts]] = _compressed(values[starts] & np.uint64((1 << 57) - 1), 57)
    return out


def sketches(values: np.ndarray) -> list[dict]:
    out = []
    if len(values) <= PERMUTED:
        out.append({"scheme": 0, "registers": permuted(values).tobytes()})
    if len(values) >= BUCKETED:
        out.append({"scheme": 1, "registers": bucketed(values).tobytes()})
    return out


def estimated(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity corrected for chance collisions of compressed registers, registers it rests on)."""
    used = (one != 0) | (others != 0)
    same = ((one == others) & used).sum(1)
    n = np.maximum(used.sum(1), 1)
    ratio = size / np.maximum(sizes, 1)
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return np.clip((same / n - chance) / (1 - chance), 0, 1), n


def _digest(values: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return int(values.sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mixed(values ^ _EIGHT))).to_bytes(8, "big")


_SKETCH = "doc_id long, row_key long, n_shingles long, digest binary, sketches array<struct<scheme: int, registers: binary>>"
_SET = "digest binary, sketches array<struct<scheme: int, registers: binary>>, shingles array<long>"
_SKETCHES = pa.list_(pa.struct([("scheme", pa.int32()), ("registers", pa.binary())]))


def _sketcher(size: int):
    def sketch(batches):
        for batch in batches:
            ids, keys, done = batch.column("doc_id"), batch.column("row_key"), 0
            for data, offsets in text_slices(batch.column("text")):
                values, first = shingle_sets(data, offsets, size)
                parts = [values[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                own, own_keys = ids.slice(done, len(parts)), keys.slice(done, len(parts))
                done += len(parts)
                digests = [_digest(p) if len(p) else None for p in parts]
                found = [sketches(p) if len(p) else [] for p in parts]
                columns = [own, own_keys, pa.array(np.diff(first)), pa.array(digests, pa.binary()), pa.array(found, _SKETCHES)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n_shingles", "digest", "sketches"])

    return sketch


def _setter(size: int):
    def sets(batches):
        for batch in batches:
            for data, offsets in text_slices(batch.column("text")):
                values, first = shingle_sets(data, offsets, size)
                parts = [values[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                shingles = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                digests = [_digest(p) if len(p) else None for p in parts]
                found = [sketches(p) if len(p) else [] for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, _SKETCHES), shingles], ["digest", "sketches", "shingles"])

    return sets


class Union:
    """Sets that merge, for the members of one task's pieces."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def merge(self, a: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[a]))
        self.label[np.isin(self.label, labels)] = labels[0]


def linked(sets: list[np.ndarray], signs: list[np.ndarray], piece: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between members whose sets are similar enough, those that unite what no earlier one did.

    ``signs`` per scheme: registers of all members, all zero where a member has none. ``piece``: with two
    pieces, only pairs across them are looked at.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets)
    _, local = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(local.max()) + 1, bool)
    group, out = Union(n), []
    across = len(set(piece.tolist())) > 1
    for i in range(n):
        rest = np.arange(i + 1, n)
        rest = rest[group.label[rest] != group.label[i]]
        if across:
            rest = rest[piece[rest] != piece[i]]
        low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[low >= similarity * high - 1e-9]
        if not len(rest):
            continue
        likely = np.zeros(len(rest), bool)
        for sign in signs:
            if sign[i].any():
                close, used = estimated(sign[i], sign[rest], sizes[i], sizes[rest])
                both = sign[rest].any(1)
                likely |= both & (close >= similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / used))
        rest = rest[likely]
        if not len(rest):
            continue
        mark[local[first[i] : first[i + 1]]] = True
        at = np.concatenate([np.arange(first[j], first[j + 1]) for j in rest.tolist()])
        edges = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
        shared = np.add.reduceat(mark[local[at]].astype(np.int64), edges)
        mark[local[first[i] : first[i + 1]]] = False
        union = sizes[i] + sizes[rest] - shared
        near = rest[100 * shared >= round(100 * similarity) * union]
        # One link per group that this one meets.
        _, one = np.unique(group.label[near], return_index=True)
        for j in near[one].tolist():
            out.append((i, j))
        if len(near):
            group.merge(i, near)
    return out


def _linker(similarity: float):
    def link(table: pa.Table) -> pa.Table:
        digests = table.column("digest").to_pylist()
        sets = [np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64) for s in table.column("shingles").combine_chunks()] if len(digests) else []
        found = table.column("sketches").to_pylist()
        signs = []
        for scheme in (0, 1):
            sign = np.zeros((len(found), REGISTERS), np.uint16)
            for k, own in enumerate(found):
                for s in own:
                    if s["scheme"] == scheme:
                        sign[k] = np.frombuffer(s["registers"], np.uint16)
            signs.append(sign)
        links = linked(sets, signs, table.column("piece").to_numpy(), similarity) if len(sets) > 1 else []
        return pa.table({"a": pa.array([digests[i] for i, _ in links], pa.binary()), "b": pa.array([digests[j] for _, j in links], pa.binary())})

    return link


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).cast("long"), content).alias("row_key"), content.alias("text"))


def components_of(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, piece: int = PIECE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id that links reach, its own included).

    Words are runs of anything but white space, A-Z lowered. Documents link if their sets of ``shingle``-word
    shingles have a Jaccard similarity of ``similarity`` (whole hundredths) or more. Null and empty texts
    have no shingles and link with nothing. Rows that repeat share a component; a null id takes part, but names a
    component only where no other does. Other columns are not read; an empty table gives no rows.
    """
    found = _classed(docs, text, key, shingle, similarity, piece)
    return found.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _classed(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """Rows of ``components_of`` with ``row_key`` (hash of id and text), ``digest`` and ``root``, the digest by which a component is known."""
    rows = _texts(docs, text, key)
    sketched = cut(rows.mapInArrow(_sketcher(shingle), _SKETCH))
    classes = sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("sketches").alias("sketches"))
    # Bands in which all registers are empty say nothing.
    width = 2 * BAND
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
        lambda b: F.struct(b.alias("band"), F.substring(F.col("sketch.registers"), b * width + 1, F.lit(width)).alias("part")),
    )
    filled = F.filter(bands, lambda x: x["part"] != F.lit(bytes(width)))
    keys = F.transform(filled, lambda x: F.xxhash64(F.col("sketch.scheme"), x["band"], x["part"]))
    # Families may be too large without harm, so short numbers do for them; links are between digests.
    number = F.xxhash64("digest")
    members = classes.select(number.alias("number"), F.explode("sketches").alias("sketch")).select("number", F.explode(keys).alias("band_key"))
    shared = members.groupBy("band_key").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("leader")).where("n > 1")
    ties = members.join(shared, "band_key").where("number <> leader").select(F.col("number").alias("a"), F.col("leader").alias("b"))
    found = components(ties).withColumnRenamed("node", "number").withColumnRenamed("component", "family")
    families = cut(classes.select(number.alias("number"), "digest", "least").join(found, "number"))
    pieces = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).alias("pieces"))
    dealt = families.join(pieces, "family").withColumn("piece", F.pmod(F.xxhash64("digest"), F.col("pieces")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda q: F.struct(F.least("piece", q).alias("i"), F.greatest("piece", q).alias("j")))
    dealt = dealt.select("digest", "family", "piece", F.explode(pairs).alias("pair")).select("digest", "family", "piece", "pair.i", "pair.j")
    # Whole sets only of one document of each class that has a family.
    wanted = families.select(F.col("least").alias("wanted")).distinct()
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = texts.mapInArrow(_setter(shingle), _SET).where("digest IS NOT NULL")
    grouped = sets.join(dealt, "digest").dropDuplicates(["digest", "i", "j"]).groupBy("family", "i", "j")
    links = cut(grouped.applyInArrow(_linker(similarity), "a binary, b binary"))
    joined = components(links)
    # The least id over a component's classes; classes without a link keep their own.
    reached = joined.join(classes.select(F.col("digest").alias("node"), "least"), "node")
    lowest = reached.groupBy("component").agg(F.min("least").alias("lowest"))
    relabelled = reached.join(lowest, "component").select(F.col("node").alias("digest"), "component", "lowest")
    named = classes.select("digest", "least").join(relabelled, "digest", "left").select(
        "digest", F.coalesce("component", "digest").alias("root"), F.coalesce("lowest", "least").alias("component_id")
    )
    # Written, so that the last join reads two plain shuffles and a class that a third of all rows share can be split.
    named = cut(named)
    return sketched.select("doc_id", "row_key", "n_shingles", "digest").join(named, "digest", "left")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component, that of the least id; all its columns as they were.

    Components are told apart by their shingle sets, so ids that repeat or are null merge nothing. In a component a null id
    ranks last, and where ids repeat the least hash of id and text decides, then the least hash over all
    columns. Rows without shingles are each their own component.
    """
    found = _classed(docs, text, key, **options)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    chosen = found.where("digest IS NOT NULL").groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("times"))
    chosen = chosen.select(F.col("best.doc_id").alias("kept_id"), F.col("best.row_key").alias("kept_key"), "times")
    bare = found.where("digest IS NULL").select(F.col("doc_id").alias("kept_id"), F.col("row_key").alias("kept_key"), F.lit(1).cast("long").alias("times")).distinct()
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(packed(docs).alias("row"), F.col(key).cast("long").alias("row_id"), F.xxhash64(F.col(key).cast("long"), content).alias("row_key"))
    out = rows.join(chosen.unionByName(bare), (F.col("row_key") == F.col("kept_key")) & F.col("row_id").eqNullSafe(F.col("kept_id")))
    single = out.where("times = 1").select("row")
    several = out.where("times > 1").groupBy("row_key", "row_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return unpacked(single.unionByName(several.select("row")), "row")
