"""Repeated passages by hashing their units.

A text is parted into sentences; a line's end always ends one. A unit is normalised to its words, A-Z lowered,
and hashed to 128 bits. Digests are grouped globally: the earliest occurrence, by document and place, is kept,
every other is a repeat. A run of neighbouring repeats grows word by word at both edges as long as the text
around its kept occurrence is the same, so passages that begin or end within a sentence are met whole; runs that
grow together are one. Runs that hold a whole line are removed, others if they have more than a few words. Offsets
are those of the original text.

What edges grow by is read from windows of words around them and around their kept places; windows get longer,
round by round, for the few edges that agree to a window's end. A kept place gives one window, however many
texts repeat it, and no text meets another.

A passage that holds no whole unit is not met, as only whole units are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import WORD_BYTES, Words, cut, mixed, packed, text_slices, unpacked, words

# Words in a run of repeats from which it is removed: one to three words within a line repeat by chance in any prose.
# A run that holds a whole line goes whatever its length.
RUN_WORDS = 4
# Words on each side of a unit that are noted with it, a byte each.
NOTED = 4
# Words in an edge's first window, and how much longer each next one is.
WINDOW, LONGER = 32, 16
# Places of the bitmap that leaves out most texts no edge needs: 16 for each wanted text within these bounds, powers of two.
LEAST_SLOTS, MOST_SLOTS = 20, 29

_UNITS = "doc_id long, row_key long, unit int, start int, end int, n_words int, line int, around long, high long, low long"
_ASKED = "left boolean, at int, skip int, limit int, run int, most int, keep_key long, keep_at int, keep_skip int"
_WINDOW = f"row_key long, {_ASKED}, words binary, places binary, within int"
_EDGE = "row_key long, run int, left boolean, n int, gap int, at int, keep_at int, settled boolean"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def unit_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in a slice: at each row, after each line feed, and after ``.``, ``!`` or ``?`` before white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 46) | (data == 33) | (data == 63)
    starts = np.zeros(len(data) + 1, bool)
    starts[1:][data == 10] = True
    starts[1:-1] |= stop[:-1] & space[1:]
    starts[offsets[:-1]] = True
    starts[-1] = False
    return np.flatnonzero(starts)


def _units(batches):
    for batch in batches:
        ids, keys, done = batch.column("doc_id"), batch.column("row_key"), 0
        for data, offsets in text_slices(batch.column("text")):
            found = words(data, offsets, WORD_BYTES)
            edges = unit_edges(data, offsets)
            first = np.searchsorted(found.start, np.append(edges, len(data)))
            size = np.diff(first)
            held = np.flatnonzero(size > 0)
            edges_end = np.append(edges[1:], len(data))[held]
            first, size, begin = first[:-1][held], size[held], edges[held]
            # Two sums over words, each word weighed by its place in the unit.
            place = np.arange(len(found.hashes)) - np.repeat(first, size) if len(held) else np.zeros(0, np.int64)
            weight = mixed(place.astype(np.uint64) * _ODD + _ODD) | np.uint64(1)
            high = np.add.reduceat(mixed(found.hashes * weight), first) if len(held) else np.zeros(0, np.uint64)
            low = np.add.reduceat(mixed(found.hashes ^ weight), first) if len(held) else np.zeros(0, np.uint64)
            row = np.searchsorted(offsets, begin, "right") - 1
            around = _around(found, first, first + size, row)
            # Rows without text share an offset with the next; the last of equal offsets is the one with text.
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            unit = np.arange(len(held)) - np.searchsorted(row, np.arange(len(offsets) - 1))[row]
            # Of the units that hold words, 1 for the first of each line, 2 for the last.
            line = np.cumsum(data == 10)[begin] - (data[begin] == 10) if len(held) else np.zeros(0, np.int64)
            turns = np.ones(len(held) + 1, bool)
            turns[1:-1] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
            take = pa.array(row + done)
            done += len(offsets) - 1
            base = chars[offsets[:-1]][row]
            sides = turns[:-1] + 2 * turns[1:]
            numbers = [pa.array(x.astype(np.int32)) for x in (unit, chars[begin] - base, chars[edges_end] - base, size, sides)]
            digests = [pa.array(x.view(np.int64)) for x in (around, high, low)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), keys.take(take), *numbers, *digests], ["doc_id", "row_key", "unit", "start", "end", "n_words", "line", "around", "high", "low"]
            )


def _around(found: Words, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A byte for each of the words before a unit, nearest first, then for those after it; zero where the text ends."""
    marks = np.append((found.hashes >> np.uint64(40)) % np.uint64(255) + np.uint64(1), np.uint64(0))
    out = np.zeros(len(first), np.uint64)
    for k in range(NOTED):
        before, after = first - 1 - k, last + k
        out |= marks[np.where(before >= found.first[row], before, -1)] << np.uint64(8 * k)
        out |= marks[np.where(after < found.first[row + 1], after, -1)] << np.uint64(8 * (NOTED + k))
    return out


def _met(one: Column, other: Column, at: int) -> Column:
    """Noted words that agree, from byte ``at`` on; ``NOTED`` if all do, when more may."""
    out = F.lit(NOTED)
    for k in reversed(range(NOTED)):
        a, b = (F.shiftright(x, 8 * (at + k)).bitwiseAND(F.lit(255)) for x in (one, other))
        out = F.when((a == b) & (a != 0), out).otherwise(F.lit(k))
    return out


def _reach(near: Column) -> Column:
    """Words by which an edge can grow at most, as far as noted words tell."""
    return F.when(near < NOTED, near).otherwise(F.lit(1 << 30))


def common(one: np.ndarray, other: np.ndarray) -> int:
    """Values that agree from the start on."""
    size, at, step = min(len(one), len(other)), 0, 16
    while at < size:
        differ = np.flatnonzero(one[at : min(at + step, size)] != other[at : min(at + step, size)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 4 * step
    return size


def _placed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of a text's words, where they start and end in code points)."""
    data, offsets = next(text_slices(pa.array([text], pa.large_string())))
    found = words(data, offsets, WORD_BYTES)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return found.hashes, chars[found.start], chars[found.end]


def _windows(size: int):
    """Per place asked for: the hashes of up to ``size`` words from there outwards, where they lie, and the number of words up to the limit.

    An edge whose noted words differ gets no words beyond these.
    """

    def windows(batches):
        for batch in batches:
            out = []
            for row_key, text, asked in zip(*(batch.column(c).to_pylist() for c in ("row_key", "text", "asked"))):
                hashes, starts, ends = _placed(text)
                for a in asked:
                    at = int(np.searchsorted(starts, a["at"])) + a["skip"]
                    most = size if a["most"] is None else min(size, a["most"])
                    if a["left"]:
                        stop = 0 if a["limit"] is None else int(np.searchsorted(starts, a["limit"]))
                        span, places, within = slice(max(stop, at - most), at), starts, at - stop
                    else:
                        stop = len(starts) if a["limit"] is None else int(np.searchsorted(starts, a["limit"]))
                        span, places, within = slice(at, min(stop, at + most)), ends, stop - at
                    step = -1 if a["left"] else 1
                    out.append((row_key, *a.values(), hashes[span][::step].tobytes(), places[span][::step].astype(np.int32).tobytes(), within))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_WINDOW_FIELDS)], schema=_WINDOW_FIELDS)

    return windows


_WINDOW_FIELDS = pa.schema([
    ("row_key", pa.int64()), ("left", pa.bool_()), ("at", pa.int32()), ("skip", pa.int32()), ("limit", pa.int32()), ("run", pa.int32()),
    ("most", pa.int32()), ("keep_key", pa.int64()), ("keep_at", pa.int32()), ("keep_skip", pa.int32()), ("words", pa.binary()), ("places", pa.binary()), ("within", pa.int32()),
])


def _extended(size: int):
    """Per edge of a run: words it grows by, words up to the next run, where it then lies in both texts, and whether its windows show all that."""

    def extended(batches):
        names = ["left", "at", "keep_at", "words", "places", "within", "kept_words", "kept_places", "kept_within"]
        for batch in batches:
            out = []
            for left, at, keep_at, own, places, within, kept, kept_places, kept_within in zip(*(batch.column(c).to_pylist() for c in names)):
                n = common(np.frombuffer(own, np.uint64), np.frombuffer(kept, np.uint64))
                if n:
                    at = int(np.frombuffer(places, np.int32)[n - 1])
                    keep_at = int(np.frombuffer(kept_places, np.int32)[n - 1]) if left else keep_at
                out.append((n, within, at, keep_at, n < size or within == size or kept_within == size))
            found = [pa.array([r[k] for r in out], kind) for k, kind in enumerate([*[pa.int32()] * 4, pa.bool_()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("run"), batch.column("left"), *found], ["row_key", "run", "left", "n", "gap", "at", "keep_at", "settled"]
            )

    return extended


def _wanted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(row_key, text) of ``rows`` whose key is among ``keys``, and few others: a bitmap of 64 MB at most goes to all tasks."""
    slots = 1 << min(max((16 * keys.count()).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    slot = F.pmod("row_key", F.lit(slots))
    part, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    parts = keys.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    held = 1 << 15
    # Parts count from one, slot zero is the first bit of part zero.
    bits = np.zeros(slots // 8 + held // 4, np.uint8)
    for r in parts.toLocalIterator():
        bits[r.part * held // 8 : (r.part + 1) * held // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def kept(batches):
        table = shared.value
        for batch in batches:
            at = batch.column("part").to_numpy() * held + batch.column("bit").to_numpy()
            keep = pa.array((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("row_key", "text")], ["row_key", "text"])

    return rows.select("row_key", "text", part.alias("part"), bit.alias("bit")).mapInArrow(kept, "row_key long, text string")


def _met_edges(rows: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """``edges`` as far as windows of ``size`` words show what they grow by.

    A text is read once for all that is asked of it, which is no more than its own units; a place that many texts repeat is asked for
    once. Windows are written, so that the join reads two plain shuffles and a place that a third of all texts repeat can be split.
    """
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    places = edges.select(
        F.col("keep_key").alias("row_key"), "left", F.col("keep_at").alias("at"), F.col("keep_skip").alias("skip"),
        none("limit", "int"), none("run", "int"), none("most", "int"), none("keep_key", "long"), none("keep_at", "int"), none("keep_skip", "int"),
    ).distinct()
    names = [n.split()[0] for n in _ASKED.split(", ")]
    asked = cut(edges.withColumn("skip", F.lit(0)).unionByName(places).groupBy("row_key").agg(F.collect_list(F.struct(*names)).alias("asked")))
    texts = _wanted(rows, asked.select("row_key")).dropDuplicates(["row_key"])
    windows = cut(texts.join(asked, "row_key").mapInArrow(_windows(size), _WINDOW))
    kept = windows.where("run IS NULL").select(
        F.col("row_key").alias("keep_key"), "left", F.col("at").alias("keep_at"), F.col("skip").alias("keep_skip"),
        F.col("words").alias("kept_words"), F.col("places").alias("kept_places"), F.col("within").alias("kept_within"),
    )
    both = windows.where("run IS NOT NULL").drop("skip", "limit", "most").join(kept, ["keep_key", "left", "keep_at", "keep_skip"])
    return cut(both.mapInArrow(_extended(size), _EDGE))


def _grown(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with what their live edges grow by."""
    edge = lambda left, own, limit, side, keep, skip: runs.where(f"grows_{side}").select(
        "row_key", F.lit(left).alias("left"), F.col(own).alias("at"), F.col(limit).alias("limit"), "run", _reach(F.col(f"near_{side}")).alias("most"),
        F.col(f"{keep}.first_key").alias("keep_key"), F.col(f"{keep}.first_start").alias("keep_at"), skip.cast("int").alias("keep_skip"),
    )
    edges = edge(True, "start", "low", "left", "head", F.lit(0)).unionByName(edge(False, "end", "high", "right", "tail", F.col("tail.n_words")))
    size, met = WINDOW, _met_edges(rows, edges, WINDOW)
    found = met.where("settled")
    while not (still := met.where("NOT settled")).isEmpty():
        size *= LONGER
        met = _met_edges(rows, edges.join(still.select("row_key", "run", "left"), ["row_key", "run", "left"], "left_semi"), size)
        found = found.unionByName(met.where("settled"))
    grown = found.groupBy("row_key", "run").agg(*[
        F.max(F.when(F.col("left") == F.lit(left), F.struct("n", "gap", "at", "keep_at"))).alias(name) for name, left in (("to_left", True), ("to_right", False))
    ])
    return runs.join(grown, ["row_key", "run"], "left")


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """One row per removed run: doc_id, row_key, start, end (code points, end exclusive), n_words, n_units, keep_doc_id, keep_start.

    ``keep_doc_id`` and ``keep_start`` say where the run's first word was met first. Documents rank by id, null
    last; within a document the earlier place ranks first, so repeats in one document count too. Rows
    that repeat id and text are one document and the same occurrence. Units without words part nothing and are never
    removed alone. A run of less than ``run_words`` words that holds no whole line stays as it is. Null and empty texts have no units; other
    columns are not read; no rows, no runs.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).cast("long"), content).alias("row_key"), content.alias("text"))
    units = rows.mapInArrow(_units, _UNITS)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "start", "around")
    shared = units.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    # Written, so that the join reads two plain shuffles and a very common unit can be split.
    shared = cut(shared)
    again = units.join(shared, ["high", "low"]).where(~((F.col("row_key") == F.col("first.row_key")) & (F.col("start") == F.col("first.start"))))
    # What noted words tell is worked out here: narrow rows of numbers go on.
    again = again.select(
        "doc_id", "row_key", "unit", "start", "end", "n_words", "line", (_met(F.col("around"), F.col("first.around"), 0) + 8 * _met(F.col("around"), F.col("first.around"), NOTED)).alias("near"),
        F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("first_key"), F.col("first.start").alias("first_start"),
    ).dropDuplicates(["row_key", "unit"])
    # Neighbouring units have one difference between number and rank.
    run = F.col("unit") - F.row_number().over(Window.partitionBy("row_key").orderBy("unit"))
    edge = F.struct("unit", "first_id", "first_key", "first_start", "n_words", "near")
    runs = again.withColumn("run", run).groupBy("row_key", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("n_units"), F.min(edge).alias("head"), F.max(edge).alias("tail"),
        # A run's units have no gaps: it holds a whole line if one opens in it before the last that closes.
        F.coalesce(F.min(F.when(F.col("line") % 2 == 1, F.col("unit"))) <= F.max(F.when(F.col("line") >= 2, F.col("unit"))), F.lit(False)).alias("whole"),
    )
    runs = runs.withColumns({"near_left": F.col("head.near") % 8, "near_right": F.floor(F.col("tail.near") / 8).cast("int")})
    live = F.col("whole") | (F.col("n_words") + _reach(F.col("near_left")) + _reach(F.col("near_right")) >= run_words)
    order = Window.partitionBy("row_key").orderBy("start")
    runs = runs.select(
        "row_key", "run", "doc_id", "start", "end", "n_words", "n_units", "whole", "head", "tail", "near_left", "near_right",
        (live & (F.col("near_left") > 0)).alias("grows_left"), (live & (F.col("near_right") > 0)).alias("grows_right"),
        F.lag("end").over(order).alias("low"), F.lead("start").over(order).alias("high"),
    )
    beside = F.coalesce(F.lag("grows_right").over(order), F.lit(False)) | F.coalesce(F.lead("grows_left").over(order), F.lit(False))
    runs = runs.withColumn("beside", beside).where(F.col("whole") | (F.col("n_words") >= run_words) | F.col("grows_left") | F.col("grows_right") | F.col("beside"))
    grown = _grown(rows, cut(runs.drop("beside")))
    left, right = F.coalesce("to_left.n", F.lit(0)), F.coalesce("to_right.n", F.lit(0))
    last = F.lag(F.struct("end", right.alias("n"), "to_right.gap")).over(order)
    grown = grown.withColumn("last", last).withColumn("gap", F.when(F.col("last.end") == F.col("low"), F.coalesce("to_left.gap", "last.gap")))
    grown = grown.withColumn("joins", F.coalesce(left + F.col("last.n") >= F.col("gap"), F.lit(False)))
    size = F.col("n_words") + F.when(F.col("joins"), F.col("gap") - F.col("last.n")).otherwise(left) + right
    keep = F.struct("start", F.col("head.first_id").alias("doc_id"), F.coalesce("to_left.keep_at", "head.first_start").alias("at"))
    spans = grown.withColumn("span", F.sum((~F.col("joins")).cast("int")).over(order)).groupBy("row_key", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min(F.coalesce("to_left.at", "start")).alias("start"), F.max(F.coalesce("to_right.at", "end")).alias("end"),
        F.sum(size).alias("n_words"), F.sum("n_units").alias("n_units"), F.max("whole").alias("whole"), F.min(keep).alias("keep"),
    )
    return spans.where(F.col("whole") | (F.col("n_words") >= run_words)).select(
        "doc_id", "row_key", "start", "end", "n_words", "n_units", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.at").alias("keep_start")
    )


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut out of their texts, and ``removed``: the spans that went, in the original's offsets."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(packed(docs).alias("row"), F.xxhash64(F.col(key).cast("long"), content).alias("row_key"))
    span = F.struct("start", "end")
    spans = repeats(docs, text, key, run_words).groupBy("row_key").agg(F.sort_array(F.collect_list(span)).alias("removed"))
    joined = rows.join(spans, "row_key", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start: int, end: int>>")))
    own = F.col(f"row.`{text}`")
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    stops = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length(own)))
    left = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(own, a + 1, b - a)), "")
    return unpacked(joined.select(F.col("row").withField(f"`{text}`", F.when(F.size("removed") > 0, left).otherwise(own)).withField("removed", F.col("removed")).alias("row")), "row")
