"""Language by rank-order profiles of n-grams.

A profile is the list of the most frequent letter n-grams of a language, by rank; a document has one as well.
The distance of a document from a language adds up how far each of the document's n-grams is out of place,
with the full length of the profile for one that the language lacks. The nearest language wins.
"""

from __future__ import annotations

import unicodedata
from typing import Iterator  # the form that Arrow functions are recognised by

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import drawn, run_starts, text_slices

# Longest n-gram; three code points of 21 bits fit one number.
GRAM = 3
# N-grams in a profile.
PROFILE = 300
# Documents per language that profiles are learned from at most: those of the least hashes of their ids.
SAMPLE = 2_000
# Languages that may be learned; more stop the job, as a column of something else than languages would.
LANGUAGES = 4_096
# Bytes of text that are counted at a time.
_SLICE = 1 << 20
UNKNOWN = "und"

_TOP = np.uint64((1 << 21) - 1)


def _letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for all that is no letter or mark."""
    out = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        mark = unicodedata.category(c := chr(code))[0]
        if mark in "LM":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_letters: np.ndarray | None = None


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letters with blanks for the rest, row of each) of a slice of UTF-8, one blank before and after each row."""
    global _letters
    if _letters is None:
        _letters = _letter_table()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # Offsets in bytes to offsets in code points: count bytes that begin one.
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    size = np.diff(begins)
    row = np.repeat(np.arange(len(size)), size + 2)
    out = np.full(len(row), 32, np.uint32)
    inner = np.arange(len(codes)) + 2 * np.repeat(np.arange(len(size)), size) + 1
    out[inner] = _letters[codes]
    return out, row


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) by row and n-gram; an n-gram is letters, or letters with one blank at an end."""
    text, row = letters(data, offsets)
    symbols, text = np.unique(text, return_inverse=True)
    bits = np.uint64(max(1, int(len(symbols)).bit_length()))
    blank = int(np.searchsorted(symbols, 32))
    code = (text + 1).astype(np.uint64)  # zero: no symbol
    solid = text != blank
    parts = []
    for n in range(1, GRAM + 1):
        value, held = np.zeros(len(code) - n + 1, np.uint64), np.zeros(len(code) - n + 1, bool)
        for k in range(n):
            value = value << bits | code[k : len(code) - n + 1 + k]
            held |= solid[k : len(code) - n + 1 + k]
        keep = held & (row[: len(value)] == row[n - 1 :])
        if n == 3:
            keep &= solid[1:-1]
        shift = np.uint64(GRAM) * bits
        parts.append((row[: len(value)][keep].astype(np.uint64) << shift) | value[keep])
    pairs = np.sort(np.concatenate(parts))
    starts = run_starts(pairs)
    count = np.diff(np.append(starts, len(pairs)))
    pairs = pairs[starts]
    owner = (pairs >> shift).astype(np.int64)
    wide = np.zeros(len(pairs), np.uint64)
    for k in range(GRAM):
        digit = (pairs >> (np.uint64(GRAM - 1 - k) * bits)) & np.uint64((1 << int(bits)) - 1)
        point = np.where(digit > 0, symbols[np.maximum(digit, 1).astype(np.int64) - 1], 0).astype(np.uint64)
        wide = wide << np.uint64(21) | (point & _TOP)
    return owner, wide, count


def ranked(owner: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank from 0) of each row's most frequent n-grams; equal counts keep their order, that of n-grams."""
    by = np.argsort(owner.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - count.astype(np.uint64)), kind="stable")
    owner, gram = owner[by], gram[by]
    rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(rows))[owner]
    top = rank < PROFILE
    return owner[top], gram[top], rank[top]


def _gram_counts(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        done = 0
        for data, offsets in text_slices(batch.column("text"), _SLICE):
            rows = len(offsets) - 1
            owner, gram, count = counted(data, offsets)
            own = langs[done : done + rows]
            done += rows
            for lang in sorted(set(own.tolist())):
                mine = own[owner] == lang
                grams, back = np.unique(gram[mine], return_inverse=True)
                total = np.bincount(back, count[mine], len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(total)], ["lang", "gram", "n"]
                )


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(lang, gram, rank): the ``PROFILE`` most frequent n-grams of each language.

    Learned from at most ``sample`` documents per language, those whose ids hash lowest, over their whole texts.
    Rows without a language teach nothing; null texts count as empty. No documents, no profiles.
    """
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.col(key).cast("string")).alias("draw"),
    ).where("lang IS NOT NULL")
    limits = drawn(rows.select("lang", "draw"), "lang", "draw", sample).groupBy("lang").agg(F.max("draw").alias("limit")).take(LANGUAGES + 1)
    if len(limits) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    limit = docs.sparkSession.createDataFrame(limits, "lang string, limit long")
    taught = rows.join(F.broadcast(limit), "lang").where("draw <= limit").select("lang", "text")
    grams = taught.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return grams.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < PROFILE).select("lang", "gram", "rank")


class Profiles:
    """Ranks of all languages as one table: n-gram -> rank per language, ``PROFILE`` where it is missing."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), PROFILE, np.int64)
        if rows:
            at = np.searchsorted(self.grams, np.array([gram for _, gram, _ in rows], np.uint64))
            self.ranks[at, [self.langs.index(lang) for lang, _, _ in rows]] = [rank for _, _, rank in rows]

    def distances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages, n-grams per row): summed out-of-place distances."""
        rows = len(offsets) - 1
        owner, gram, rank = ranked(*counted(data, offsets), rows)
        at = np.searchsorted(self.grams, gram)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == gram[known]
        at[~known] = len(self.grams)
        out = np.empty((rows, len(self.langs)))
        for k in range(len(self.langs)):
            theirs = self.ranks[at, k]
            apart = np.where(theirs < PROFILE, np.abs(theirs - rank), PROFILE)
            out[:, k] = np.bincount(owner, apart, rows)
        return out, np.bincount(owner, minlength=rows)


def _guesses(known: Profiles, column: pa.Array) -> pa.StructArray:
    langs, scores = [], []
    for data, offsets in text_slices(column, _SLICE):
        far, grams = known.distances(data, offsets)
        for k, n in enumerate(grams.tolist()):
            if not n or not known.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(far[k]))
            langs.append(known.langs[best])
            scores.append(float(1 - far[k, best] / (n * PROFILE)))
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])


def _guesser(shared):
    def guess(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Profiles(shared.value)
        for column in columns:
            yield _guesses(known, column)

    return F.arrow_udf(guess, "lang string, score double")


def identify(docs: DataFrame, learned: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` beside its columns (one of that name is replaced): ``lang``, ``score``.

    ``score`` is 1 minus the mean distance per n-gram over its largest value, so 1 is a profile met exactly.
    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned.
    Equal distances go to the first language by name. Profiles are a fixed number of rows per language.
    """
    rows = [(r.lang, r.gram, r.rank) for r in learned.collect()]
    guess = _guesser(docs.sparkSession.sparkContext.broadcast(rows))
    return docs.withColumn("language", guess(F.coalesce(F.col(text).cast("string"), F.lit(""))))
