"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts its documents into shards and builds a suffix array over a shard's words: suffixes are
sorted by packed four-word keys, ties by prefix doubling, as deep as the longest test item. Every test
suffix is then binary-searched in every shard. Words are ordered by a 16-bit code of their 64-bit hash; what
the codes find is confirmed on the full hashes. Nothing is shuffled, and a lost task redoes only its shards.
"""

from __future__ import annotations

import hashlib
from typing import Iterator  # the form that Arrow functions are recognised by

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import WORD_BYTES, cut, mixed, run_starts, text_slices, words

# Words that must match in a row; an item with fewer is one window of its own length.
WINDOW = 10
# Bytes of benchmark text that tasks hold at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8 << 20

_FOUND = "spans array<struct<first: long, last: long>>, items array<string>, longest long, words long"


def codes(hashes: np.ndarray) -> np.ndarray:
    """16-bit code of a word, never 0: zero ends a document."""
    return ((hashes >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)


def _keys(text: np.ndarray) -> np.ndarray:
    """Next four codes as one number, zero beyond the end."""
    padded = np.concatenate([text, np.zeros(3, np.uint64)])
    n = len(text)
    sixteen = np.uint64(16)
    return ((padded[:n] << sixteen | padded[1 : n + 1]) << sixteen | padded[2 : n + 2]) << sixteen | padded[3 : n + 3]


class SuffixArray:
    """Suffixes of a code sequence in order of their first ``depth`` codes at least."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.keys = text, _keys(text)
        self.order = np.argsort(self.keys, kind="stable")
        n, ordered = len(text), self.keys[self.order]
        group = np.zeros(n, np.int64)  # of each place in order: where its group of ties begins
        starts = run_starts(ordered)
        group[starts] = starts
        np.maximum.accumulate(group, out=group)
        rank = np.empty(n, np.int64)
        rank[self.order] = group
        done = 4
        while done < depth:
            sizes = np.diff(np.append(starts, n))
            tied = np.repeat(sizes > 1, sizes)
            places = np.flatnonzero(tied)
            if not len(places):
                break
            suffixes = self.order[places]
            beyond = suffixes + done
            follow = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
            by = np.lexsort((follow, group[places]))
            suffixes, follow, own = suffixes[by], follow[by], group[places][by]
            self.order[places] = suffixes
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])]))
            fresh = np.zeros(len(places), np.int64)
            fresh[new] = places[new]
            np.maximum.accumulate(fresh, out=fresh)
            group[places] = fresh
            rank[suffixes] = fresh
            starts = np.flatnonzero(group == np.arange(n))
            done *= 2

    def bounds(self, pattern: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of places whose suffixes start with each pattern ``pattern[begin : begin + length]``."""
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.order), np.int64)
        wanted = _keys(pattern)
        for step in range(0, int(length.max(initial=0)), 4):
            live = np.flatnonzero((length > step) & (low < high))
            if not len(live):
                break
            left = np.minimum(length[live] - step, 4)
            drop = ((4 - left) * 16).astype(np.uint64)
            target = wanted[begin[live] + step] >> drop
            low[live], high[live] = (
                self._edge(target, drop, step, low[live], high[live], right) for right in (False, True)
            )
        return low, high

    def _edge(self, target, drop, step, low, high, right):
        low, high, n = low.copy(), high.copy(), len(self.order)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            at = self.order[middle] + step
            key = np.where(at < n, self.keys[np.minimum(at, n - 1)], np.uint64(0)) >> drop[live]
            under = key <= target[live] if right else key < target[live]
            low[live[under]] = middle[under] + 1
            high[live[~under]] = middle[~under]


class Benchmark:
    """Test items as one code sequence; every word begins a test suffix."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        column = pa.array(texts, pa.large_string())
        parts = [words(data, offsets, WORD_BYTES) for data, offsets in text_slices(column, 1 << 62)]
        self.hashes = parts[0].hashes if parts else np.zeros(0, np.uint64)
        first = parts[0].first if parts else np.zeros(1, np.int64)
        size = np.diff(first)
        item = np.repeat(np.arange(len(size)), size)
        left = np.repeat(first[1:], size) - np.arange(len(item))
        self.length = np.minimum(window, size)[item] if len(item) else np.zeros(0, np.int64)
        begin = np.flatnonzero(left >= self.length)
        item, length, self.left = item[begin], self.length[begin], left[begin]
        self.window, self.begins, self.names = window, begin, ids
        # Equal windows are one class: it is searched once, and lists the items that hold it.
        code = length.astype(np.uint64)
        for k in range(int(length.max(initial=0))):
            live = length > k
            code[live] = mixed(code[live] ^ self.hashes[begin[live] + k])
        self.code = code
        _, first_of, own = np.unique(code, return_index=True, return_inverse=True)
        self.begin, self.length = begin[first_of], length[first_of]
        pairs = np.unique(np.stack([own.ravel(), item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.items, self.items_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first_of) + 1))
        self.text, self.depth = codes(self.hashes), int(size.max(initial=1))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """Occurrences of test windows in a shard: row, first word in the row, words that match on, class of window; row sizes.

        A place of a text holds at most one class of each length, however often a window is repeated in the items.
        """
        shard = words(data, offsets, WORD_BYTES)
        size = np.diff(shard.first)
        row = shard.rows
        # One zero between documents: no match runs over it.
        place = np.arange(len(row)) + row
        text = np.zeros(len(row) + len(size), np.uint64)
        text[place] = codes(shard.hashes)
        if not len(row) or not len(self.begin):
            return (*(np.zeros(0, np.int64) for _ in range(4)), size)
        array = SuffixArray(text, self.depth)
        low, high = array.bounds(self.text, self.begin, self.length)
        hits = high - low
        window = np.repeat(np.arange(len(hits)), hits)
        within = np.arange(len(window)) - np.repeat(np.cumsum(hits) - hits, hits)
        found = array.order[low[window] + within]
        word_at = np.full(len(text), -1, np.int64)
        word_at[place] = np.arange(len(row))
        found = word_at[found]
        sure = self._same(shard.hashes, found, window)
        found, window = found[sure], window[sure]
        longest = self._extended(shard, row, found, window)
        return row[found], found - shard.first[row[found]], longest, window, size

    def _same(self, hashes, found, window):
        sure = np.ones(len(found), bool)
        for k in range(int(self.length.max(initial=0))):
            live = np.flatnonzero(sure & (self.length[window] > k))
            sure[live] = hashes[found[live] + k] == self.hashes[self.begin[window[live]] + k]
        return sure

    def _extended(self, shard, row, found, window):
        """Words from each place on that some item holds in a row, at least its window's.

        Word by word: a match goes on while its words so far and the next are those of some item from one of its windows on, by
        their hashes. Every round looks at the places and the items' windows once, so repeats cost no pairs.
        """
        longest = self.length[window].copy()
        # Only whole windows go on; shorter items have matched to their end.
        live = np.flatnonzero(longest == self.window)
        end = shard.first[row[found] + 1] - found
        mine = np.flatnonzero(self.left > self.window)
        own, theirs = self._codes(shard.hashes, found[live], self.window), self._codes(self.hashes, self.begins[mine], self.window)
        size = self.window
        while len(live) and len(mine):
            keep = end[live] > size
            live, own = live[keep], own[keep]
            own, theirs = mixed(own ^ shard.hashes[found[live] + size]), mixed(theirs ^ self.hashes[self.begins[mine] + size])
            keep = np.isin(own, theirs)
            live, own = live[keep], own[keep]
            size += 1
            longest[live] = size
            # Of the items' places those that a text still follows and that go on.
            keep = np.isin(theirs, own) & (self.left[mine] > size)
            mine, theirs = mine[keep], theirs[keep]
        return longest

    @staticmethod
    def _codes(hashes, begin, size):
        code = np.full(len(begin), size, np.uint64)
        for k in range(size):
            code = mixed(code ^ hashes[begin + k])
        return code


def joined_spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans of words, ends exclusive."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _found(bench: Benchmark, column: pa.Array) -> pa.StructArray:
    spans, items, longest, sizes = [], [], [], []
    for data, offsets in text_slices(column):
        row, first, length, window, size = bench.search(data, offsets)
        by = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[by], np.arange(len(size) + 1))
        for k, n in enumerate(size.tolist()):
            own = by[edges[k] : edges[k + 1]]
            sizes.append(n)
            longest.append(int(length[own].max(initial=0)))
            if not len(own):
                spans.append([])
                items.append([])
                continue
            begin = first[own]
            ends = begin + bench.length[window[own]]
            pairs = np.unique(np.stack([begin, ends], 1), axis=0)
            spans.append([{"first": a, "last": b} for a, b in joined_spans(pairs[:, 0], pairs[:, 1])])
            held = [bench.items[bench.items_from[w] : bench.items_from[w + 1]] for w in np.unique(window[own]).tolist()]
            items.append(sorted({bench.names[i] for i in np.unique(np.concatenate(held)).tolist()}))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.StructArray.from_arrays(
        [pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array(sizes, pa.int64())],
        names=["spans", "items", "longest", "words"],
    )


def _searcher(shared, window: int):
    """Arrow function that searches one block of the benchmark in the rows' texts."""

    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench = Benchmark(*shared.value, window)
        for column in columns:
            yield _found(bench, column)

    return F.arrow_udf(search, _FOUND)


def _blocks(benchmark: DataFrame, text: str, item: str, limit: int) -> Iterator[tuple[list[str], list[str]]]:
    """Test items in blocks of at most ``limit`` bytes (one longer item is a block alone), fetched one after the other."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    ids, texts, size = [], [], 0
    for row in rows.distinct().sort("item", "text").toLocalIterator():
        if ids and size + len(row.text) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item)
        texts.append(row.text)
        size += len(row.text)
    yield ids, texts


def matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``found`` beside its columns (any column of that name is replaced).

    ``found``: ``spans`` (hit words, ends exclusive, joined), ``items`` (ids of items with a window in the
    document, sorted as text), ``longest`` (words of the longest verbatim match), ``words``. Null and empty
    texts have no words. Items without words match nothing; repeated items count once; an item without an id
    is listed as the empty string. An empty benchmark leaves all documents clean.

    The benchmark is a stated query set: it is searched in blocks of at most ``block_bytes``, one after the
    other over the same rows, with the findings so far written between, so what tasks hold does not grow with it.
    """
    context = docs.sparkSession.sparkContext
    out = docs
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    before = None
    for block in _blocks(benchmark, bench_text, item, block_bytes):
        if before is not None:
            out = cut(out)
            before.unpersist()
        shared = context.broadcast(block)
        own = _searcher(shared, window)(column)
        out = out.withColumn("found", own if before is None else _merged(F.col("found"), own))
        before = shared
    return out


def _merged(one, other):
    """Findings of two blocks in one; spans may overlap and are joined again."""
    spans = F.array_sort(F.concat(one["spans"], other["spans"]))
    start = F.slice(spans, 1, 0)
    joined = F.aggregate(
        spans, start,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return F.struct(
        joined.alias("spans"),
        F.array_sort(F.array_distinct(F.concat(one["items"], other["items"]))).alias("items"),
        F.greatest(one["longest"], other["longest"]).alias("longest"),
        one["words"].alias("words"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; columns as they were."""
    names = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    text = f"c{names.index(options.pop('text', 'text'))}"
    kept = matches(held, benchmark, text, **options).where("size(found.spans) = 0")
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def items_digest(items: list[str]) -> str:
    """What the digest column of the report holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
