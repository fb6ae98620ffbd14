"""Log-bilinear scores of texts: log-probability of every token, given the two before it.

Tokens are runs of anything but white space, A-Z lowered, and one end per text. The vocabulary is every word of the
training texts. The most frequent words are classes of their own, all others fall into classes by their first and last
letters, so ``P(word | before) = P(class | before) * P(word | class)``: the first from the model, the second from
counts over all training texts, smoothed, with room for one word unseen in each class.

The **model** is log-bilinear: each class has a vector as context and one as outcome; the vectors before a token, each
scaled by the weights of its place, add up to a prediction, and its product with an outcome's vector plus that outcome's
bias is a score. It is trained in numpy by noise-contrastive estimation: the true outcome is told from classes drawn
from their overall shares. All training texts take part: every task learns from its own triples (class two before,
class before, class), equal ones together, starting from common parameters; parameters are averaged, weighed by
triples, and the next round starts from them. Scores for **all** contexts come from batched matrix products, with the
logarithm of their sum over all classes, so probabilities add up to one; a token then costs a few look-ups.

Word counts are a table that grows with the corpus. Its most frequent part, of a fixed number of words, travels with the
tasks; other words are joined with the whole table. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from almagest.llm.common import SPACED_BYTES, Words, cut, packed, run_starts, text_slices, words

# Words that are classes of their own, and classes that all other words share.
OWN = 256
SHARED = 128
# Numbers per vector, tokens before the one predicted.
SIZE = 24
PLACES = 2
# Noise classes drawn per batch, triples per batch, times that all triples are learned from.
NOISE = 32
BATCH = 2048
ROUNDS = 2
RATE = 0.3
# A triple that occurs more often is learned from several times, so that none outweighs its batch.
HEAVY = 8
# Triples that a task puts together before it writes them, and that it holds while it learns.
TRIPLES = 1 << 22
CHUNK = 1 << 18
# Most words of the counts that travel with the tasks, slots of their table, and places tried for a word.
FREQUENT = 1 << 18
SLOTS = 1 << 20
PROBES = 4
# Parameters of this many tasks are added up at a time.
FAN = 64
# Added to every count.
SMOOTH = 0.1

_LN10 = float(np.log(10))
_SHARED_BITS = np.uint64(SHARED - 1)


def _ids(found: Words) -> np.ndarray:
    """Number of each word: a hash whose last bits are the class it shares, which follows from its first two and last two bytes."""
    last = found.end - 1
    places = (found.start, np.minimum(found.start + 1, last), np.maximum(last - 1, found.start), last)
    odd, mixed = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(last), np.uint64)
    for place in places:
        mixed = (mixed ^ found.data[place]) * odd
        mixed ^= mixed >> np.uint64(29)
    return (found.hashes & ~_SHARED_BITS) | (mixed & _SHARED_BITS)


def _tally(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers with their counts, handed on whenever many have come."""
    held, many = [], 0

    def counted() -> tuple[np.ndarray, np.ndarray]:
        values = np.sort(np.concatenate(held))
        starts = run_starts(values)
        return values[starts], np.diff(np.append(starts, len(values)))

    for part in parts:
        held.append(part)
        many += len(part)
        if many >= TRIPLES:
            yield counted()
            held, many = [], 0
    if many:
        yield counted()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n); the number of texts, which is the count of the end, comes without a word."""
    ends = 0

    def parts() -> Iterator[np.ndarray]:
        nonlocal ends
        for batch in batches:
            for data, offsets in text_slices(batch.column("text")):
                ends += len(offsets) - 1
                yield _ids(words(data, offsets, SPACED_BYTES))

    for values, counts in _tally(parts()):
        yield pa.RecordBatch.from_pydict({"word": values.view(np.int64), "n": counts})
    yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.int64()), "n": [ends]})


@dataclass
class Vocabulary:
    """What the tasks know of the words: the most frequent ones in a table of slots, totals of all."""

    keys: np.ndarray  # slot -> word, 0 for none
    slot_count: np.ndarray
    slot_class: np.ndarray
    own: int
    total: int  # tokens in training, ends included
    distinct: int
    ends: int
    class_count: np.ndarray  # tokens of each class
    class_words: np.ndarray  # words of each class

    @property
    def classes(self) -> int:
        return self.own + SHARED + 1

    @property
    def end(self) -> int:
        return self.own + SHARED

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of each word; a count of -1 for words that are not in the table."""
        classes, counts = self.own + (ids & _SHARED_BITS).astype(np.int32), np.full(len(ids), -1, np.int64)
        left = np.arange(len(ids))
        for probe in range(PROBES):
            slot = _slot(ids[left], probe)
            hit = self.keys[slot] == ids[left]
            classes[left[hit]], counts[left[hit]] = self.slot_class[slot[hit]], self.slot_count[slot[hit]]
            left = left[~hit & (self.keys[slot] != 0)]
        return classes, counts

    def base(self, counts):
        """Logarithms of the smoothed shares in all tokens."""
        return np.log10((counts + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def room(self) -> np.ndarray:
        """Per class, what the smoothed counts of its words are divided by: one unseen word has its share."""
        return self.class_count + SMOOTH * (self.class_words + 1)

    def within(self, classes, counts):
        """Logarithms of words' shares in their classes; 0 for classes of one word."""
        return np.where(self.alone()[classes], 0.0, np.log10((counts + SMOOTH) / self.room()[classes]))

    def alone(self) -> np.ndarray:
        out = np.ones(self.classes, bool)
        out[self.own : self.end] = False
        return out


def _slot(ids: np.ndarray, probe: int) -> np.ndarray:
    return ((ids >> np.uint64(7)) + np.uint64(probe)) & np.uint64(SLOTS - 1)


def _placed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, for each the number of its word or -1): words are placed in order, those that find no free place stay out."""
    held = np.full(SLOTS, -1, np.int64)
    left = np.flatnonzero(ids != 0)
    for probe in range(PROBES):
        slot = _slot(ids[left], probe)
        free = held[slot] < 0
        wanted, first = np.unique(slot[free], return_index=True)
        held[wanted] = left[free][first]
        left = left[held[slot] != left]
    keys = np.zeros(SLOTS, np.uint64)
    keys[held >= 0] = ids[held[held >= 0]]
    return keys, held


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, with the number of texts for the end, whose word is null. Written, as it is read several times."""
    counted = texts.mapInArrow(_counter, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(counted)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, and the words of the greatest counts: as many eighths of powers of two as hold at most ``FREQUENT`` words.

    What comes to the driver is bounded: one row per eighth, one per class, and ``FREQUENT`` words.
    """
    seen = counts.where("word IS NOT NULL")
    eighth = F.floor(8 * F.log2("n")).cast("int").alias("eighth")
    most, many = None, 0
    for row in sorted(seen.groupBy(eighth).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        many += row["words"]
        if many > FREQUENT:
            break
        most = row["eighth"]
    taken = seen.where(F.lit(False)) if most is None else seen.where(F.floor(8 * F.log2("n")) >= most)
    taken = taken.toArrow()
    ids, n = taken["word"].to_numpy().view(np.uint64), taken["n"].to_numpy()
    order = np.lexsort((ids, -n))
    ids, n = ids[order], n[order]
    keys, held = _placed(ids)
    inside = held >= 0
    own = int(np.flatnonzero(np.isin(np.arange(min(OWN, len(ids))), held, invert=True)).min(initial=min(OWN, len(ids))))
    classes = np.where(np.arange(len(ids)) < own, np.arange(len(ids)), own + (ids & _SHARED_BITS).astype(np.int64))
    count, kind = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
    count[inside], kind[inside] = n[held[inside]], classes[held[inside]]
    class_count, class_words = np.zeros(own + SHARED + 1, np.int64), np.zeros(own + SHARED + 1, np.int64)
    shared = F.col("word").bitwiseAND(F.lit(SHARED - 1).cast("bigint")).alias("shared")
    for row in seen.groupBy(shared).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        class_count[own + row["shared"]], class_words[own + row["shared"]] = row["n"], row["words"]
    np.subtract.at(class_count, own + (ids[:own] & _SHARED_BITS).astype(np.int64), n[:own])
    np.subtract.at(class_words, own + (ids[:own] & _SHARED_BITS).astype(np.int64), 1)
    distinct, total = int(class_words.sum()) + own, int(class_count.sum() + n[:own].sum())
    ends = counts.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    class_count[:own], class_words[:own] = n[:own], 1
    class_count[-1], class_words[-1] = ends, ends > 0
    return Vocabulary(keys, count, kind, own, total + ends, distinct + (ends > 0), ends, class_count, class_words)


def _with_ends(values: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of rows with one for the end after each row; and where rows begin in that."""
    begins = first + np.arange(len(first))
    out = np.full(begins[-1], end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = values
    return out, begins


def _before(classes: np.ndarray, begins: np.ndarray, outside: int) -> list[np.ndarray]:
    """The class at each place before a token, the nearest first; ``outside`` where a text has not yet begun."""
    out = []
    for place in range(1, PLACES + 1):
        back = np.full(len(classes), outside, np.int64)
        back[place:] = classes[:-place] if place < len(classes) else classes[:0]
        for k in range(place):
            at = begins[:-1] + k
            back[at[at < begins[1:]]] = outside
        out.append(back)
    return out


def _triples(vocabulary):
    """Triples of classes with their counts, as bytes: chunks of a few hundred thousand, in no order."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = Vocabulary(**vocabulary.value)
        for batch in batches:
            for data, offsets in text_slices(batch.column("text")):
                found = words(data, offsets, SPACED_BYTES)
                classes, begins = _with_ends(known.found(_ids(found))[0].astype(np.int64), found.first, known.end)
                one, two = _before(classes, begins, known.classes)
                yield (two * (known.classes + 1) + one) * known.classes + classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, counts in _tally(parts(batches)):
            mixed = np.random.default_rng(len(values)).permutation(len(values))
            values, counts = values[mixed], counts[mixed]
            for at in range(0, len(values), CHUNK):
                chunk = values[at : at + CHUNK], np.minimum(counts[at : at + CHUNK], np.iinfo(np.int32).max).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"triples": pa.array([chunk[0].tobytes()], pa.binary()), "times": pa.array([chunk[1].tobytes()], pa.binary())})

    return run


@dataclass
class Parameters:
    """Vectors of classes as contexts (one more for what lies before a text) and as outcomes, weights of places, biases."""

    context: np.ndarray
    outcome: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    def packed(self) -> np.ndarray:
        return np.concatenate([part.ravel() for part in (self.context, self.outcome, self.place, self.bias)])

    @classmethod
    def unpacked(cls, flat: np.ndarray, classes: int) -> Parameters:
        shapes = [(classes + 1, SIZE), (classes, SIZE), (PLACES, SIZE), (classes,)]
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
        return cls(*[part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), shapes)])

    @classmethod
    def fresh(cls, shares: np.ndarray) -> Parameters:
        """Before any learning the model gives every class its overall share."""
        draw, classes = np.random.default_rng(0), len(shares)
        context, outcome = (draw.normal(0, 0.1, (n, SIZE)).astype(np.float32) for n in (classes + 1, classes))
        return cls(context, outcome, np.ones((PLACES, SIZE), np.float32), np.log(shares).astype(np.float32))


def shares(known: Vocabulary) -> np.ndarray:
    """Overall shares of the classes, none of them zero."""
    return (known.class_count + 1) / (known.class_count + 1).sum()


def _added(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values (one line each) by row."""
    order = np.argsort(rows, kind="stable")
    starts = run_starts(rows[order])
    out = np.zeros((size, values.shape[1]), np.float32)
    out[rows[order][starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Learner:
    """Noise-contrastive steps with a rate per parameter that falls with what it has moved."""

    def __init__(self, model: Parameters, shares: np.ndarray, seed: int):
        self.m, self.draw = model, np.random.default_rng(seed)
        self.cumulative, self.noise_log = np.cumsum(shares), np.log(NOISE * shares).astype(np.float32)
        self.moved = [np.full_like(part, 1e-3) for part in (model.context, model.outcome, model.place, model.bias)]

    def step(self, before: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> None:
        m, noise = self.m, np.searchsorted(self.cumulative, self.draw.random(NOISE) * self.cumulative[-1])
        vectors = [m.context[c] for c in before]
        guess = sum(v * m.place[k] for k, v in enumerate(vectors))
        true = m.outcome[target]
        weight = weight / weight.sum()
        right = np.einsum("ij,ij->i", guess, true) + m.bias[target] - self.noise_log[target]
        wrong = guess @ m.outcome[noise].T + (m.bias[noise] - self.noise_log[noise])
        up = weight / (1 + np.exp(np.clip(right, -30, 30)))
        down = -weight[:, None] / (1 + np.exp(np.clip(-wrong, -30, 30)))
        pull = up[:, None] * true + down @ m.outcome[noise]
        outcome = _added(target, up[:, None] * guess, len(m.outcome))
        np.add.at(outcome, noise, down.T @ guess)
        bias = np.bincount(target, up, len(m.bias)).astype(np.float32)
        np.add.at(bias, noise, down.sum(axis=0))
        context = sum(_added(c, pull * m.place[k], len(m.context)) for k, c in enumerate(before))
        place = np.stack([(pull * v).sum(axis=0) for v in vectors])
        for part, moved, change in zip((m.context, m.outcome, m.place, m.bias), self.moved, (context, outcome, place, bias)):
            moved += change * change
            part += RATE * change / np.sqrt(moved)

    def learn(self, triples: np.ndarray, times: np.ndarray) -> int:
        """All triples of a chunk, heavy ones in several parts; how many steps' worth there were."""
        copies = -(-times // HEAVY)
        triples, weight = np.repeat(triples, copies), np.repeat((times / copies).astype(np.float32), copies)
        mixed = self.draw.permutation(len(triples))
        triples, weight, classes = triples[mixed], weight[mixed], len(self.m.bias)
        target, rest = triples % classes, triples // classes
        before = [rest % (classes + 1), rest // (classes + 1)]
        for at in range(0, len(triples), BATCH):
            part = slice(at, at + BATCH)
            self.step([c[part] for c in before], target[part], weight[part])
        return len(triples)


def _learners(start, chances: np.ndarray, seed: int):
    """One row per task: its parameters times the triples it has learned from, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, learned = None, 0
        for batch in batches:
            for triples, times in zip(batch.column("triples"), batch.column("times")):
                if learner is None:
                    learner = Learner(Parameters.unpacked(start.value.copy(), len(chances)), chances, seed)
                learned += learner.learn(np.frombuffer(triples.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.int32))
        if learned:
            flat = learner.m.packed().astype(np.float64) * learned
            yield pa.RecordBatch.from_pydict({"flat": pa.array([flat.tobytes()], pa.binary()), "learned": [float(learned)]})

    return run


def _adder(group: pa.Table) -> pa.Table:
    flats = [np.frombuffer(flat.as_buffer(), np.float64) for flat in group.column("flat")]
    return pa.table({"flat": pa.array([sum(flats).tobytes()], pa.binary()), "learned": [float(sum(group.column("learned").to_pylist()))]})


def train(texts: DataFrame, known: Vocabulary) -> Parameters:
    """Parameters learned from all texts; without any, every class keeps its share."""
    context = texts.sparkSession.sparkContext
    chances = shares(known)
    flat = Parameters.fresh(chances).packed()
    sent = context.broadcast(vars(known))  # plain values: tasks have no copy of the class
    triples = cut(texts.mapInArrow(_triples(sent), "triples binary, times binary"))
    for turn in range(ROUNDS):
        start = context.broadcast(flat)
        parts = cut(triples.mapInArrow(_learners(start, chances, turn), "flat binary, learned double"))
        while (many := parts.count()) > FAN:
            groups = parts.withColumn("part", F.pmod(F.xxhash64("flat"), F.lit(-(-many // FAN))))
            parts = cut(groups.groupBy("part").applyInArrow(_adder, "flat binary, learned double"))
        rows = parts.collect()
        if not rows:
            break
        flat = (sum(np.frombuffer(r["flat"], np.float64) for r in rows) / sum(r["learned"] for r in rows)).astype(np.float32)
    return Parameters.unpacked(flat, known.classes)


@dataclass
class Model:
    """Scores of every outcome for each class at each place before it, and the sum over all outcomes for each context."""

    known: Vocabulary
    parts: list[np.ndarray]  # per place: context class x outcome
    total: np.ndarray  # class two before x class before -> logarithm of the sum

    @classmethod
    def normalised(cls, known: Vocabulary, m: Parameters) -> Model:
        parts = [((m.context * m.place[k]) @ m.outcome.T).astype(np.float32) for k in range(PLACES)]
        parts[0] = parts[0] + m.bias
        total = np.empty((len(m.context), len(m.context)), np.float32)
        for two in range(len(m.context)):
            scores = parts[0] + parts[1][two]
            top = scores.max(axis=1, keepdims=True)
            total[two] = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        return cls(known, parts, total)

    def class_logs(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Logarithm (base 10) of each outcome's probability after its two classes before."""
        return (self.parts[0][one, target] + self.parts[1][two, target] - self.total[two, one]).astype(np.float64) / _LN10


def learn(texts: DataFrame, text: str = "text") -> tuple[DataFrame, Model]:
    """The table of word counts and the model of the texts; null counts as empty, no texts give even chances."""
    rows = texts.select(F.col(text).alias("text"))
    counts = count_words(rows)
    known = vocabulary(counts)
    return counts, Model.normalised(known, train(rows, known))


_FOUND = "words bigint, known bigint, base double, score double, rare array<struct<word:bigint,times:bigint>>"


def _scorer(model, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, parts, total = model.value
        m = Model(Vocabulary(**facts), parts, total)
        known = m.known
        for batch in batches:
            done = 0
            for data, offsets in text_slices(batch.column("text")):
                found, rows = words(data, offsets, SPACED_BYTES), len(offsets) - 1
                ids = _ids(found)
                classes, counts = known.found(ids)
                sequence, begins = _with_ends(classes.astype(np.int64), found.first, known.end)
                logs = m.class_logs(*_before(sequence, begins, known.classes), sequence)
                score, owner = np.add.reduceat(logs, begins[:-1]), found.rows
                sure = counts >= 0
                base = np.bincount(owner[sure], known.base(counts[sure]), rows) + known.base(known.ends)
                score += np.bincount(owner[sure], known.within(classes[sure], counts[sure]), rows)
                order = np.lexsort((ids[~sure], owner[~sure]))
                rare, rare_owner = ids[~sure][order], owner[~sure][order]
                starts = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_owner[1:] != rare_owner[:-1]))[: len(rare)])
                times = np.diff(np.append(starts, len(rare)))
                each = pa.StructArray.from_arrays([pa.array(rare[starts].view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"])
                lists = pa.ListArray.from_arrays(np.searchsorted(rare_owner[starts], np.arange(rows + 1)).astype(np.int32), each)
                columns = [
                    batch.column("row").slice(done, rows), pa.array(np.diff(found.first)), pa.array(np.bincount(owner[sure], minlength=rows)),
                    pa.array(base), pa.array(score), lists,
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)
                done += rows

    return run


def score(docs: DataFrame, counts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, then ``lm``: tokens, known (seen in training), base (sum of the logarithms, base 10, of smoothed
    shares) and score (logarithm of the model's probability of the text).

    A null text is empty and consists of its end. Other columns stay as they are, but one named ``lm`` gives way; rows may
    repeat. A frame of nothing but texts keeps them.
    """
    known = model.known
    kept = docs.drop(text, "lm")
    rows = docs.select(packed(kept if kept.columns else docs.select(text)).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(_FOUND).fields])
    sent = docs.sparkSession.sparkContext.broadcast((vars(known), model.parts, model.total))
    # Written once: rows get numbers here that must be the same wherever they are read.
    found = cut(rows.mapInArrow(_scorer(sent, schema), schema).withColumn("number", F.monotonically_increasing_id()))
    asked = found.select("number", F.explode("rare").alias("one")).select("number", "one.word", "one.times")
    met = asked.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    room = F.array(*[F.lit(float(x)) for x in known.room()[known.own : known.end]])
    shared = F.col("word").bitwiseAND(F.lit(SHARED - 1).cast("bigint")).cast("int")
    smoothed = F.col("n") + F.lit(SMOOTH)
    rare = met.groupBy("number").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(smoothed / F.lit(known.total + SMOOTH * (known.distinct + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10(smoothed / F.get(room, shared))).alias("rare_score"),
    )
    lm = F.struct(
        (F.col("words") + 1).alias("tokens"), (F.col("known") + F.coalesce("more", F.lit(0)) + int(known.ends > 0)).alias("known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
    return found.join(rare, "number", "left").select("row.*", lm.alias("lm"))
