"""Toxic documents: a learned lexicon, met within a few edits, weighed by what stands around.

Terms are words, and stems of words, that labelled toxic documents hold far more often than others. They form
a trie; a Levenshtein automaton over it reads the different words of a batch in sorted order, so that words share
the states of their common beginnings and whole ranges of words die with the first letters. A hit is
then weighed by its context window: within quotation marks or beside words of reporting it counts less,
beside words of address more. A logistic model turns a document's hits into a score.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator  # the form that Arrow functions are recognised by

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import WORD_BYTES, Words, cut, drawn, mixed, run_starts, text_slices, words

# Labelled documents per label that models are fitted on at most: those of the least hashes of their ids.
SAMPLE = 20_000
# Parts of the sample, each weighed with the lexicon of the others.
FOLDS = 5
# Smallest hashes that tell near copies in the sample: documents that share one of them teach once.
SIGNS = 3
# Letters of a stem: a term that ends in STEM is met by every word that begins with it.
STEMS = range(4, 9)
STEM = "*"
# How much likelier a toxic document must hold a term.
RATIO = 8.0
# Words on each side of a hit that weigh it.
WINDOW = 5
CUTOFF = 0.3

# Cue words, of the languages at hand. Fixed values.
CUES = {
    "reporting": "said says called calls wrote writes quote quoted word term phrase sagte sagt nannte schrieb wort zitat dit disait appelle mot terme dijo dice llama palabra termino",
    "address": "you your youre ur du dich dir dein ihr euch tu te toi vous votre eres usted ustedes ti",
}
QUOTES = "“”„‟«»"

_FEATURES = 6


def edits_for(term: str) -> int:
    """Edits within which a term is met: short words and stems would meet half the language."""
    return 0 if term.endswith(STEM) else 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Lexicon:
    """Trie of terms, read through a Levenshtein automaton: a state is a set of (node, edits so far)."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.stem_at: list[int] = [-1]
        self.room = [0]  # most edits that any term below a node allows
        for index, term in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], edits_for(term))
            for letter in term.removesuffix(STEM):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.stem_at.append(-1)
                    self.room.append(0)
                node = self.children[node][letter]
                self.room[node] = max(self.room[node], edits_for(term))
            (self.stem_at if term.endswith(STEM) else self.term_at)[node] = index

    def start(self) -> dict[int, int]:
        return self._closed({0: 0})

    def _closed(self, states: dict[int, int]) -> dict[int, int]:
        """With the states that follow by leaving out letters of a term."""
        todo = list(states.items())
        while todo:
            node, edits = todo.pop()
            if edits > states[node]:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.room[child] and edits + 1 < states.get(child, 99):
                    states[child] = edits + 1
                    todo.append((child, edits + 1))
        return states

    def step(self, states: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, edits in states.items():
            for other, child in self.children[node].items():
                cost = edits + (other != letter)
                if cost <= self.room[child] and cost < out.get(child, 99):
                    out[child] = cost
            if edits + 1 <= self.room[node] and edits + 1 < out.get(node, 99):
                out[node] = edits + 1
        return self._closed(out)

    def best(self, states: dict[int, int]) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that ends here."""
        ends = [(edits, self.term_at[node]) for node, edits in states.items() if self.term_at[node] >= 0]
        ends = [(edits, term) for edits, term in ends if edits <= edits_for(self.terms[term])]
        return min(ends, default=None)

    def meet(self, vocabulary: list[str]) -> dict[str, tuple[int, int]]:
        """Words within reach of a term -> (edits, term). Words that begin alike share the work."""
        found, stack, stems, path = {}, [self.start()], [-1], ""
        for word in sorted(vocabulary):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del stack[shared + 1 :], stems[shared + 1 :]
            while len(stack) <= len(word) and stack[-1]:
                stack.append(self.step(stack[-1], word[len(stack) - 1]))
                begun = max((self.stem_at[node] for node, edits in stack[-1].items() if not edits), default=-1)
                stems.append(stems[-1] if stems[-1] >= 0 else begun)
            path = word[: len(stack) - 1]
            hit = self.best(stack[-1]) if len(stack) == len(word) + 1 else None
            if stems[-1] >= 0 and (hit is None or hit[0]):
                found[word] = (0, stems[-1])
            elif hit:
                found[word] = hit
        return found


def _sample(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> DataFrame:
    """(text, label, part) of the labelled documents to learn from; ``part`` deals them at random. Written: a bounded table.

    Near copies teach once: of documents with one label that share a least hash of their three-word shingles, the one of the
    least draw stays, for each of ``SIGNS`` hashes in turn.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND key IS NOT NULL")
    marked = marked.groupBy("key").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64(F.col("key").cast("string")))
    taken = drawn(marked, "label", "draw", sample)
    limits = {r.label: r.limit for r in taken.groupBy("label").agg(F.max("draw").alias("limit")).collect()}
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64(F.col("key").cast("string")))
    # No document beyond both limits can be in the sample: most texts go no further than the scan.
    rows = rows.where(F.col("draw") <= max(limits.values(), default=-(1 << 63)))
    part = F.pmod(F.shiftright("draw", 8), F.lit(FOLDS)).alias("part")
    # At most ``sample`` short rows per label: sent along, so that no text is dealt.
    signs = ", ".join(f"sign{k} long" for k in range(SIGNS))
    found = rows.join(F.broadcast(taken.select("key", "label")), "key").select("text", "label", part, "draw")
    found = cut(found.mapInArrow(_signed, f"text string, label int, part long, draw long, {signs}"))
    light = found.drop("text")
    for k in range(SIGNS):
        least = F.min("draw").over(Window.partitionBy("label", f"sign{k}"))
        light = light.withColumn("least", least).where("draw = least")
    return found.join(F.broadcast(light.select("draw").distinct()), "draw", "left_semi").select("text", "label", "part")


def _signed(batches):
    """With the least hashes of each text's three-word shingles; shorter texts are one shingle."""
    for batch in batches:
        signs = []
        for data, offsets in text_slices(batch.column("text")):
            found = words(data, offsets, WORD_BYTES)
            hashes, rows = found.hashes, len(offsets) - 1
            after = [np.concatenate([hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)]) for k in range(3)]
            # The last two of a row reach into the next: only rows of fewer than three words use them.
            place = np.arange(len(hashes)) - found.first[found.rows]
            left = found.first[found.rows + 1] - found.first[found.rows] - place
            parts = [np.where(left > k, part, 0) * np.uint64(2 * k + 1) for k, part in enumerate(after)]
            whole = (left >= 3) | (place == 0)
            shingle = mixed(parts[0] ^ mixed(parts[1] ^ mixed(parts[2])))[whole]
            owner = found.rows[whole]
            out = np.zeros((rows, SIGNS), np.uint64)
            starts = run_starts(owner)
            for k in range(SIGNS):
                if len(starts):
                    out[owner[starts], k] = np.minimum.reduceat(mixed(shingle + np.uint64(k + 1)), starts)
            signs.append(out)
        every = np.concatenate(signs) if signs else np.zeros((0, SIGNS), np.uint64)
        columns = [batch.column(c) for c in ("text", "label", "part", "draw")] + [pa.array(every[:, k].view(np.int64)) for k in range(SIGNS)]
        yield pa.RecordBatch.from_arrays(columns, ["text", "label", "part", "draw", *(f"sign{k}" for k in range(SIGNS))])


# Clean and toxic documents of each part that hold a word.
_HELD = [f"{kind}{k}" for kind in "ct" for k in range(FOLDS)]


def _vocabulary(batches):
    """Per slice: word or stem, and documents of each label and part that hold it."""
    for batch in batches:
        label, part = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("label", "part"))
        done = 0
        for data, offsets in text_slices(batch.column("text")):
            found = words(plain_marks(data), offsets, WORD_BYTES)
            kind = (label * FOLDS + part)[done : done + len(offsets) - 1]
            done += len(offsets) - 1
            distinct, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
            names = decoded(found, first)
            yield _holders(names, back, found.rows, kind)
            for size in STEMS:
                long = np.array([len(w) > size for w in names], bool)
                stems, to = np.unique([w[:size] + STEM for w, keep in zip(names, long) if keep] or [""], return_inverse=True)
                place = np.full(len(names), -1, np.int64)
                place[long] = to[: int(long.sum())]
                held = place[back] >= 0
                yield _holders(stems.tolist(), place[back][held], found.rows[held], kind)


def _holders(names: list[str], which: np.ndarray, row: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Rows of each kind in which each name occurs."""
    pairs = np.unique(which.astype(np.int64) * len(kind) + row)
    kinds = 2 * FOLDS
    counts = np.bincount(pairs // max(1, len(kind)) * kinds + kind[pairs % max(1, len(kind))], minlength=kinds * len(names)).reshape(-1, kinds)
    columns = [pa.array(names, pa.string()), *(pa.array(counts[: len(names), k].astype(np.int64)) for k in range(kinds))]
    return pa.RecordBatch.from_arrays(columns, ["word", *_HELD])


def decoded(found: Words, which: np.ndarray) -> list[str]:
    data = found.data.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(found.start[which].tolist(), found.end[which].tolist())]


def _surprise(t: float, c: float, totals: tuple[int, int]) -> tuple[float, float]:
    """(likelihood ratio of a word's documents being toxic by chance, how much likelier a toxic document holds it)."""
    base = totals[0] / sum(totals)
    part = lambda x, e: x * np.log(x / e) if x > 0 else 0.0
    ratio = 2 * (part(t, (t + c) * base) + part(c, (t + c) * (1 - base)))
    return ratio, (t + 0.5) / (totals[0] + 1) / ((c + 0.5) / (totals[1] + 1))


def _candidates(counts: DataFrame, totals: tuple[int, int], size: int) -> dict[str, tuple[int, int]]:
    """Words, with their toxic and clean documents, that are toxic too often for chance (Bonferroni over all words)."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    base = totals[0] / max(1, sum(totals))
    if not 0 < base < 1:
        return {}
    log = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    ratio = 2 * (log(t, (t + c) * base) + log(c, (t + c) * (1 - base)))
    often = (t + 0.5) / (totals[0] + 1) / ((c + 0.5) / (totals[1] + 1))
    marked = counts.where((ratio >= _limit(size)) & (often >= RATIO) & (F.col("word") != ""))
    return {r.word: (r.t, r.c) for r in marked.select("word", "t", "c").collect()}


def _limit(size: int) -> float:
    return 2 * (np.log(max(size, 1)) + 3)


def _contexts(rows: DataFrame, terms: list[str]) -> dict[str, list[int]]:
    """term -> different neighbours it has in toxic documents beside each part, and in all: the fewer of those before and after it.

    Copies of one document share neighbours, so a word is not taken for a term because a toxic text was copied.
    """
    def met(batches):
        plain, stems = {w for w in terms if not w.endswith(STEM)}, {w for w in terms if w.endswith(STEM)}
        for batch in batches:
            part, done = np.asarray(batch.column("part").to_numpy(zero_copy_only=False), np.int64), 0
            for data, offsets in text_slices(batch.column("text")):
                found = words(plain_marks(data), offsets, WORD_BYTES)
                row = found.rows
                own = part[done : done + len(offsets) - 1]
                done += len(offsets) - 1
                distinct, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
                hits: dict[int, list[str]] = {}
                for k, w in enumerate(decoded(found, first)):
                    of = [w] * (w in plain) + [w[:n] + STEM for n in STEMS if n < len(w) and w[:n] + STEM in stems]
                    if of:
                        hits[k] = of
                before, after = np.zeros_like(found.hashes), np.zeros_like(found.hashes)
                if len(row) > 1:
                    same = row[1:] == row[:-1]
                    before[1:], after[:-1] = np.where(same, found.hashes[:-1], 0), np.where(same, found.hashes[1:], 0)
                at = np.flatnonzero(np.isin(back, np.fromiter(hits, np.int64, len(hits))))
                named = [(t, int(i)) for i in at.tolist() for t in hits[int(back[i])]]
                places = np.array([i for _, i in named], np.int64)
                columns = [pa.array([t for t, _ in named], pa.string()), pa.array(own[row[places]] if len(places) else np.zeros(0, np.int64))]
                columns += [pa.array(x[places].view(np.int64)) for x in (before, after)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "part", "before", "after"])

    seen = rows.where("label = 1").select("text", "part").mapInArrow(met, "term string, part long, before long, after long").distinct()
    # A neighbour is beside a part if it stands in another: in two parts, or in one that is not this.
    sides = []
    for c in ("before", "after"):
        parts = seen.groupBy("term", c).agg(F.collect_set("part").alias("parts"))
        fewer = [F.count_if(F.size(F.array_remove("parts", k)) > 0).alias(f"{c}{k}") for k in range(FOLDS)]
        sides.append(parts.groupBy("term").agg(*fewer, F.count(F.lit(1)).alias(f"{c}{FOLDS}")))
    both = sides[0].join(sides[1], "term").select("term", F.array(*[F.least(f"before{k}", f"after{k}") for k in range(FOLDS + 1)]).alias("n"))
    return {r.term: list(r.n) for r in both.collect()}


def _terms(found: dict[str, tuple[int, int]], contexts: dict[str, int], totals: tuple[int, int], size: int) -> list[str]:
    """Candidates that stay surprising when only different contexts count."""
    best = {}
    for word, (t, c) in found.items():
        own = min(t, contexts.get(word, 0))
        ratio, often = _surprise(own, c, totals)
        if ratio >= _limit(size) and often >= RATIO:
            best[word] = own
    return _settled(best)


def _settled(best: dict[str, float]) -> list[str]:
    """All words, and the stems that no other covers.

    A word that a stem covers stays, as only words are met within edits: a stem adds words that begin with it. A stem stays if it meets clearly more than its commonest word does and no longer stem meets nearly as much.
    """
    words_of = {w: t for w, t in best.items() if not w.endswith(STEM)}
    stems = {w.removesuffix(STEM): t for w, t in best.items() if w.endswith(STEM)}
    wide = {s: t for s, t in stems.items() if t >= 1.3 * max((n for w, n in words_of.items() if w.startswith(s)), default=0)}
    sharp = {s for s, t in wide.items() if not any(o != s and o.startswith(s) and n >= 0.9 * t for o, n in wide.items())}
    covered = lambda w: any(w.startswith(s) and w != s for s in sharp)
    return sorted([*words_of] + [s + STEM for s in sharp if not covered(s)])


def features(found: Words, lexicon: Lexicon, exact: dict, near: dict, raw: np.ndarray) -> np.ndarray:
    """rows x ``_FEATURES``: log of hits and of near hits, best weight, summed weight, density, share that is quoted."""
    rows = len(found.first) - 1
    out = np.zeros((rows, _FEATURES))
    if not len(found.hashes):
        return out
    owner = found.rows
    kind = np.zeros(len(found.hashes), np.int8)
    for grade, table in ((1, exact), (2, near)):
        if table:
            kind[np.isin(found.hashes, np.fromiter(table, np.uint64, len(table)))] = grade
    hits = np.flatnonzero(kind)
    if not len(hits):
        return out
    low = np.maximum(found.first[owner[hits]], hits - WINDOW)
    high = np.minimum(found.first[owner[hits] + 1], hits + WINDOW + 1)
    cues = {name: np.concatenate([[0], np.cumsum(np.isin(found.hashes, _cue_hashes(name)))]) for name in CUES}
    reported, addressed = (cues[name][high] > cues[name][low] for name in ("reporting", "address"))
    marks = np.concatenate([[0], np.cumsum(raw == 0x22)])
    opened = marks[found.start[hits]] > marks[found.start[low]]
    closed = marks[found.end[high - 1]] > marks[found.end[hits]]
    quoted = opened & closed
    weight = np.where(kind[hits] == 1, 1.0, 0.7) * np.where(quoted | reported, 0.4, 1.0) * np.where(addressed & ~quoted, 1.2, 1.0)
    row = owner[hits]
    out[:, 0] = np.log1p(np.bincount(row[kind[hits] == 1], minlength=rows))
    out[:, 1] = np.log1p(np.bincount(row[kind[hits] == 2], minlength=rows))
    np.maximum.at(out[:, 2], row, weight)
    out[:, 3] = np.log1p(np.bincount(row, weight, rows))
    size = np.maximum(1, np.diff(found.first))
    out[:, 4] = np.sqrt(out[:, 3] / size)
    out[:, 5] = np.bincount(row, quoted | reported, rows) / np.maximum(1, np.bincount(row, minlength=rows))
    return out


_cues: dict[str, np.ndarray] = {}


def _cue_hashes(name: str) -> np.ndarray:
    if name not in _cues:
        text = pa.array([CUES[name]], pa.large_string())
        _cues[name] = np.concatenate([words(d, o, WORD_BYTES).hashes for d, o in text_slices(text)])
    return _cues[name]


def plain_marks(data: np.ndarray) -> np.ndarray:
    """Bytes with typographic quotation marks as ``"`` and other general punctuation as blanks, in the same places.

    Words here hold all bytes beyond ASCII, so these marks would stick to them.
    """
    out = data.copy()
    two = np.flatnonzero(data[:-1] == 0xC2)
    for sign in QUOTES:
        code = sign.encode()
        if len(code) == 2:
            at = two[data[two + 1] == code[1]]
            out[at], out[at + 1] = 0x22, 0x20
    three = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
    three = three[data[three + 1] == 0x80]
    marks = [sign.encode()[2] for sign in QUOTES if len(sign.encode()) == 3]
    out[three] = np.where(np.isin(data[three + 2], marks), 0x22, 0x20)
    out[three + 1] = out[three + 2] = 0x20
    return out


class Reader:
    """Features of texts, with what is known of words so far."""

    # Words remembered as out of every term's reach; beyond it the memory starts anew.
    MEMORY = 2_000_000

    def __init__(self, terms: list[str], ordinary: list[str]) -> None:
        self.lexicon = Lexicon(terms)
        self.ordinary = set(ordinary)
        self.exact: dict[int, int] = {}
        self.near: dict[int, int] = {}
        self.judged = np.zeros(0, np.uint64)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data = plain_marks(data)
        found = words(data, offsets, WORD_BYTES)
        distinct, first = np.unique(found.hashes, return_index=True)
        new = ~np.isin(distinct, self.judged, assume_unique=True)
        names = decoded(found, first[new])
        hashed = dict(zip(names, distinct[new].tolist()))
        for word, (edits, term) in self.lexicon.meet(names).items():
            if not edits and not self.lexicon.terms[term].endswith(STEM):
                self.exact[hashed[word]] = term
            elif word not in self.ordinary:
                self.near[hashed[word]] = term
        if len(self.judged) > self.MEMORY:
            self.judged, self.exact, self.near = distinct, self._kept(self.exact, distinct), self._kept(self.near, distinct)
        else:
            self.judged = np.union1d(self.judged, distinct[new])
        return features(found, self.lexicon, self.exact, self.near, data)

    @staticmethod
    def _kept(table: dict[int, int], distinct: np.ndarray) -> dict[int, int]:
        here = set(distinct.tolist())
        return {h: t for h, t in table.items() if h in here}


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _featured(terms: list[str], ordinary: list[str]):
    def read(batches):
        reader = Reader(terms, ordinary)
        for batch in batches:
            label, done = batch.column("label"), 0
            for data, offsets in text_slices(batch.column("text")):
                x = reader.read(data, offsets)
                part = label.slice(done, len(x))
                done += len(x)
                yield pa.RecordBatch.from_arrays([part, *(pa.array(x[:, k]) for k in range(_FEATURES))], ["label", *(f"x{k}" for k in range(_FEATURES))])

    return read


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE
) -> tuple[list[str], list[str], list[float]]:
    """(terms, ordinary words, weights) from at most ``sample`` labelled documents of each label.

    The sample is dealt into ``FOLDS`` parts; hits in each are weighed with the lexicon that the others teach, as they
    are in unseen text, and the lexicon that is returned is that of all of it. A part whose others teach no term
    though all do weighs nothing; if that holds for every part, the lexicon's own documents are weighed. A key with
    several labels counts as toxic if one of them does; rows without a label or key teach nothing. With no toxic or
    no clean document the lexicon is empty and every score that of the base rate.
    """
    rows = _sample(docs, labels, text, key, label, sample)
    sizes = {(r.label, r.part): r.n for r in rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.mapInArrow(_vocabulary, "word string, " + ", ".join(f"{c} long" for c in _HELD))
    counts = cut(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in _HELD]))
    size = counts.count()

    def beside(part: int | None) -> tuple[DataFrame, tuple[int, int]]:
        """Counts and totals of all parts but one."""
        others = [k for k in range(FOLDS) if k != part]
        t, c = (sum(F.col(f"{kind}{k}") for k in others).alias(kind) for kind in "tc")
        return counts.select("word", t, c), tuple(sum(sizes.get((mark, k), 0) for k in others) for mark in (1, 0))

    taught = [beside(part) for part in (*range(FOLDS), None)]
    found = [_candidates(held, totals, size) for held, totals in taught]
    contexts = _contexts(rows, sorted({word for words_ in found for word in words_}))
    terms = [
        _terms(own, {w: n[k] for w, n in contexts.items()}, totals, size) for k, (own, (_, totals)) in enumerate(zip(found, taught))
    ]
    ordinary = [_ordinary(held, own, totals) for own, (held, totals) in zip(terms, taught)]
    weighed = [(rows.where(F.col("part") == k), k) for k in range(FOLDS) if terms[k] or not terms[FOLDS]] or [(rows, FOLDS)]
    kind = "label int, " + ", ".join(f"x{k} double" for k in range(_FEATURES))
    read = [part.select("text", "label").mapInArrow(_featured(terms[k], ordinary[k]), kind) for part, k in weighed]
    table = reduce(DataFrame.unionByName, read).toPandas()
    y = table["label"].to_numpy(float)
    x = table.drop(columns="label").to_numpy(float)
    return terms[FOLDS], ordinary[FOLDS], _fit(x, y).tolist()


def _ordinary(counts: DataFrame, terms: list[str], totals: tuple[int, int]) -> list[str]:
    """Words of clean documents that only resemble a term and are not much likelier in toxic ones."""

    def near(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            names = batch.column("word").to_pylist()
            hits = lexicon.meet(names)
            keep = pa.array([w in hits and terms[hits[w][1]] != w for w in names], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("word").filter(keep)], ["word"])

    often = (F.col("t") + 0.5) / (totals[0] + 1) / ((F.col("c") + 0.5) / (totals[1] + 1))
    rows = counts.where((F.col("c") > 0) & (often < RATIO) & ~F.endswith("word", F.lit(STEM))).select("word")
    return sorted(r.word for r in rows.mapInArrow(near, "word string").collect())


def _scorer(shared):
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, ordinary, weights = shared.value
        reader, w = Reader(terms, ordinary), np.array(weights)
        for column in columns:
            parts = [np.zeros(0)]
            for data, offsets in text_slices(column):
                x = np.column_stack([reader.read(data, offsets), np.ones(len(offsets) - 1)])
                parts.append(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))
            yield pa.array(np.concatenate(parts))

    return F.arrow_udf(score, "double")


def score(docs: DataFrame, model: tuple[list[str], list[str], list[float]], text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) beside its columns (one of that name is replaced).

    Whole texts are read; null and empty ones have no hits. The model is of bounded size: see ``learn``.
    """
    judge = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    return docs.withColumn("toxicity", judge(F.coalesce(F.col(text).cast("string"), F.lit(""))))
