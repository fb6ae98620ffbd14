"""Log-bilinear scores: counts and base against a plain version, probabilities that add up, better than shares on texts held out."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.llm import lbl_scoring, queries
from almagest.llm.common import SPACED_BYTES, words
from made_documents import DATA, make  # noqa: F401


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain_base(train, texts):
    counts = Counter(t for text in train for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    share = lambda t: math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1)))
    return total, [(len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(map(share, tokens(x)))) for x in texts]


def word_id(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return lbl_scoring._ids(words(data, np.array([0, len(data)]), SPACED_BYTES))[0]


def plain_score(model, train, text):
    """Token by token, every probability from the whole list of scores."""
    known, before, logs = model.known, [model.known.classes] * 2, 0.0
    counts = Counter(t for x in train for t in tokens(x))
    own = {int(known.keys[s]): int(known.slot_class[s]) for s in range(len(known.keys)) if known.keys[s] and known.slot_class[s] < known.own}
    class_of = lambda t: known.end if t is None else own.get(int(word_id(t)), known.own + int(word_id(t)) % lbl_scoring.SHARED)
    sizes, kinds = Counter(), Counter()
    for word, n in counts.items():
        sizes[class_of(word)] += n
        kinds[class_of(word)] += 1
    for token in tokens(text):
        scores = (model.parts[0][before[0]] + model.parts[1][before[1]]).astype(float)
        c = class_of(token)
        logs += (scores[c] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()) / math.log(10)
        if known.own <= c < known.end:
            logs += math.log10((counts[token] + 0.1) / (sizes[c] + 0.1 * (kinds[c] + 1)))
        before = [c, before[0]]
    return logs


TEXTS = ["The cat sat. the CAT ran.", "der Hund lief, der Hund", None, "", " \n\t", "the cat\x0bsat É é", "x" * 5000, "the cat sat " * 300, "the cat sat"] * 3


@pytest.mark.parametrize("frequent", [1 << 18, 2])
def test_scores_against_a_plain_version(spark, make, monkeypatch, frequent):  # noqa: F811
    monkeypatch.setattr(lbl_scoring, "FREQUENT", frequent)  # two: nearly all words are joined with the table of counts
    train = make([(k, t) for k, t in enumerate(TEXTS)], extra=False)
    counts, model = lbl_scoring.learn(train)
    asked = [*TEXTS, "unseen words, unseen words", "the unseen"]
    docs = make([(k, t) for k, t in enumerate(asked)]).withColumn("lm", F.lit("mine"))
    out = lbl_scoring.score(docs, counts, model)
    assert out.columns == [c for c in docs.columns if c not in ("text", "lm")] + ["lm"]
    got = {r.doc_id: r.lm for r in out.collect()}
    total, base = plain_base(TEXTS, asked)
    assert model.known.total == total and len(got) == len(asked)
    for k, text in enumerate(asked):
        assert (got[k].tokens, got[k].known) == base[k][:2]
        assert got[k].base == pytest.approx(base[k][2], rel=1e-9)
        assert got[k].score == pytest.approx(plain_score(model, TEXTS, text), rel=1e-4)
    again = lbl_scoring.score(docs.select("text"), counts, model)
    assert again.columns == ["text", "lm"] and again.count() == len(asked)


def test_probabilities_add_up(spark, make):  # noqa: F811
    _, model = lbl_scoring.learn(make([(k, t) for k, t in enumerate(TEXTS)], extra=False))
    known, classes = model.known, np.arange(model.known.classes)
    for two in (0, known.end, known.classes):
        for one in (1, known.own, known.classes):
            logs = model.class_logs(np.full(len(classes), one), np.full(len(classes), two), classes)
            assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    # In a class that words share, its words and one unseen make up all.
    room, inside = known.room(), known.slot_count[known.keys != 0]
    shared = known.slot_class[known.keys != 0]
    for c in range(known.own, known.end):
        assert (10 ** known.within(shared[shared == c], inside[shared == c])).sum() + 0.1 / room[c] == pytest.approx(1)


def test_nothing_to_learn_from(spark, make):  # noqa: F811
    none = make([], extra=False)
    counts, model = lbl_scoring.learn(none)
    docs = make([(1, "some words"), (2, None), (2, None)])
    rows = lbl_scoring.score(docs, counts, model).collect()
    assert sorted((r.doc_id, r.lm.tokens, r.lm.known, r.lm.base) for r in rows) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0), (2, 1, 0, 0.0)]
    assert all(r.lm.score < 0 for r in rows)
    assert lbl_scoring.score(docs.limit(0), counts, model).count() == 0


def test_steps_raise_the_likelihood():
    """The learner alone: what always follows gets likely, and its gradient leads there from the shares."""
    shares = np.full(6, 1 / 6)
    model = lbl_scoring.Parameters.fresh(shares)
    learner = lbl_scoring.Learner(model, shares, 0)
    context = [(a, b) for a in range(7) for b in range(7)]
    triples = np.array([(two * 7 + one) * 6 + (one + 1) % 6 for one, two in context], np.int64)
    for _ in range(300):
        learner.learn(triples, np.full(len(triples), 3, np.int32))
    known = type("Known", (), {})()
    full = lbl_scoring.Model.normalised(known, model)
    one, two = (np.array(c) for c in zip(*context))
    assert (10 ** full.class_logs(one, two, (one + 1) % 6)).min() > 0.8


def test_averaging_in_several_rounds(spark, make, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lbl_scoring, "FAN", 2)
    docs = make([(k, t) for k, t in enumerate(TEXTS)], extra=False, partitions=7).select("text")
    known = lbl_scoring.vocabulary(lbl_scoring.count_words(docs))
    assert np.isfinite(lbl_scoring.train(docs, known).packed()).all()


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
def test_held_out_texts(spark):
    out = queries.language_model(spark, str(DATA.parent / "sf0.01"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA.parent}/sf0.01/documents.parquet").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    total, base = plain_base([t for i, t in docs.items() if fold(i)], docs.values())
    want = dict(zip(docs, base))
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 0, *want[r.doc_id][:2], total)
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
    held = [r for r in rows if r.held_out]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert gain > 0.03 and sum(r.score > r.base_score for r in held) > 0.9 * len(held)
