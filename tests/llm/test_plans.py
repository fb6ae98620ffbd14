"""What the first operators do on little data, on odd column names, and to hot keys."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from almagest.llm import common, decontaminate, mixing, secrets, toxicity
from almagest.llm.common import remainder, table
from made_documents import DATA, make  # noqa: F401


@pytest.mark.skipif(not DATA.exists(), reason="test tables not present")
@pytest.mark.parametrize("sf, area, recall, false", [("sf0.01", 0.8, 0.6, 0.02), ("sf0.1", 0.97, 0.9, 0.02)])
def test_toxicity_on_held_out_rows(spark, sf, area, recall, false):
    """sf0.01 has 37 toxic labels, of which those in three of the four languages are too few to teach a term."""
    docs, labels = (table(spark, str(DATA.parent / sf), name) for name in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = toxicity.learn(docs, labels.where(remainder("doc_id", 4) != 2))
    assert {"idiot", "moron", "scum"} <= set(model[0]) and max(abs(w) for w in model[2][:-1]) > 1
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(remainder("doc_id", 4) == 2).collect()
    bad, good = ([r.toxicity for r in rows if r.toxic == mark] for mark in (1, 0))
    assert sum((x > y) + (x == y) / 2 for x in bad for y in good) / len(bad) / len(good) > area
    assert sum(x >= toxicity.CUTOFF for x in bad) > recall * len(bad)
    assert sum(y >= toxicity.CUTOFF for y in good) < false * len(good)


def test_near_copies_teach_once(spark, make):  # noqa: F811
    body = [f"word{k}" for k in range(120)]
    rows = [(k, " ".join([*body[:k], "edit", *body[k + 1 :]])) for k in range(60)] + [(100 + k, f"other{k} text{k} of{k} its{k} own{k}") for k in range(40)]
    rows += [(200, ""), (201, None), (202, "one"), (203, "one two"), (204, "one two"), (205, "one  two")]
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in rows], "doc_id long, toxic int")
    kept = toxicity._sample(make(rows, extra=False), labels, "text", "doc_id", "toxic", 1000).collect()
    texts = [r.text for r in kept]
    assert sum(t.startswith("other") for t in texts) == 40
    assert sum("word" in t for t in texts) <= 3
    # Without words there is one sign; two words are one shingle, however far apart.
    assert sum(not t for t in texts) == 1 and sum("two" in t for t in texts) == 1 and "one" in texts


def test_secrets_leave_columns_of_any_name(spark):
    names = ["base", "limits", "row", "at_random", "at_assign", "secrets", "start", "end", "kind", "match", "rank", "encoding", "p", "BASE2"]
    docs = spark.createDataFrame([(1, 'api_key = "AbCdEf123456"', *range(len(names)))], ["doc_id", "text", *names])
    got = secrets.scan(docs)
    assert [c for c in got.columns if c != "secrets"] == [c for c in docs.columns if c != "secrets"]
    row = got.first()
    assert [s["kind"] for s in row.secrets] == ["assign"] and row["base"] == 0 and row["limits"] == 1


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_is_dealt_by_a_few_values(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b c d' AS text", "IF(id % 3 = 0, 'hot', CAST(id % 7 AS STRING)) AS source")
    mixed = physical(mixing.mix(docs))
    # Rows are dealt by source and bucket only; single sources only as sums per bucket.
    assert "BroadcastHashJoin" in mixed and all("bucket" in keys or "sample_key" not in keys for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", mixed))
    chosen = physical(common.drawn(docs, "source", "doc_id", 10))
    # What is ranked by source has been cut to about twice the sample before.
    assert chosen.index("Exchange hashpartitioning(source") < chosen.index("BroadcastHashJoin") and chosen.count("Exchange hashpartitioning") == 1
    few = common.drawn(docs.withColumn("draw", F.xxhash64("doc_id")), "source", "draw", 10)
    assert few.groupBy("source").count().agg(F.max("count")).first()[0] == 10


def test_a_table_too_long_to_send_is_joined(spark):
    assert "BroadcastExchange" not in physical(spark.range(10).join(common.sent(spark.range(50), 20).hint("merge"), "id"))
    assert common.sent(spark.range(50), 20).count() == 50 == common.sent(spark.range(50)).count()


def test_repeated_words_cost_no_pairs(make):  # noqa: F811
    """A table of dashes against an item of dashes: every text place would meet every test place."""
    texts, items = ["zero " * 20_000, "a " + "zero " * 30 + "b", "clean text"], ["zero " * 2_000, "zero " * 25 + "tail", "zero zero"]
    column, offsets = next(common.text_slices(pa.array(texts)))
    bench = decontaminate.Benchmark(["x", "y", "z"], items, 10)
    start = time.perf_counter()
    row, first, longest, window, size = bench.search(column, offsets)
    # One class of ten words, one of two, one that ends in ``tail``: at most one place each.
    assert len(row) <= 2 * sum(size) and time.perf_counter() - start < 60
    assert [int(longest[row == k].max(initial=0)) for k in range(3)] == [2_000, 30, 0]
    docs = make(list(enumerate(texts)))
    items = docs.sparkSession.createDataFrame(list(zip("xyz", items)), "item_id string, text string")
    found = {r.doc_id: r.found for r in decontaminate.matches(docs, items).collect()}
    assert found[0]["items"] == ["x", "y", "z"] and [tuple(s) for s in found[0]["spans"]] == [(0, 20_000)]
    assert [tuple(s) for s in found[1]["spans"]] == [(1, 31)] and found[2]["items"] == [] and found[1]["longest"] == 30
    blocks = {r.doc_id: r.found for r in decontaminate.matches(docs, items, block_bytes=10).collect()}
    assert blocks == found


def test_longest_match_against_every_pair():
    draw = random.Random(9)
    for _ in range(60):
        texts, items = ([" ".join(draw.choice("ab") for _ in range(draw.randrange(0, 14))) for _ in range(5)] for _ in range(2))
        bench = decontaminate.Benchmark([str(k) for k in range(5)], items, 4)
        data, offsets = next(common.text_slices(pa.array(texts)))
        row, first, longest, window, _ = bench.search(data, offsets)
        got = {}
        for r, a, n in zip(row.tolist(), first.tolist(), longest.tolist()):
            got[r, a] = max(n, got.get((r, a), 0))
        want = {}
        for r, text in enumerate(texts):
            w = text.split()
            for a in range(len(w)):
                for item in items:
                    v = item.split()
                    for b in range(len(v) - min(4, len(v)) + 1):
                        n = next((k for k in range(min(len(w) - a, len(v) - b)) if w[a + k] != v[b + k]), min(len(w) - a, len(v) - b))
                        if v and n >= min(4, len(v)):
                            want[r, a] = max(n, want.get((r, a), 0))
        assert got == want
