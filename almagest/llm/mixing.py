"""Mixing sources to target weights by exponential keys.

Every document draws the key ``-ln(u) / weight`` from a uniform ``u`` that its id fixes; taking documents in
order of their keys is weighted sampling without replacement. A source that is to give more words than
it has is first taken whole, epoch by epoch; the rest of its budget goes down the order of its keys. The
prefix sums that find where a budget ends run over buckets of keys, so no source is ever sorted in one
task: only documents of the one bucket in which the budget ends are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.llm.common import cut, sent

# Words: runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
# Documents in a bucket of keys, about.
BUCKET_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number above 0 and below 1 that the key as text fixes; any engine with MD5 gets the same."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10)
    return (head.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def prose_quality(text: Column, size: Column) -> Column:
    """Weight between 0 and 1: how near the mean length of a word, with its blank, is to six characters."""
    mean = F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)))


def bucket_of(sample_key: Column, documents: Column, bucket_rows: int) -> Column:
    """A number that grows with the key, shared by about ``bucket_rows`` documents at most.

    Each doubling of the key is cut alike. Keys are spread over some doublings whatever the scale of the weights, no
    doubling holding much over a quarter of them, so a source of low weights throughout has buckets as even as any.
    Keys without bound, of documents without a weight, are last and share a bucket.
    """
    cuts = F.ceil(documents / F.lit(4 * bucket_rows))
    return F.when(sample_key < F.lit(float("inf")), F.floor(F.log2(sample_key) * cuts)).otherwise(F.lit(1 << 62))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size, ...) with each source's ``target``.

    Weights go round the sources by code point, null last. All targets sum to all sizes. A target stops at
    ``epochs`` times its source's size; the excess is shared by weight among the rest until none is above.
    That is one level ``t`` with targets ``min(cap, t * weight)``: sources stop in order of ``cap / weight``, so
    the level comes from running sums in that order. One row per source is ordered, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ring = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("place", F.row_number().over(order) - 1).select(
        "*", F.element_at(ring, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(epochs) * F.col("source_size")).cast("double").alias("cap"),
    )
    by_stop = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("stopped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        F.sum("source_size").over(every).cast("double").alias("whole"),
    )
    # The level if all sources before this one have stopped; it holds at the first one that it does not fill.
    level = (F.col("whole") - F.col("stopped")) / F.col("open")
    holds = F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", level.alias("level")))
    rows = rows.withColumn("level", F.min(holds).over(every)["level"])
    share = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", "documents", share.alias("target"))


def mix(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weight: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, sample_key, taken (words, repeats counted).

    ``weight`` weighs documents (default ``prose_quality``); a missing weight or one not above zero puts a
    document last. Equal keys go by id, then by a hash of the text, then count as one piece of budget in which each
    row takes the same part. The document at the end of a budget is taken in part. Null texts have no
    words and take none; a source without words has target 0; null is a source of its own. Rows that
    repeat are separate documents. Other columns are not read; empty tables give no rows.
    """
    size = word_count(F.col(text))
    quality = prose_quality(F.col(text), F.col("size")) if weight is None else weight
    rows = docs.withColumn("size", size).select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), "size",
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), quality.cast("double").alias("quality"),
    )
    drawn = -F.ln(uniform(F.col("doc_id"))) / F.when(F.col("quality") > 0, F.col("quality"))
    # Texts are read once; all that follows reads this narrow table.
    rows = cut(rows.withColumn("sample_key", F.coalesce(drawn, F.lit(float("inf")))).drop("quality"))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")), weights, epochs)
    plan = plan.select(
        F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), "source_size", "documents", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole_epochs"),
    ).withColumn("rest", F.round("target").cast("long") - F.col("whole_epochs") * F.col("source_size"))
    rows = rows.withColumns({"name": F.coalesce("source", F.lit("")), "no_name": F.col("source").isNull()})
    by = ["name", "no_name"]
    rows = rows.join(sent(plan), by).withColumn("bucket", bucket_of(F.col("sample_key"), F.col("documents"), bucket_rows))
    sums = rows.groupBy(*by, "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    rows = rows.join(sums, [*by, "bucket"])
    inner = (F.col("bucket_start") < F.col("rest")) & (F.col("rest") < F.col("bucket_start") + F.col("bucket_size"))
    rows = rows.withColumn("partial", F.when(F.col("bucket_start") + F.col("bucket_size") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    out = ["doc_id", "source", "size", "source_size", "target", "sample_key"]
    epochs_taken = F.col("whole_epochs") * F.col("size")
    settled = rows.where(~inner).select(*out, (epochs_taken + F.col("partial")).alias("taken"))
    down = Window.partitionBy(*by, "bucket").orderBy("sample_key", "doc_id", "tie")
    left = F.col("rest") - F.col("bucket_start") - (F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    parted = rows.where(inner).select(*out, (epochs_taken + F.greatest(F.lit(0), F.least(F.col("size"), left))).alias("taken"))
    return settled.unionByName(parted)


def mixture(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """What a training run reads: doc_id, source, size, taken for the documents the mix takes something of."""
    return mix(docs, text, key, source, **options).where("taken > 0").select("doc_id", "source", "size", "taken")
