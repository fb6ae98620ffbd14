"""From raw documents to a training mix: each stage works on all that the one before it kept.

Stages keep the columns of ``documents`` and their rows as they are; the last returns the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from almagest.llm.common import packed, table, unpacked
from almagest.session import work_folder

# Texts this far from every learned language are in none. Prose, short lines and shouting score above 0.35.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; without a letter, or far from every profile, they go."""
    learned = language_id.profiles(docs)
    rows = docs.select(packed(docs).alias("row"), F.col("text").alias("text"))
    found = language_id.identify(rows, learned)
    known = (F.col("language.lang") != language_id.UNKNOWN) & (F.col("language.score") >= LEAST_SCORE)
    return unpacked(found.where(known), "row")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.unique(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes something of, and how many words of each."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

# Profiles, registers and suffix arrays have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written as Parquet in the shared folder and read back by the next
    one, so that nothing is worked out twice, also after an executor is lost."""
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    *first, (_, last) = STAGES
    for name, stage in first:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return last(spark, docs, sf_dir)
