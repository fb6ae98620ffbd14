"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that help every job here; a cluster may override any of them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Cell-id IN lists reach the Parquet row-group filter one value at a time up to this length.
    "spark.sql.parquet.pushdown.inFilterThreshold": "512",
    # The JVM leaves methods above 8000 bytes uncompiled; wide projections do better unfused then.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Lets adaptive execution see a hot block even when a stage has thousands of reducers.
    "spark.shuffle.accurateBlockSkewedFactor": "5",
}


def build_session(app_name: str = "almagest", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """Folder for a written table, inside the shared folder the session names.

    That is ``spark.checkpoint.dir``, else the warehouse folder; never one made on this machine alone. The
    same name gives the same folder throughout an application, so a repeated call replaces what it wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/almagest-{spark.sparkContext.applicationId}/{name}"
