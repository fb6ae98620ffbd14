"""Documents for the tests of operators."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) rows, with columns that clash with the operators' own names."""

    def build(rows, extra=True, partitions=3):
        frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string").repartition(partitions)
        if extra:
            frame = frame.selectExpr(
                "doc_id", "text", "1 AS keep_id", "'x' AS KEPT", "2 AS row", "3 AS found", "4 AS size", "5 AS digest", "6 AS label", "'y' AS secrets",
                "7 AS language", "8 AS toxicity", "9 AS text_sha256",
            )
        return frame

    return build
