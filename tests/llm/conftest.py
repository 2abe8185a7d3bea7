import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

from cases import DOCS, EDGES  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """Columns whose names clash with those the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, DOCS)
    clash = ("id", "row", "h", "g", "node", "start", "end", "spans", "n_lines", "n_removed", "hit_keys", "line_keys", "keeper", "gone", "hit_id", "item", "doc", "words", "low", "present", "media", "payload", "tail", "score", "chunk", "a", "b")
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in clash))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")
