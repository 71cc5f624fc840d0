"""Models as parquet tables, one folder per part, keyed by layer."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def save(table: DataFrame, root: str, part: str) -> None:
    table.write.mode("overwrite").parquet(os.path.join(root, part))


def load(spark: SparkSession, root: str, part: str) -> DataFrame | None:
    """A stored part, or None when it was never trained."""
    try:
        return spark.read.parquet(os.path.join(root, part))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
