"""op10: documents linked by the similarity of their shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .jaccard_join import jaccard_join
from .storage import table


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
