"""op1: quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import bucket
from .quality import fit_quality, score_quality
from .storage import table

THRESHOLD = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0)
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id",
        (bucket("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
