"""op3: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .learning import bucket
from .storage import table
from .toxicity import fit_toxicity, score_toxicity

THRESHOLD = 0.5


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit_toxicity(docs, table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0))
    return score_toxicity(docs, lexicon).select(
        "doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
