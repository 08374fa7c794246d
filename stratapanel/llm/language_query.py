"""op2: language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .language import fit_language, score_language
from .learning import bucket
from .storage import table


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.where(bucket("doc_id", 4) != 2))
    return score_language(docs, model).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
