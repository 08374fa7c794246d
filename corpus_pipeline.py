"""The corpus pipeline: each stage works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``, further
ones too, whatever they are called. Each stage gives an empty result for an empty table and handles whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.decontamination import drop_contaminated
from stratapanel.llm.jaccard_join import keep_first_of_class
from stratapanel.llm.learning import bucket
from stratapanel.llm.packing import count_pieces, pack_pieces
from stratapanel.llm.packing_query import tokenizer_path
from stratapanel.llm.pii import mask_pii
from stratapanel.llm.quality import fit_quality, keep_good
from stratapanel.llm.quality_query import THRESHOLD
from stratapanel.llm.storage import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels that op1 learns from.

    Null and empty texts, and those without any token, go; repeated rows stand or fall together. Without labels every score is 0.5, above the threshold.
    """
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0)
    return keep_good(docs, fit_quality(docs, labels), THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id.

    Of rows with equal id and text one stays; rows with a null id stay, and so do texts without words. Ties don't arise: ids are compared.
    """
    return keep_first_of_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item, or the whole of a shorter one.

    A null or empty text, and an empty test set, hit nothing; repeated rows stand or fall together.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kind and ``n_chars`` counted anew.

    A null text stays null and keeps its ``n_chars``; an empty one stays empty. Of overlapping identifiers the first stands for all.
    """
    return mask_pii(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is the end sign alone; repeated rows give repeated pieces; equal lengths are exchangeable.
    """
    pieces = count_pieces(docs, tokenizer_path())
    return pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: no SQL: models, sketches and a tokenizer decide
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
