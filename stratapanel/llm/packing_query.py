"""op9: all documents tokenised and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packing import count_pieces, pack_pieces
from .storage import table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = count_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "search_nodes")
