"""op6: every document's text as media, stored, read back and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .media import media_features, text_to_media
from .storage import materialise, table


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(text_to_media(table(spark, sf_dir, "documents")), "media")
    # the image's own digest travels beside its features: both come from the stored bytes
    facts = F.struct(F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    carried = stored.select(F.struct("doc_id", facts.alias("facts")).alias("key"), "media")
    found = media_features(carried, "key")
    samples = F.col("samples")
    return found.select(
        F.col("key.doc_id").alias("doc_id"),
        "n_bytes",
        F.length(samples).cast("bigint").alias("payload_bytes"),
        F.sha2(samples, 256).alias("payload_sha256"),
        F.crc32(F.substring(samples, -64, 64)).alias("tail_crc32"),
        F.col("key.facts.media_bytes").alias("media_bytes"),
        F.col("key.facts.media_sha256").alias("media_sha256"),
        F.col("dhash").alias("feature"),
        "tile",
    )


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6 plain SQL can say, too: the payload read back and the stored form."""
    return op6_media(spark, sf_dir).drop("feature", "tile", "tail_crc32")


MEDIA_PAYLOADS_SQL = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) bytes FROM documents),
hexed AS (SELECT doc_id, hex(bytes) h, octet_length(bytes) n, greatest(64, (octet_length(bytes) + 63) // 64 * 64) size FROM raw),
padded AS (SELECT doc_id, n, size, unhex(h || repeat('00', CAST(size - n AS INTEGER))) payload FROM hexed),
stored AS (SELECT *, unhex(hex(encode('P5' || chr(10) || '# bytes ' || n || chr(10) || '64 ' || size // 64 || chr(10) || '255' || chr(10))) || hex(payload)) media FROM padded)
SELECT doc_id, CAST(n AS BIGINT) n_bytes, CAST(size AS BIGINT) payload_bytes, sha256(payload) payload_sha256,
       CAST(octet_length(media) AS BIGINT) media_bytes, sha256(media) media_sha256
FROM stored
"""
