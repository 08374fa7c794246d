"""op4: every page written as a WARC record and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table
from .warc import packages_folder, plan_records, read_packages, write_packages


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    packages = write_packages(plan_records(pages), packages_folder(pages))
    found = read_packages(packages)
    return found.select(
        "page_id",
        F.coalesce(F.length("payload").cast("bigint"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
