"""op5: documents against the benchmark's windows of ten words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import build_index, search_phrases
from .storage import materialise, table


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(build_index(table(spark, sf_dir, "documents")), "postings")
    found = search_phrases(index, table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH dw AS (
    SELECT row_number() OVER () rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    FROM documents),
iw AS (
    SELECT CAST(item_id AS VARCHAR) item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, w, least(10, len(w)) size FROM iw WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') gram
    FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) p FROM il)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
    SELECT rid, size, p, array_to_string(w[p:p + size - 1], ' ') gram
    FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) p FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, p, g.size, item_id FROM grams g JOIN windows x ON g.size = x.size AND g.gram = x.gram),
covered AS (SELECT rid, count(DISTINCT q) n_hit FROM (SELECT rid, unnest(range(p, p + size)) q FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) names FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
