"""op8: personal data in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import KINDS, find_pii, span_list
from .storage import table


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_list(_ordered(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 plain SQL can say, too: the plain matches of each kind."""
    return op8_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS])


PII_COUNTS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') t FROM documents),
m AS (SELECT doc_id,
    len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) emails,
    regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') ips,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) cards,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) phones FROM t)
SELECT doc_id, CAST(emails AS BIGINT) n_email,
    CAST(len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN 999 ELSE CAST(right(p, 3) AS INTEGER) END)) <= 255)) AS BIGINT) n_ip,
    CAST(len(list_filter(cards, lambda d: len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i:
        CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) WHEN CAST(d[i] AS INTEGER) > 4 THEN 2 * CAST(d[i] AS INTEGER) - 9 ELSE 2 * CAST(d[i] AS INTEGER) END)) % 10 = 0)) AS BIGINT) n_card,
    CAST(len(list_filter(phones, lambda n: n BETWEEN 10 AND 15)) AS BIGINT) n_phone
FROM m
"""
