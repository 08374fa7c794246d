"""Spans to rows, month grids, and last values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def month_grid(spark: SparkSession, start: date, end: date) -> DataFrame:
    """All month-ends from the month of ``start`` to that of ``end``; anchored at day 1, so no month is skipped."""
    months = F.sequence(F.trunc(F.lit(start), "month"), F.trunc(F.lit(end), "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("m")).select(F.last_day("m").alias("date_eom"))


def expand_spans(spans: DataFrame, keys: list[str], start: str, end: str, low: date | None = None, high: date | None = None) -> DataFrame:
    """A row for each key and month-end its spans touch, both ends included, without repeats.

    With ``low`` and ``high`` only months in that range are made. A span that ends before it starts has none.
    """
    a, b = F.trunc(start, "month"), F.trunc(end, "month")
    if low is not None:
        a = F.greatest(a, F.trunc(F.lit(low), "month"))
    if high is not None:
        b = F.least(b, F.trunc(F.lit(high), "month"))
    bounded = spans.select(*keys, a.alias("_a"), b.alias("_b")).where("_a <= _b")
    months = bounded.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("_m"))
    return months.select(*keys, F.last_day("_m").alias("date_eom")).distinct()


def last_value_per_month(daily: DataFrame, name: str, date_col: str = "date", value_col: str = "value") -> DataFrame:
    """The latest non-null value of each month."""
    known = daily.where(F.col(value_col).isNotNull() & F.col(date_col).isNotNull())
    return known.groupBy(F.last_day(date_col).alias("date_eom")).agg(F.max_by(value_col, date_col).alias(name))


def latest_per_key(rows: DataFrame, keys: list[str], order: str, ties: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key; ties go to the least of ``ties``."""
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *ties)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def sample_keys(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` distinct keys in the order of a seeded hash: the same ones whatever the partitioning."""
    return rows.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def random_rows(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key, the same ones whatever the partitioning; ties go by the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def restrict(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_semi")


def head_and_tail(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first and the last ``n`` rows by ``order``, each a distributed top-n."""
    first = rows.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    return first.unionByName(rows.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("part", F.lit("tail")))
