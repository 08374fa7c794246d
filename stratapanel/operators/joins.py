"""Point-in-time and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_in_time(
    keys: DataFrame, spans: DataFrame, on: str, at: str, start: str, end: str, values: list[str], tie: str | None = None, match: Column | None = None
) -> DataFrame:
    """``keys`` with the values of the span that holds at ``at``: both ends included, the latest start first, then the least ``tie``, then the greatest values.

    Spans are pre-aggregated to their key by the join itself: an equi-join on ``on`` with the interval as residual condition, so
    no pair of rows with different keys is ever made. A row of ``keys`` is identified by (``on``, ``at``), which must be unique.
    """
    right = spans.select(F.col(on).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), *[F.col(v).alias(f"_v_{v}") for v in values], (F.col(tie) if tie else F.lit(0)).alias("_t"))
    pairs = keys.select(on, at).join(right, (F.col(on) == F.col("_k")) & F.col(at).between(F.col("_s"), F.col("_e")))
    found = F.struct(*[f"_v_{v}" for v in values])
    best = F.max_by(found, F.struct("_s", (-F.col("_t")).alias("_t"), found))
    found = pairs.groupBy(on, at).agg(best.alias("_best")).select(on, at, *[F.col(f"_best._v_{v}").alias(v) for v in values])
    return keys.join(found, [on, at], "left")


#: ranges wider than this in all aren't turned into points
MAX_POINTS = 200_000


def range_lookup(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: str, outputs: list[str], default: dict[str, object]) -> DataFrame:
    """``rows`` with the outputs of the range that holds ``value``, of several the last by ``order``.

    A value in no range gets ``default``; a null stays null. The ranges' total width is checked: up to MAX_POINTS they
    become a point table, joined by hash and small enough to broadcast; wider ones are joined as ranges.
    """
    width = ranges.agg(F.sum(F.greatest(F.col(high) - F.col(low) + 1, F.lit(0)))).first()[0] or 0
    if width <= MAX_POINTS:
        points = ranges.where(F.col(low) <= F.col(high)).select(F.explode(F.sequence(low, high)).alias("_p"), F.struct(*outputs).alias("_o"), order)
        points = points.groupBy("_p").agg(F.max_by("_o", order).alias("_o"))
        found = rows.join(F.broadcast(points), F.col(value) == F.col("_p"), "left")
    else:
        distinct = rows.select(F.col(value).alias("_p")).where("_p is not null").distinct()
        hits = distinct.join(ranges, F.col("_p").between(F.col(low), F.col(high))).groupBy("_p").agg(F.max_by(F.struct(*outputs), order).alias("_o"))
        found = rows.join(hits, F.col(value) == F.col("_p"), "left")
    filled = [F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).when(F.col(value).isNotNull(), F.lit(default[c])).alias(c) for c in outputs]
    return found.select(*rows.columns, *filled)


def with_suffix(left: DataFrame, right: DataFrame, on: list[str], suffix: str, how: str = "left") -> DataFrame:
    """An equi-join in which the right's columns that the left has, too, get ``suffix``."""
    return left.join(right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in on}), on, how)


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, which fail at once if a key occurs twice: a repeated key would multiply rows in later joins."""
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key: {twice[0].asDict()}")
    return rows
