"""Agreement of groupings and of flags, and profiles of tables."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import jaccard
from .crosssection import beside, quantiles


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values, in long form; rows with a null are left out."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def contingency_wide(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """A column for each of ``values`` of ``b``, zero where a pair doesn't occur."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.groupBy(a).pivot(b, values).count().na.fill(0)


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ``adj_rand`` and ``n_stocks``. Two partitions that are both trivial agree fully; no rows give null."""
    cells = contingency(rows, a, b)

    def pairs(n):
        return n * (n - 1) / 2

    both = cells.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    one = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    two = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    # three relations of one row each
    all_ = both.join(F.broadcast(one)).join(F.broadcast(two))
    expected = F.try_divide(F.col("i") * F.col("j"), pairs(F.col("n")))
    top, bottom = F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected
    value = F.when(F.col("n") == 1, F.lit(1.0)).when(bottom == 0, F.lit(1.0)).otherwise(F.try_divide(top, bottom))
    return all_.select(value.alias("adj_rand"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_stocks"))


def dispersion(rows: DataFrame, group: str, x: str, time: str = "date_eom", least: int = 5) -> DataFrame:
    """Mean and median over (date, group) cells of at least ``least`` rows of x's deviation."""
    cells = rows.where(F.col(group).isNotNull() & F.col(x).isNotNull()).groupBy(time, group).agg(F.stddev_samp(x).alias("sd"), F.count("*").alias("n")).where(F.col("n") >= least)
    return cells.agg(F.avg("sd").alias("mean_alpha_sd"), F.median("sd").alias("median_alpha_sd"))


def flag_top(rows: DataFrame, score: str, by: list[str], share: float = 0.05) -> DataFrame:
    """``flagged``: the score reaches its group's 1 - share quantile (linear interpolation); ties can exceed the share. ``rows`` is evaluated twice."""
    joined = beside(rows, quantiles(rows, score, by, {"_cut": 1 - share}), by)
    return joined.select(*rows.columns, (F.col(score) >= F.col("_cut")).alias("flagged"))


def flag_overlap(flags: DataFrame, keys: list[str], scheme: str, names: list[str]) -> DataFrame:
    """Jaccard overlap of the flagged keys of each pair of schemes: (a, b, n_a, n_b, jaccard), 1 for a scheme with itself."""
    wide = flags.where("flagged").groupBy(*keys).pivot(scheme, names).agg(F.first(F.lit(True)))
    wide = wide.na.fill(False, names)
    pairs = list(product(names, names))
    sums = wide.agg(
        *[F.sum(F.col(n).cast("bigint")).alias(f"n_{n}") for n in names], *[jaccard(F.col(a), F.col(b)).alias(f"j_{a}_{b}") for a, b in pairs]
    )
    rows = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.col(f"n_{a}"), F.lit(0)).alias("n_a"), F.coalesce(F.col(f"n_{b}"), F.lit(0)).alias("n_b"),
            (F.lit(1.0) if a == b else F.col(f"j_{a}_{b}")).alias("jaccard"),
        )
        for a, b in pairs
    ]
    return sums.select(F.inline(F.array(*rows)))


def by_flag(flags: DataFrame, columns: dict[int, str], by: list[str]) -> DataFrame:
    """n, mean and median of each horizon's column by flag, rows with a null value left out. ``flags`` is evaluated twice."""
    long = flags.select(*by, "flagged", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).cast("double").alias("x")) for h, c in columns.items()]))).where("x is not null")
    keys = [*by, "horizon", "flagged"]
    means = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean_fwd_alpha"))
    return beside(means, quantiles(long, "x", keys, {"median_fwd_alpha": 0.5}), keys)


def flag_gap(summary: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the flagged less that of the others."""
    gap = F.max(F.when(F.col("flagged"), F.col("mean_fwd_alpha"))) - F.max(F.when(~F.col("flagged"), F.col("mean_fwd_alpha")))
    return summary.groupBy(*by).agg(gap.alias("gap"))


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value, nulls too, the most frequent first, with each one's share."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), column)


def share_within(rows: DataFrame, group: str, column: str) -> DataFrame:
    counts = rows.groupBy(group, column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def histogram(rows: DataFrame, x: str, bins: int) -> DataFrame:
    """Counts in ``bins`` bins of equal width from the least to the greatest value; the last one is closed."""
    known = rows.select(F.col(x).cast("double").alias("x")).where("x is not null")
    ends = known.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    return known.join(F.broadcast(ends)).select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def most_frequent(rows: DataFrame, column: str) -> DataFrame:
    """The commonest value, the least of ties."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(column)
