import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from stratapanel.functions.columns import direction_hits, lookup, percent, weighted_mean
from stratapanel.operators import expand, metrics
from stratapanel.operators.crosssection import quantiles, winsorized, with_zscores
from stratapanel.operators.joins import assert_unique, point_in_time
from stratapanel.plans.testbed import with_industry


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_zscore_is_zero_where_the_deviation_is(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (2, None), (2, None), (3, 1.0), (3, 3.0)], "d int, x double")
    got = sorted(values(with_zscores(rows, {"x": "z"}, "d"), "d", "z"))
    assert [z for d, z in got if d < 3] == [0.0] * 5
    assert sum(z for d, z in got if d == 3) == pytest.approx(0)


def test_quantile_type_7_and_flag_ties(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 1.0), ("b", 1.0)], "g string, s double")
    assert rows.where("g = 'a'").agg(F.percentile("s", F.lit(0.95)).alias("q")).first().q == pytest.approx(9.2)
    flagged = metrics.flag_top(rows, "s", ["g"]).where("flagged").groupBy("g").count()
    assert dict(values(flagged, "g", "count")) == {"a": 1, "b": 2}


def test_weighted_mean_drops_the_weight_of_nulls(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (3.0, 1.0)], "x double, w double")
    assert rows.agg(weighted_mean("x", "w").alias("m")).first().m == 2


def test_direction_counts_equal_zeros(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, -1.0), (-1.0, -2.0)], "h double, y double")
    assert rows.agg(direction_hits("y", "h").alias("d")).first().d == pytest.approx(2 / 3)


def test_winsorize_keeps_nulls(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(101)] + [(None,)], "x double").withColumn("d", F.lit(1))
    got = [r.w for r in winsorized(rows, "x", "w", 0.05, "d").select("w").collect()]
    known = [g for g in got if g is not None]
    assert (min(known), max(known), len(got) - len(known)) == (5, 95, 1)


def test_month_grid_and_spans(spark):
    grid = values(expand.month_grid(spark, date(2014, 1, 31), date(2024, 12, 31)), "date_eom")
    assert len(grid) == 132 and max(grid)[0] == date(2024, 12, 31)
    spans = spark.createDataFrame([(1, date(2020, 1, 31), date(2020, 3, 1)), (1, date(2020, 3, 5), date(2020, 3, 9)), (2, date(2020, 5, 2), date(2020, 4, 1))], "k int, a date, b date")
    assert sorted(values(expand.expand_spans(spans, ["k"], "a", "b"), "k", "date_eom")) == [(1, date(2020, 1, 31)), (1, date(2020, 2, 29)), (1, date(2020, 3, 31))]


def test_last_value_skips_nulls(spark):
    daily = spark.createDataFrame([(date(2020, 1, 30), 1.0), (date(2020, 1, 31), None), (date(2020, 2, 1), 3.0)], "date date, value double")
    assert sorted(values(expand.last_value_per_month(daily, "v"), "date_eom", "v")) == [(date(2020, 1, 31), 1.0), (date(2020, 2, 29), 3.0)]


def test_point_in_time_takes_the_latest_start_then_the_first(spark):
    keys = spark.createDataFrame([(1, date(2020, 6, 30)), (1, date(2030, 1, 31)), (None, date(2020, 6, 30))], "k int, t date")
    spans = spark.createDataFrame(
        [(1, date(2000, 1, 1), date(2025, 1, 1), "old", 1), (1, date(2020, 6, 30), date(2020, 6, 30), "b", 3), (1, date(2020, 6, 30), date(2020, 7, 1), "a", 2)], "k int, s date, e date, v string, n int"
    )
    got = {(r.k, r.t): r.v for r in point_in_time(keys, spans, "k", "t", "s", "e", ["v"], "n").collect()}
    assert got == {(1, date(2020, 6, 30)): "a", (1, date(2030, 1, 31)): None, (None, date(2020, 6, 30)): None}


def test_industry_edges(spark):
    sic = [None, -1, 100, 999, 1000, 3693, 3714, 9999]
    got = {r.siccd: r.ff12_code for r in with_industry(spark.createDataFrame([(s,) for s in sic], "siccd int")).collect()}
    assert got == {None: None, -1: "Other", 100: "NoDur", 999: "NoDur", 1000: "Other", 3693: "Hlth", 3714: "Durbl", 9999: "Other"}


def test_adjusted_rand(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2)], "x string, y int")
    assert metrics.adjusted_rand(rows, "x", "y").first().adj_rand == 1
    crossed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "x string, y int")
    assert metrics.adjusted_rand(crossed, "x", "y").first().adj_rand == pytest.approx(-0.5)
    assert metrics.adjusted_rand(rows.where("false"), "x", "y").first().adj_rand is None


def test_flag_overlap_with_an_absent_scheme(spark):
    flags = spark.createDataFrame([(1, "A", True), (2, "A", True), (2, "B", True), (3, "B", False)], "k int, s string, flagged boolean")
    got = {(r.a, r.b): r.jaccard for r in metrics.flag_overlap(flags, ["k"], "s", ["A", "B", "C"]).collect()}
    assert got["A", "B"] == got["B", "A"] == 0.5 and got["A", "A"] == 1 and got["A", "C"] == 0


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError, match="repeated key"):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_lookup_and_format(spark):
    row = spark.createDataFrame([("10",), ("99",), (None,)], "c string").select(lookup({"10": "Energy"}, F.col("c")).alias("n"), percent(F.lit(0.1234)).alias("p")).collect()
    assert [r.n for r in row] == ["Energy", None, None] and row[0].p == "12.34%"


def test_bootstrap_interval_holds_the_mean(spark):
    from stratapanel.operators.resample import bootstrap_mean

    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    got = bootstrap_mean(rows, "x", "k", [], 200).first()
    assert got.low < got.estimate < got.high and math.isclose(got.estimate, 2.985, abs_tol=0.01)
    assert got.high - got.low < 0.6
