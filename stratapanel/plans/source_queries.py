"""Registered queries over sources: parsers on texts at hand, vendor tables, the panel built from them, and the design study's panel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import FACTORS
from ..functions.columns import fixed, percent
from ..operators import expand, iforest
from ..operators.joins import with_suffix
from ..operators.matrix import standardise
from ..sources import cache, raw, text
from . import compare, features, study
from .panel import build_panel
from .queries import KEY, TWO, excess, query, rounded
from .testbed import CONFIG, factors, panel, returns, table
from .vendor import FACTOR_TEXT, INDEX, RANGE_TEXT, SERIES_TEXT, panel_sources, raw_tables, text_lines

SPAN = (CONFIG.start_date, CONFIG.end_date)


@query
def factor_csv(spark, d):
    return rounded(raw.load_factor_sources(text_lines(spark, FACTOR_TEXT), text_lines(spark, RANGE_TEXT))["ff5"], "date_eom", **dict.fromkeys((*FACTORS, "rf"), 8))


@query
def range_list(spark, d):
    return raw.load_factor_sources(text_lines(spark, FACTOR_TEXT), text_lines(spark, RANGE_TEXT))["ff12_def"]


@query
def series_csv(spark, d):
    return text.series_lines(text_lines(spark, SERIES_TEXT))


@query
def series_to_eom(spark, d):
    return expand.last_value_per_month(text.series_lines(text_lines(spark, SERIES_TEXT)), "value")


@query
def macro_sources(spark, d):
    return rounded(panel_sources(spark, d)["macro"], "date_eom", ten_y=4, ffr=4, vix=4)


@query
def no_delistings(spark, d):
    return raw.no_delistings(spark)


@query
def membership_spans(spark, d):
    return raw.membership(raw_tables(spark, d)["members"], INDEX, *SPAN)


@query
def vendor_returns(spark, d):
    tables = raw_tables(spark, d)
    return rounded(raw.monthly_returns(tables["months"], tables["members"], INDEX, *SPAN), *KEY, ret=6, prc=4, shrout=2, mktcap=0)


@query
def names_history(spark, d):
    tables = raw_tables(spark, d)
    return raw.stock_names(tables["names"], tables["members"], INDEX)


@query
def latest_names(spark, d):
    tables = raw_tables(spark, d)
    return raw.latest_names(raw.stock_names(tables["names"], tables["members"], INDEX))


@query
def sic_history(spark, d):
    tables = raw_tables(spark, d)
    return raw.sic_history(tables["names"], tables["members"], INDEX)


@query
def sector_links(spark, d):
    tables = raw_tables(spark, d)
    return raw.sector_links(tables["company"], tables["members"], INDEX)


@query
def panel_from_sources(spark, d):
    keys = (*KEY, "siccd", "ff12_num", "ff12_code", "ff12_name", "gsector", "gics_sector_name", "ticker", "comnam")
    return rounded(build_panel(panel_sources(spark, d), CONFIG), *keys, ret=6, mktcap=0, ret_excess=6, rf=6, ten_y=4, ffr=4, vix=4, **dict.fromkeys(FACTORS, 6))


@query
def study_panel(spark, d):
    rows = study.study_panel(returns(spark, d).withColumn("dlret", F.when(F.col("permno") % 7 == 0, -0.3)), factors(spark, d).withColumn("rf", F.lit(0.001)))
    return rounded(rows, *KEY, ret_adj=6, mkt_cap=0, ret_excess=6, forward_excess_1m=6, forward_excess_3m=6, forward_excess_6m=6, size_lag=6, mom_12_2=6, vol_12=6)


@query
def risk_adjusted_alpha(spark, d):
    rows = features.with_loadings(excess(spark, d), CONFIG).drop(*FACTORS).withColumn("ahead", F.col("ret_excess"))
    return rounded(study.risk_adjusted(rows, factors(spark, d), "ahead"), *KEY, expected_factor_return=6, abnormal_1m=6)


@query
def suffix_join(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("name"), "n_nationkey")
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return with_suffix(a, b, ["key"], "_region")


@query
def standardise_on_train(spark, d):
    rows = returns(spark, d).select("permno", "date_eom", "ret", "mktcap").where("ret is not null")
    before = F.col("date_eom") <= F.lit(CONFIG.train_end)
    return rounded(standardise(rows.where(before), rows.where(~before), ["ret", "mktcap"]), *KEY, ret=5, mktcap=5)


@query
def mahalanobis(spark, d):
    rows = panel(spark, d).where("ret is not null").select("permno", "date_eom", "gics_sector_name", "ret", "mktcap")
    return rounded(iforest.mahalanobis_scores(rows, ("ret", "mktcap"), ["gics_sector_name"]), *KEY, "gics_sector_name", score=5)


@query
def formatted(spark, d):
    x = (F.col("c_custkey") * 37 % 10007 - 5000) / 10000
    y = (F.col("c_custkey") * 37 % 1009 - 500) / 1000
    return table(spark, d, "customer").select("c_custkey", percent(x).alias("as_percent"), fixed(y).alias("as_number"))


@query
def cached_returns(spark, d):
    """Computed once, written, and read from the cache."""
    path = f"{cache.shared_folder(spark)}/cached-{uuid.uuid4().hex}"
    cache.cached_table(spark, path, lambda: returns(spark, d).select(*KEY, "ret", "mktcap"))
    return rounded(cache.cached_table(spark, path, lambda: spark.range(0)), *KEY, ret=6, mktcap=0)


@query
def attach_clusters(spark, d):
    rows = returns(spark, d).select(*KEY, "ret")
    known = rows.where(F.year("date_eom") == 2000).select(*KEY, (F.col("permno") % 3 + 1).cast("int").alias("cluster_id"))
    return rounded(compare.attach_clusters(rows, known), *KEY, "cluster_id", ret=6)


@query
def modelling_rows(spark, d):
    frame = compare.modelling_frame(features.build_features(panel(spark, d), CONFIG), CONFIG)
    return frame.groupBy("split", "gics_sector_name").agg(F.count("*").alias("n"), F.count_distinct("permno").alias("n_stocks"), F.round(F.avg("alpha_fwd_1m"), 6).alias("mean_label"))


@query
def homogeneity_of_codes(spark, d):
    rows = panel(spark, d)
    built = features.with_realised_alpha(features.with_loadings(rows, CONFIG))
    found = compare.homogeneity(built, rows, TWO)
    return rounded(found, "scheme", mean_alpha_sd=6, median_alpha_sd=6, mean_within_corr=5, median_within_corr=5)


@query
def best_month(spark, d):
    """The row with the greatest return of each entity, the earliest of ties."""
    return expand.latest_per_key(returns(spark, d).where("ret is not null").select(*KEY, F.round("ret", 6).alias("ret")), ["permno"], "ret", ["date_eom"])


@query
def random_rows(spark, d):
    return expand.random_rows(table(spark, d, "orders"), 8, CONFIG.seed, "o_orderkey").select("o_orderkey", "o_custkey")

