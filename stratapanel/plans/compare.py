"""Comparison of groupings: composition, homogeneity, prediction and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FEATURE_COLS, SCHEMES, EngineConfig
from ..functions.columns import direction_hits, mean_abs_error, r_squared, weighted_mean
from ..operators.elastic_net import long_schemes, predict_groups, predict_pooled, with_folds
from ..operators.iforest import score_groups
from ..operators.matrix import mean_correlations
from ..operators.metrics import adjusted_rand, by_flag, contingency, flag_overlap, flag_top
from ..sources.cache import checkpointed
from .features import HORIZONS, with_forward_alpha


def attach_clusters(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """One cluster_id for each row of ``features``; no row is added or lost."""
    return features.join(clusters.select("permno", "date_eom", "cluster_id"), ["permno", "date_eom"], "left")


def snapshot(rows: DataFrame) -> DataFrame:
    """The rows of the latest month that have a group in every scheme."""
    last = rows.agg(F.max("date_eom").alias("date_eom"))
    return rows.join(F.broadcast(last), "date_eom", "left_semi").where("gsector is not null and ff12_code is not null and cluster_id is not null")


def composition(rows: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Adjusted Rand index of each pair of groupings, and their contingency tables."""
    snap = checkpointed(snapshot(rows.select("date_eom", "gsector", "gics_sector_name", "ff12_code", "cluster_id")))
    pairs = {"GICS vs FF12": ("gsector", "ff12_code"), "GICS vs Cluster": ("gsector", "cluster_id"), "FF12 vs Cluster": ("ff12_code", "cluster_id")}
    rand = None
    for name, (a, b) in pairs.items():
        row = adjusted_rand(snap, a, b).select(F.lit(name).alias("comparison"), "adj_rand", "n_stocks")
        rand = row if rand is None else rand.unionByName(row)
    tables = {
        "gics_vs_ff12": contingency(snap, "gics_sector_name", "ff12_code"),
        "gics_vs_cluster": contingency(snap, "gics_sector_name", "cluster_id"),
        "ff12_vs_cluster": contingency(snap, "ff12_code", "cluster_id"),
    }
    return rand, tables


def long_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """``comparison``, ``a``, ``b`` and ``n``: the contingency tables below one another."""
    out = None
    for name, cells in tables.items():
        a, b = cells.columns[:2]
        part = cells.select(F.lit(name).alias("comparison"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def homogeneity(rows: DataFrame, panel: DataFrame, schemes: dict[str, str] = SCHEMES, least: int = 24) -> DataFrame:
    """Per scheme: mean and median dispersion of alpha in (date, group) cells, mean and median over groups of the members' mean correlation.

    All schemes go through one plan. Members of a group are all entities that ever were in it; correlations use the whole panel.
    """
    long = long_schemes(rows.where("alpha_realized is not null"), schemes)
    cells = long.groupBy("scheme", "date_eom", "grp").agg(F.stddev_samp("alpha_realized").alias("sd"), F.count("*").alias("n")).where("n >= 5")
    spread = cells.groupBy("scheme").agg(F.avg("sd").alias("mean_alpha_sd"), F.median("sd").alias("median_alpha_sd"))
    members = checkpointed(long.select("scheme", "grp", "permno").distinct())
    groups = mean_correlations(panel, "permno", "date_eom", "ret_excess", least, ["scheme", "grp"], members).where("corr is not null").withColumnRenamed("corr", "c")
    within = groups.groupBy("scheme").agg(F.avg("c").alias("mean_within_corr"), F.median("c").alias("median_within_corr"))
    return spread.join(within, "scheme", "left")


def modelling_frame(rows: DataFrame, config: EngineConfig, need_label: bool = True) -> DataFrame:
    """Rows with all features (and the label), and ``split``: train or test by date."""
    split = F.when(F.col("date_eom").between(F.lit(config.train_start), F.lit(config.train_end)), "train").when(F.col("date_eom").between(F.lit(config.test_start), F.lit(config.test_end)), "test")
    kept = rows.dropna(subset=[*FEATURE_COLS, *(["alpha_fwd_1m"] if need_label else [])])
    return kept.withColumn("split", split).where("split is not null")


def group_metrics(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("scheme", "grp").agg(
        F.first("n_train").alias("n_train"), F.count("*").alias("n_test"), r_squared("y_true", "y_hat").alias("r2_oos"), mean_abs_error("y_true", "y_hat").alias("mae"), direction_hits("y_true", "y_hat").alias("dir_acc")
    )


def scheme_metrics(groups: DataFrame) -> DataFrame:
    """Metrics of each scheme, its groups weighted by their test rows."""
    return groups.groupBy("scheme").agg(
        F.sum("n_test").alias("n_test_total"), weighted_mean("r2_oos", "n_test").alias("r2_oos_weighted"), weighted_mean("mae", "n_test").alias("mae_weighted"), weighted_mean("dir_acc", "n_test").alias("dir_acc_weighted"), F.count("*").alias("n_groups")
    )


def prediction(rows: DataFrame, config: EngineConfig, schemes: dict[str, str] = SCHEMES) -> tuple[DataFrame, DataFrame]:
    """Per group and per scheme, with a pooled model beside; the pooled one keeps rows without a group."""
    needed = rows.select("permno", "date_eom", "alpha_fwd_1m", *schemes.values(), *FEATURE_COLS)
    frame = checkpointed(with_folds(modelling_frame(needed, config), config.seed))
    per_group = group_metrics(predict_groups(long_schemes(frame, schemes), FEATURE_COLS, "alpha_fwd_1m"))
    pooled = group_metrics(predict_pooled(frame, FEATURE_COLS, "alpha_fwd_1m"))
    return per_group, scheme_metrics(per_group.unionByName(pooled))


def anomalies(rows: DataFrame, config: EngineConfig, schemes: dict[str, str] = SCHEMES, trees: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flags of each scheme's test rows, their overlap, and forward alpha by flag."""
    needed = rows.select("permno", "date_eom", "alpha_realized", *schemes.values(), *FEATURE_COLS)
    frame = checkpointed(modelling_frame(with_forward_alpha(needed), config, need_label=False))
    scores = checkpointed(score_groups(long_schemes(frame, schemes), FEATURE_COLS, trees, seed=config.seed))
    flags = flag_top(scores, "iso_score", ["scheme", "grp"])
    overlap = flag_overlap(flags, ["permno", "date_eom"], "scheme", list(schemes))
    ahead = checkpointed(flags.join(frame.select("permno", "date_eom", *[f"alpha_fwd_{h}m" for h in HORIZONS]), ["permno", "date_eom"]))
    return flags, overlap, by_flag(ahead, {h: f"alpha_fwd_{h}m" for h in HORIZONS}, ["scheme"])
