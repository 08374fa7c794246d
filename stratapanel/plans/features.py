"""Feature panel: rolling loadings, realised and forward alpha, controls, lagged drivers and z-scores; and its invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BETAS, FACTORS, MACRO, EngineConfig
from ..operators.crosssection import with_zscores
from ..operators.windows import along, log_lag, momentum, rolling_ols, rolling_sd, with_lags, with_leads
from ..sources.cache import checkpointed

HORIZONS = (1, 3, 6)


def with_loadings(panel: DataFrame, config: EngineConfig) -> DataFrame:
    names = {"alpha": "alpha", **dict(zip(FACTORS, BETAS, strict=True)), "rsq": "rsq", "n_obs": "n_obs"}
    return rolling_ols(panel, "ret_excess", FACTORS, names, config.loading_window_months, config.loading_lag_months, config.loading_min_obs)


def with_realised_alpha(rows: DataFrame) -> DataFrame:
    """Excess return less what the loadings explain; null where any part is."""
    return rows.withColumn("alpha_realized", F.col("ret_excess") - sum((F.col(b) * F.col(f) for b, f in zip(BETAS[1:], FACTORS[1:], strict=True)), F.col(BETAS[0]) * F.col(FACTORS[0])))


def with_forward_alpha(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    return with_leads(rows, "alpha_realized", {f"alpha_fwd_{h}m": h for h in horizons})


def with_controls(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"mom_12_1": momentum(), "vol_12m": rolling_sd(), "log_mktcap_lag": log_lag()})


def with_lagged_drivers(rows: DataFrame, config: EngineConfig) -> DataFrame:
    lags = {f"{m}_lag": (m, config.macro_lag_months) for m in MACRO} | {f"{f}_lag": (f, config.ff_lag_months) for f in FACTORS}
    return with_lags(rows, lags)


def build_features(panel: DataFrame, config: EngineConfig, keep: tuple[str, ...] | None = None) -> DataFrame:
    """All windows along an entity first, over one shuffle and sort, written once; then the cross-section, from sums by month. With ``keep`` only
    these columns are written and returned."""
    rows = with_lagged_drivers(with_controls(with_loadings(panel, config)), config)
    rows = with_forward_alpha(with_realised_alpha(rows))
    scores = {b: f"z_{b}" for b in BETAS if keep is None or f"z_{b}" in keep}
    rows = checkpointed(rows if keep is None else rows.select(*[c for c in rows.columns if c in keep or c in scores or c == "date_eom"]))
    rows = with_zscores(rows, scores, "date_eom") if scores else rows
    return rows if keep is None else rows.select(*keep)


def violations(features: DataFrame, panel: DataFrame, config: EngineConfig, tolerance: float = 1e-10) -> DataFrame:
    """``test``, ``checked`` (compared rows) and ``violations`` of the leakage invariants.

    1: the forward label is the realised alpha of the entity's next row, found by its row number. 2: loadings don't change when all five factors
    of the last year are disturbed, in any row whose window ends before. 3: lagged factors are those of the row so many rows back.
    """
    w = along()
    rows = features.select("permno", "alpha_realized", "alpha_fwd_1m", *FACTORS, *[f"{f}_lag" for f in FACTORS], F.row_number().over(w).alias("_row"))
    rows = checkpointed(rows)
    other = rows.select("permno", F.col("alpha_realized").alias("_next"), *[F.col(f).alias(f"_{f}") for f in FACTORS], F.col("_row").alias("_of"))
    ahead = rows.join(other.withColumn("_row", F.col("_of") - 1), ["permno", "_row"], "left")
    differs = ~F.col("alpha_fwd_1m").eqNullSafe(F.col("_next")) & ~F.coalesce(F.abs(F.col("alpha_fwd_1m") - F.col("_next")) <= tolerance, F.lit(False))
    one = ahead.agg(F.count("*").alias("checked"), F.count(F.when(differs, 1)).alias("violations"))
    back = rows.join(other.withColumn("_row", F.col("_of") + config.ff_lag_months), ["permno", "_row"], "left")
    wrong = sum((F.when(F.col(f"{f}_lag").eqNullSafe(F.col(f"_{f}")), 0).otherwise(1) for f in FACTORS), F.lit(0)) > 0
    three = back.agg(F.count("*").alias("checked"), F.count(F.when(wrong, 1)).alias("violations"))
    last = panel.agg(F.max("date_eom").alias("_last"))
    cut = F.last_day(F.add_months("_last", -12))
    slim = panel.select("permno", "date_eom", "ret_excess", *FACTORS).join(F.broadcast(last))
    disturbed = slim.withColumns({f: F.when(F.col("date_eom") > cut, F.col(f) * -3 + 0.01 * (k + 1)).otherwise(F.col(f)) for k, f in enumerate(FACTORS)})
    before = with_loadings(slim, config).where(F.col("date_eom") <= cut).select("permno", "date_eom", F.struct(*BETAS).alias("x"))
    after = with_loadings(disturbed, config).where(F.col("date_eom") <= cut).select("permno", "date_eom", F.struct(*BETAS).alias("y"))
    differ = sum((F.when(F.coalesce(F.abs(F.col(f"x.{b}") - F.col(f"y.{b}")) > tolerance, ~F.col(f"x.{b}").eqNullSafe(F.col(f"y.{b}"))), 1).otherwise(0) for b in BETAS), F.lit(0)) > 0
    two = before.join(after, ["permno", "date_eom"]).where("x.beta_mkt is not null").agg(F.count("*").alias("checked"), F.count(F.when(differ, 1)).alias("violations"))
    named = [(one, "forward label is the next realised alpha"), (two, "loadings ignore later factors"), (three, "lagged factors are those of earlier rows")]
    out = None
    for frame, name in named:
        row = frame.select(F.lit(name).alias("test"), "checked", "violations")
        out = row if out is None else out.unionByName(row)
    return out


def assert_no_leakage(features: DataFrame, panel: DataFrame, config: EngineConfig) -> DataFrame:
    found = violations(features, panel, config).collect()
    broken = [r.test for r in found if r.violations]
    if broken:
        raise AssertionError(f"leakage: {broken}")
    return features
