"""The design study's variants: delisting returns by sum, compounded forward returns, risk-adjusted alpha, one-hot elastic nets, in-group flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BETAS, FACTORS
from ..operators.elastic_net import one_hot, predict_pooled, with_folds
from ..operators.iforest import score_groups
from ..operators.joins import with_suffix
from ..operators.metrics import flag_top
from ..operators.windows import along, slide

STUDY_VARS = ("size_lag", "mom_12_2", "vol_12", *BETAS)


def study_panel(months: DataFrame, factors: DataFrame) -> DataFrame:
    """Adjusted and excess returns, forward returns compounded over 1, 3 and 6 months, and lagged size, momentum and volatility.

    ``months`` has permno, date_eom, ret, dlret and mktcap; ``factors`` rf by month. A return known in part counts the other part as 0; rows
    without a positive market value are left out. Forward returns are an entity's own and whole windows only; excess
    returns are compounded as 1 + r.
    """
    ret, gone = F.coalesce("ret", F.lit(0.0)), F.coalesce("dlret", F.lit(0.0))
    rows = months.where("mktcap > 0").join(F.broadcast(factors.select("date_eom", "rf")), "date_eom", "left")
    rows = rows.select("permno", "date_eom", (ret + gone + ret * gone).alias("ret_adj"), F.col("mktcap").alias("mkt_cap"), "rf").withColumn("ret_excess", F.col("ret_adj") - F.col("rf"))
    w = along()
    rows = rows.withColumns({
        "forward_excess_1m": F.lead("ret_excess", 1).over(w),
        "forward_excess_3m": slide(F.product(1 + F.col("ret_excess")), -1, 3, 3) - 1,
        "forward_excess_6m": slide(F.product(1 + F.col("ret_excess")), -1, 6, 6) - 1,
        "size_lag": F.log(F.lag("mkt_cap", 1).over(w)),
        "mom_12_2": slide(F.product(1 + F.col("ret_adj")), 12, -3, 10) - 1,
        "vol_12": slide(F.stddev_samp("ret_adj"), 12, -1, 12),
    })
    return rows


def risk_adjusted(rows: DataFrame, factors: DataFrame, forward: str = "forward_excess_1m") -> DataFrame:
    """``expected_factor_return`` of the rows' loadings, and the forward return less that; factors that rows have already keep their names."""
    joined = with_suffix(rows, F.broadcast(factors.select("date_eom", *FACTORS)), ["date_eom"], "_realized")
    names = [f"{f}_realized" if f in rows.columns else f for f in FACTORS]
    expected = sum((F.col(b) * F.col(f) for b, f in zip(BETAS[1:], names[1:], strict=True)), F.col(BETAS[0]) * F.col(names[0]))
    return joined.withColumn("expected_factor_return", expected).withColumn("abnormal_1m", F.col(forward) - F.col("expected_factor_return"))


def one_hot_net(rows: DataFrame, features: tuple[str, ...], label: str, group: str | None, seed: int) -> DataFrame:
    """Predictions of a pooled elastic net with indicator columns of ``group`` beside the features (none where it is null); ``rows`` has ``split``.

    The indicators' values are those of the training rows; a group that only test rows have has none. Rows with a null feature or label are left out.
    """
    frame = with_folds(rows.dropna(subset=[*features, label]), seed)
    names: tuple[str, ...] = ()
    if group is not None:
        values = [r[0] for r in frame.where("split = 'train'").select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
        frame, names = one_hot(frame, group, values)
    return predict_pooled(frame, (*features, *names), label).withColumn("scheme", F.lit(group or "none"))


def in_group_flags(rows: DataFrame, features: tuple[str, ...], trees: int = 100, least: int = 50, seed: int = 8675309) -> DataFrame:
    """Scores of each (scheme, grp) by a forest of its own rows, and the top five in a hundred flagged; groups of fewer than ``least`` rows have a
    null score and no flag."""
    scored = score_groups(rows.dropna(subset=list(features)).withColumn("split", F.lit("test")), features, trees, least, seed, fit_is_score=True)
    flagged = flag_top(scored, "iso_score", ["scheme", "grp"])
    joined = rows.select("scheme", "grp", "permno", "date_eom").join(flagged, ["scheme", "grp", "permno", "date_eom"], "left")
    return joined.withColumn("flagged", F.coalesce("flagged", F.lit(False)))
