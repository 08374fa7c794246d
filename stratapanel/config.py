"""Settings of a run, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


#: The study's dates, windows, lags and seed.
@dataclass(frozen=True)
class EngineConfig:
    start_date: date = date(2014, 1, 1)
    end_date: date = date(2024, 12, 31)
    train_start: date = date(2018, 1, 1)
    train_end: date = date(2022, 12, 31)
    test_start: date = date(2023, 1, 1)
    test_end: date = date(2024, 12, 31)
    loading_window_months: int = 36
    loading_min_obs: int = 24
    loading_lag_months: int = 2
    ff_lag_months: int = 2
    macro_lag_months: int = 1
    refit_window_months: int = 60
    seed: int = 8675309


FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")
BETAS = ("beta_mkt", "beta_smb", "beta_hml", "beta_rmw", "beta_cma")
MACRO = ("ten_y", "ffr", "vix")
FEATURE_COLS = (
    *(f"z_{b}" for b in BETAS),
    "mom_12_1",
    "vol_12m",
    "log_mktcap_lag",
    *(f"{m}_lag" for m in MACRO),
    *(f"{f}_lag" for f in FACTORS),
)
SCHEMES = {"GICS": "gics_sector_name", "FF12": "ff12_code", "Cluster": "cluster_id"}
