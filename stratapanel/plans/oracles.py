"""DuckDB statements for the registered queries, written apart from the engine's code."""

from __future__ import annotations

from .testbed import FF12_RANGES, INDUSTRY_CODES

RANGES = ", ".join(f"({n}, '{c}', '{t}', {lo}, {hi}, {k})" for k, (n, c, t, lo, hi) in enumerate(FF12_RANGES))

#: the panel as a chain of common tables
PANEL = f"""
m AS (SELECT l_suppkey permno, last_day(CAST(l_shipdate AS DATE)) date_eom,
             sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) prc, sum(l_quantity) shrout
      FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, abs(prc) * shrout mktcap, prc / lag(prc) OVER w - 1 ret, lag(abs(prc) * shrout) OVER w mc_lag
      FROM m WINDOW w AS (PARTITION BY permno ORDER BY date_eom)),
x AS (SELECT r.*, s_nationkey,
             CASE WHEN mc_lag < median(mc_lag) OVER (PARTITION BY date_eom) THEN 1 ELSE 0 END small,
             CASE WHEN s_acctbal > median(s_acctbal) OVER (PARTITION BY date_eom) THEN 1 ELSE 0 END rich
      FROM r JOIN supplier ON permno = s_suppkey),
f AS (SELECT date_eom, avg(ret) mkt_rf,
             avg(CASE WHEN small = 1 THEN ret END) - avg(CASE WHEN small = 0 THEN ret END) smb,
             avg(CASE WHEN s_nationkey % 2 = 0 THEN ret END) - avg(CASE WHEN s_nationkey % 2 = 1 THEN ret END) hml,
             avg(CASE WHEN permno % 3 = 0 THEN ret END) - avg(CASE WHEN permno % 3 <> 0 THEN ret END) rmw,
             avg(CASE WHEN rich = 1 THEN ret END) - avg(CASE WHEN rich = 0 THEN ret END) cma
      FROM x GROUP BY 1),
ff12(ff12_num, ff12_code, ff12_name, sic_lo, sic_hi, ord) AS (VALUES {RANGES}),
ind AS (SELECT permno, siccd, coalesce(ff12_num, 12) ff12_num, coalesce(ff12_code, 'Other') ff12_code, coalesce(ff12_name, 'Other') ff12_name
        FROM (SELECT DISTINCT s_suppkey permno, CAST(s_suppkey * 97 % 10000 AS INTEGER) siccd FROM supplier) LEFT JOIN ff12 ON siccd BETWEEN sic_lo AND sic_hi),
sec AS (SELECT s_suppkey permno, CAST(r_regionkey AS VARCHAR) gsector, r_name gics_sector_name, s_name ticker
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
daily AS (SELECT CAST(o_orderdate AS DATE) d, avg(o_totalprice) vix,
                 avg(CASE WHEN o_orderpriority[1] = '1' THEN o_totalprice END) ten_y, avg(CASE WHEN o_orderpriority[1] = '2' THEN o_totalprice END) ffr
          FROM orders GROUP BY 1),
macro AS (SELECT last_day(d) date_eom, arg_max(ten_y, d) FILTER (WHERE ten_y IS NOT NULL) ten_y, arg_max(ffr, d) FILTER (WHERE ffr IS NOT NULL) ffr, arg_max(vix, d) vix
          FROM daily GROUP BY 1),
panel AS (SELECT r.permno, r.date_eom, r.prc, r.shrout, r.mktcap, r.ret, r.ret - 0.001 ret_excess, f.mkt_rf, f.smb, f.hml, f.rmw, f.cma,
                 ind.siccd, ind.ff12_num, ind.ff12_code, ind.ff12_name, sec.gsector, sec.gics_sector_name, sec.ticker, macro.ten_y, macro.ffr, macro.vix
          FROM r LEFT JOIN f USING (date_eom) LEFT JOIN ind USING (permno) LEFT JOIN sec USING (permno) LEFT JOIN macro USING (date_eom))
"""
_W = "(PARTITION BY permno ORDER BY date_eom)"
_FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma")
_BETAS = ("beta_mkt", "beta_smb", "beta_hml", "beta_rmw", "beta_cma")


def _ols(lag_window: str = "ROWS BETWEEN 37 PRECEDING AND 2 PRECEDING") -> str:
    """Loadings from normal equations, eliminated step by step: an augmented matrix a, reduced row after row."""
    v = ["1.0", *_FACTORS]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in ("ret_excess", *_FACTORS))
    w = f"OVER (PARTITION BY permno ORDER BY date_eom {lag_window})"
    cells = [f"sum(CASE WHEN {ok} THEN {v[i]} * {v[j]} END) {w} a0_{i}_{j}" for i in range(6) for j in range(6)]
    cells += [f"sum(CASE WHEN {ok} THEN {v[i]} * ret_excess END) {w} a0_{i}_6" for i in range(6)]
    text = f"e0 AS (SELECT *, row_number() OVER {_W} pos, count(CASE WHEN {ok} THEN 1 END) {w} nn, sum(CASE WHEN {ok} THEN ret_excess * ret_excess END) {w} yy, {', '.join(cells)} FROM panel)"
    for k in range(6):
        rows = []
        for i in range(6):
            for j in range(k + 1, 7):
                pivot = f"nullif(a{k}_{k}_{k}, 0)"
                rows.append(f"a{k}_{k}_{j} / {pivot} a{k + 1}_{k}_{j}" if i == k else f"a{k}_{i}_{j} - a{k}_{i}_{k} * a{k}_{k}_{j} / {pivot} a{k + 1}_{i}_{j}")
        text += f", e{k + 1} AS (SELECT *, {', '.join(rows)} FROM e{k})"
    fits = "pos >= 38 AND nn >= 24"
    rsq = "1 - (yy - (" + " + ".join(f"a6_{i}_6 * a0_{i}_6" for i in range(6)) + ")) / nullif(yy - a0_0_6 * a0_0_6 / nn, 0)"
    named = ", ".join(f"CASE WHEN {fits} THEN a6_{i + 1}_6 END {b}" for i, b in enumerate(_BETAS))
    return text + f", loadings AS (SELECT permno, date_eom, ret_excess, {', '.join(_FACTORS)}, CASE WHEN {fits} THEN a6_0_6 END alpha, {named}, CASE WHEN {fits} THEN {rsq} END rsq, CASE WHEN pos >= 38 THEN nn END n_obs FROM e6)"


_OLS = _ols()
_ALPHA = _OLS + ", realised AS (SELECT *, ret_excess - (" + " + ".join(f"{b} * {x}" for b, x in zip(_BETAS, _FACTORS, strict=True)) + ") alpha_realized FROM loadings)"


def over_panel(tail: str) -> str:
    return f"WITH {PANEL} {tail}"


def with_loadings(tail: str) -> str:
    return over_panel(f", {_OLS} {tail}")


def with_alpha(tail: str) -> str:
    return over_panel(f", {_ALPHA} {tail}")


def with_features(tail: str) -> str:
    return with_alpha(f", zz AS (SELECT realised.*, p.ret, p.mktcap, p.gics_sector_name, p.ff12_code, p.ten_y, p.ffr, p.vix, {_Z} FROM realised JOIN panel p USING (permno, date_eom) WINDOW d AS (PARTITION BY date_eom)), features AS (SELECT permno, date_eom, gics_sector_name, ff12_code, n_obs, {_FEATURES} FROM zz) {tail}")


_SCORED = """, z AS (SELECT permno, date_eom, gics_sector_name, ff12_code, ret,
    CASE WHEN coalesce(stddev_samp(ret) OVER d, 0) = 0 THEN 0 ELSE (ret - avg(ret) OVER d) / stddev_samp(ret) OVER d END s
    FROM panel WINDOW d AS (PARTITION BY date_eom)),
sc AS (SELECT permno, date_eom, ret, 'GICS' scheme, gics_sector_name grp, abs(s) score FROM z WHERE ret IS NOT NULL
       UNION ALL SELECT permno, date_eom, ret, 'FF12', ff12_code, abs(s) FROM z WHERE ret IS NOT NULL),
cut AS (SELECT scheme, grp, quantile_cont(score, 0.95) c FROM sc GROUP BY 1, 2),
flags AS (SELECT sc.*, score >= c flagged FROM sc JOIN cut USING (scheme, grp))"""
_AHEAD = """, ahead AS (SELECT permno, date_eom, lead(ret, 1) OVER w a1, lead(ret, 3) OVER w a3, lead(ret, 6) OVER w a6 FROM panel WINDOW w AS (PARTITION BY permno ORDER BY date_eom)),
longer AS (SELECT scheme, flagged, unnest([1, 3, 6]) horizon, unnest([a1, a3, a6]) xx FROM flags JOIN ahead USING (permno, date_eom)),
summary AS (SELECT scheme, horizon, flagged, count(*) n, avg(xx) mean_fwd_alpha, median(xx) median_fwd_alpha FROM longer WHERE xx IS NOT NULL GROUP BY 1, 2, 3)"""
_NAIVE = """, p AS (SELECT gics_sector_name grp, ret y, lag(ret, 1) OVER (PARTITION BY permno ORDER BY date_eom) h FROM panel),
g AS (SELECT grp, count(*) n, 1 - sum((y - h) * (y - h)) / nullif(regr_syy(y, y), 0) r2_oos, avg(abs(y - h)) mae, sqrt(avg((y - h) * (y - h))) rmse, avg(CASE WHEN sign(y) = sign(h) THEN 1.0 ELSE 0.0 END) dir_acc
      FROM p WHERE y IS NOT NULL AND h IS NOT NULL GROUP BY 1)"""
_PAIRS = """, k AS (SELECT permno e, date_eom t, ret_excess v, gics_sector_name g FROM panel WHERE ret_excess IS NOT NULL),
enough AS (SELECT e FROM k GROUP BY 1 HAVING count(*) >= 36),
pairs AS (SELECT a.e a, b.e b, min(a.g) ga, min(b.g) gb, count(*) n,
                 CASE WHEN var_samp(a.v) > 1e-12 AND var_samp(b.v) > 1e-12 THEN corr(a.v, b.v) END c
          FROM k a JOIN k b ON a.t = b.t AND a.e < b.e GROUP BY 1, 2)"""

_LAGS = ", ".join([f"round(lag({m}, 1) OVER {_W}, 4) {m}_lag" for m in ("ten_y", "ffr", "vix")] + [f"round(lag({x}, 2) OVER {_W}, 6) {x}_lag" for x in _FACTORS])
_Z = ", ".join(f"CASE WHEN coalesce(stddev_samp({b}) OVER d, 0) = 0 THEN 0 ELSE ({b} - avg({b}) OVER d) / stddev_samp({b}) OVER d END z_{b}" for b in _BETAS)
_FEATURES = ", ".join(
    [f"round({c}, 6) {c}" for c in ("ret", "ret_excess", *_FACTORS, "alpha", *_BETAS, "rsq", "alpha_realized", *(f"z_{b}" for b in _BETAS))]
    + [f"round(lead(alpha_realized, {h}) OVER {_W}, 6) alpha_fwd_{h}m" for h in (1, 3, 6)]
    + [
        f"round(CASE WHEN row_number() OVER {_W} > 12 THEN product(1 + coalesce(ret, 0)) OVER (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING) - 1 END, 6) mom_12_1",
        f"round(CASE WHEN row_number() OVER {_W} >= 12 THEN stddev_samp(ret) OVER (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END, 6) vol_12m",
        f"round(ln(lag(mktcap, 1) OVER {_W}), 6) log_mktcap_lag",
        _LAGS,
    ]
)

SQL = {
    "month_grid": "SELECT last_day(CAST(d AS DATE)) date_eom FROM (SELECT unnest(generate_series(DATE '2014-01-01', DATE '2024-12-01', INTERVAL 1 MONTH)) d)",
    "membership_expand": "SELECT DISTINCT permno, last_day(CAST(mm AS DATE)) date_eom FROM (SELECT o_custkey permno, unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) mm FROM orders GROUP BY 1)",
    "members_primary_issue": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders JOIN (SELECT o_custkey, min(o_orderpriority) o_orderpriority FROM orders GROUP BY 1) USING (o_custkey, o_orderpriority) WHERE o_orderdate <= TIMESTAMP '1999-12-31' AND (o_orderstatus IS NULL OR o_orderdate >= TIMESTAMP '1996-01-01')",
    "semi_in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "delisting_case_when": over_panel(", t AS (SELECT permno, date_eom, ret, CASE WHEN permno % 7 = 0 THEN -0.3 END dl FROM panel) SELECT permno, date_eom, round(CASE WHEN ret IS NOT NULL AND dl IS NOT NULL THEN (1 + ret) * (1 + dl) - 1 WHEN ret IS NOT NULL THEN ret WHEN dl IS NOT NULL THEN dl END, 6) ret_total FROM t"),
    "latest_name_per_key": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) k FROM orders) WHERE k = 1",
    "pit_code_join": "WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) namedt, coalesce(CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) - 1, DATE '9999-12-31') nameenddt, o_orderpriority code, o_orderkey k FROM orders), g AS (SELECT DISTINCT o_custkey, last_day(CAST(o_orderdate AS DATE)) date_eom FROM orders) SELECT g.o_custkey, g.date_eom, arg_max(code, (namedt, -k)) code FROM g LEFT JOIN s ON g.o_custkey = s.o_custkey AND g.date_eom BETWEEN namedt AND nameenddt GROUP BY 1, 2",
    "ff12_range_lookup": f"WITH ff12(ff12_num, ff12_code, ff12_name, sic_lo, sic_hi, ord) AS (VALUES {RANGES}), s AS (SELECT c_custkey, CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey * 97 % 10001 - 1 END AS INTEGER) siccd FROM customer) SELECT c_custkey, siccd, CASE WHEN siccd IS NULL THEN NULL ELSE coalesce(arg_max(ff12_num, ord), 12) END ff12_num, CASE WHEN siccd IS NULL THEN NULL ELSE coalesce(arg_max(ff12_code, ord), 'Other') END ff12_code FROM s LEFT JOIN ff12 ON siccd BETWEEN sic_lo AND sic_hi GROUP BY c_custkey, siccd",
    "daily_to_eom": f"WITH {PANEL} SELECT date_eom, round(ten_y, 4) ten_y FROM macro WHERE ten_y IS NOT NULL",
    "macro_full_join": f"WITH {PANEL} SELECT date_eom, round(ten_y, 4) ten_y, round(ffr, 4) ffr, round(vix, 4) vix FROM macro",
    "panel_build": over_panel("SELECT permno, date_eom, round(ret, 6) ret, round(mktcap, 0) mktcap, round(mkt_rf, 6) mkt_rf, round(smb, 6) smb, round(hml, 6) hml, round(rmw, 6) rmw, round(cma, 6) cma, siccd, ff12_num, ff12_code, ff12_name, gsector, gics_sector_name, ticker, round(prc, 4) prc, round(shrout, 2) shrout, 0.001 rf, round(ret_excess, 6) ret_excess, round(ten_y, 4) ten_y, round(ffr, 4) ffr, round(vix, 4) vix FROM panel"),
    "lagged_drivers": over_panel(f"SELECT permno, date_eom, {_LAGS} FROM panel"),
    "momentum_10m": over_panel(f"SELECT permno, date_eom, round(CASE WHEN row_number() OVER {_W} > 12 THEN product(1 + coalesce(ret, 0)) OVER (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING) - 1 END, 6) mom_12_1 FROM panel"),
    "rolling_vol_12": over_panel(f"SELECT permno, date_eom, round(CASE WHEN row_number() OVER {_W} >= 12 THEN stddev_samp(ret) OVER (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) END, 6) vol_12m FROM panel"),
    "log_mktcap_lag": over_panel(f"SELECT permno, date_eom, round(ln(lag(mktcap, 1) OVER {_W}), 6) log_mktcap_lag FROM panel"),
    "slide_complete": over_panel("SELECT permno, date_eom, CASE WHEN count(*) OVER w >= 3 THEN round(avg(ret) OVER w, 6) END mean_3_before FROM panel WINDOW w AS (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"),
    "rolling_beta_1f": over_panel(f", o AS (SELECT *, row_number() OVER {_W} pos, count(CASE WHEN ret_excess IS NOT NULL AND mkt_rf IS NOT NULL THEN 1 END) OVER w n, regr_slope(ret_excess, mkt_rf) OVER w b, regr_intercept(ret_excess, mkt_rf) OVER w a, regr_r2(ret_excess, mkt_rf) OVER w q FROM panel WINDOW w AS (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 37 PRECEDING AND 2 PRECEDING)) SELECT permno, date_eom, CASE WHEN pos >= 38 AND n >= 24 THEN round(b, 6) END beta_mkt, CASE WHEN pos >= 38 AND n >= 24 THEN round(a, 6) END alpha, CASE WHEN pos >= 38 AND n >= 24 THEN round(q, 6) END rsq, CASE WHEN pos >= 38 THEN n END n_obs FROM o"),
    "rolling_ols_5f": over_panel(f", {_OLS} SELECT permno, date_eom, round(alpha, 6) alpha, {', '.join(f'round({b}, 6) {b}' for b in _BETAS)}, round(rsq, 6) rsq, n_obs FROM loadings"),
    "realized_alpha": over_panel(f", {_ALPHA} SELECT permno, date_eom, round(alpha_realized, 6) alpha_realized FROM realised"),
    "fwd_alpha_1_3_6": over_panel(f", {_ALPHA} SELECT permno, date_eom, round(lead(alpha_realized, 1) OVER {_W}, 6) alpha_fwd_1m, round(lead(alpha_realized, 3) OVER {_W}, 6) alpha_fwd_3m, round(lead(alpha_realized, 6) OVER {_W}, 6) alpha_fwd_6m FROM realised"),
    "calendar_beta": over_panel(", c AS (SELECT *, year(date_eom) * 12 + month(date_eom) mm FROM panel) SELECT permno, date_eom, n_obs, CASE WHEN n_obs >= 24 THEN round(b, 6) END beta_mkt FROM (SELECT permno, date_eom, count(CASE WHEN ret_excess IS NOT NULL AND mkt_rf IS NOT NULL THEN 1 END) OVER w n_obs, regr_slope(ret_excess, mkt_rf) OVER w b FROM c WINDOW w AS (PARTITION BY permno ORDER BY mm RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING))"),
    "cs_zscore": over_panel("SELECT permno, date_eom, round(CASE WHEN coalesce(stddev_samp(ret) OVER d, 0) = 0 THEN 0 ELSE (ret - avg(ret) OVER d) / stddev_samp(ret) OVER d END, 6) z_ret FROM panel WINDOW d AS (PARTITION BY date_eom)"),
    "winsorize_returns": over_panel("SELECT permno, date_eom, round(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, quantile_cont(ret, 0.01) OVER d), quantile_cont(ret, 0.99) OVER d) END, 6) ret_w FROM panel WINDOW d AS (PARTITION BY date_eom)"),
    "feature_panel": with_features("SELECT * FROM features"),
    "coverage_profile": over_panel("SELECT count(*) n, count(DISTINCT permno) n_stocks, count(DISTINCT date_eom) n_months, min(date_eom) first_month, max(date_eom) last_month, count(ret) n_ret, round(avg(CASE WHEN ret IS NOT NULL AND mktcap > 0 THEN 1.0 ELSE 0.0 END), 6) usable FROM panel"),
    "sector_counts": over_panel("SELECT gics_sector_name, count(*) n, round(count(*) / sum(count(*)) OVER (), 6) share FROM panel GROUP BY 1"),
    "range_counts": over_panel("SELECT ff12_num, ff12_code, ff12_name, count(*) n FROM panel GROUP BY 1, 2, 3"),
    "sector_share_within": over_panel("SELECT gics_sector_name, ff12_code, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY gics_sector_name), 6) share FROM panel GROUP BY 1, 2"),
    "histogram_60": over_panel(", e AS (SELECT min(mktcap) low, max(mktcap) high FROM panel) SELECT CAST(least(floor((mktcap - low) / nullif((high - low) / 60, 0)), 59) AS INTEGER) bin, count(*) n FROM panel, e WHERE mktcap IS NOT NULL GROUP BY 1"),
    "mode_value": over_panel("SELECT ff12_code FROM panel GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"),
    "contingency": over_panel("SELECT gics_sector_name, ff12_code, count(*) n FROM panel WHERE date_eom = (SELECT max(date_eom) FROM panel) GROUP BY 1, 2"),
    "contingency_wide": over_panel("SELECT gics_sector_name, " + ", ".join(f"count(*) FILTER (WHERE ff12_code = '{c}') {c}" for c in INDUSTRY_CODES) + " FROM panel GROUP BY 1"),
    "adjusted_rand": over_panel(", c AS (SELECT gics_sector_name a, ff12_code b, count(*) n FROM panel WHERE date_eom = (SELECT max(date_eom) FROM panel) GROUP BY 1, 2), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) n FROM c GROUP BY a)) i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) n FROM c GROUP BY b)) j, (SELECT sum(n) FROM c) n) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) adj_rand, CAST(n AS BIGINT) n_stocks FROM t"),
    "alpha_dispersion": over_panel(f", {_ALPHA}, c AS (SELECT date_eom, gics_sector_name, stddev_samp(alpha_realized) sd FROM realised JOIN sec USING (permno) WHERE alpha_realized IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) SELECT round(avg(sd), 6) mean_alpha_sd, round(median(sd), 6) median_alpha_sd FROM c"),
    "pairwise_corr": over_panel(_PAIRS + " SELECT a, b, n, round(c, 5) corr FROM pairs WHERE a IN (SELECT e FROM enough) AND b IN (SELECT e FROM enough)"),
    "within_group_corr": over_panel(_PAIRS + ", gg AS (SELECT ga, avg(c) c FROM pairs WHERE ga = gb AND c IS NOT NULL GROUP BY 1) SELECT ga grp, round(c, 6) mean_corr FROM gg"),
    "regression_metrics": over_panel(_NAIVE + " SELECT grp, n, round(r2_oos, 6) r2_oos, round(mae, 6) mae, round(rmse, 6) rmse, round(dir_acc, 6) dir_acc FROM g"),
    "weighted_metrics": over_panel(_NAIVE + " SELECT CAST(sum(n) AS BIGINT) n_test_total, round(sum(r2_oos * n) / sum(CASE WHEN r2_oos IS NOT NULL THEN n END), 6) r2_oos_weighted, round(sum(mae * n) / sum(n), 6) mae_weighted, round(sum(dir_acc * n) / sum(n), 6) dir_acc_weighted, count(*) n_groups FROM g"),
    "quantile_flag": over_panel(_SCORED + " SELECT scheme, grp, permno, date_eom, flagged FROM flags"),
    "flag_overlap_jaccard": over_panel(_SCORED + ", w AS (SELECT permno, date_eom, bool_or(scheme = 'GICS') g, bool_or(scheme = 'FF12') h FROM flags WHERE flagged GROUP BY 1, 2), s AS (SELECT count(*) FILTER (WHERE g) n1, count(*) FILTER (WHERE h) n2, count(*) FILTER (WHERE g AND h) i, count(*) u FROM w) SELECT 'GICS' a, 'GICS' b, n1 n_a, n1 n_b, 1.0 jaccard FROM s UNION ALL SELECT 'FF12', 'FF12', n2, n2, 1.0 FROM s UNION ALL SELECT 'GICS', 'FF12', n1, n2, round(i / u, 6) FROM s UNION ALL SELECT 'FF12', 'GICS', n2, n1, round(i / u, 6) FROM s"),
    "fwd_summary_by_flag": over_panel(_SCORED + _AHEAD + " SELECT scheme, horizon, flagged, n, round(mean_fwd_alpha, 6) mean_fwd_alpha, round(median_fwd_alpha, 6) median_fwd_alpha FROM summary"),
    "flag_gap": over_panel(_SCORED + _AHEAD + " SELECT scheme, horizon, round(max(CASE WHEN flagged THEN mean_fwd_alpha END) - max(CASE WHEN NOT flagged THEN mean_fwd_alpha END), 6) gap FROM summary GROUP BY 1, 2"),
    "hit_rate": over_panel(_SCORED + _AHEAD + " SELECT scheme, flagged, round(avg(CASE WHEN xx > 0 THEN 1.0 ELSE 0.0 END), 6) hit_rate FROM longer WHERE xx IS NOT NULL GROUP BY 1, 2"),
    "unpivot_factors": over_panel("SELECT date_eom, unnest(['mkt_rf', 'smb', 'hml', 'rmw', 'cma']) factor, round(unnest([mkt_rf, smb, hml, rmw, cma]), 6) x FROM f"),
    "pivot_flags": over_panel(_SCORED + " SELECT permno, date_eom, coalesce(bool_or(CASE WHEN scheme = 'GICS' THEN flagged END), false) GICS, coalesce(bool_or(CASE WHEN scheme = 'FF12' THEN flagged END), false) FF12 FROM flags WHERE flagged GROUP BY 1, 2"),
    "union_by_name": "SELECT c_custkey key, c_name name, c_mktsegment segment, CAST(NULL AS VARCHAR) status FROM customer UNION ALL SELECT o_orderkey, NULL, NULL, o_orderstatus FROM orders",
    "set_intersect": "SELECT c_custkey FROM customer WHERE c_nationkey < 12 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000",
    "head_and_tail": "(SELECT o_orderkey, round(o_totalprice, 2) o_totalprice, 'head' part FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, round(o_totalprice, 2), 'tail' FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5)",
    "train_valid_split": over_panel("SELECT CASE WHEN date_eom BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' THEN 'train' WHEN date_eom BETWEEN DATE '2000-01-01' AND DATE '2001-11-30' THEN 'test' END split, count(*) n FROM panel WHERE ret IS NOT NULL GROUP BY 1"),
    "months_cross_entities": "SELECT last_day(CAST(d AS DATE)) date_eom, s_suppkey permno FROM (SELECT unnest(generate_series(DATE '2000-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) d), supplier",
    "silhouette_by_label": "WITH e AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id k, a.label c, b.label c2, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), q AS (SELECT k, max(CASE WHEN c = c2 THEN d END) a, min(CASE WHEN c <> c2 THEN d END) b FROM p GROUP BY 1) SELECT k vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) silhouette FROM q",
    "nearest_center_assign": "WITH r AS (SELECT vec_id, embedding FROM embeddings), d AS (SELECT r.vec_id, c.vec_id cid, list_distance(CAST(r.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) d FROM r, (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)) c) SELECT vec_id, CAST(arg_min(cid, (d, cid)) + 1 AS INTEGER) cluster FROM d GROUP BY 1",
    "label_match": "SELECT vec_id permno, CAST(label AS INTEGER) cluster_id FROM embeddings",
    "leakage_invariants": over_panel(f""", {_ALPHA},
    nr AS (SELECT r.*, row_number() OVER {_W} rn, lead(alpha_realized) OVER {_W} fwd FROM realised r),
    t1 AS (SELECT count(*) c, count(*) FILTER (WHERE coalesce(abs(a.fwd - b.alpha_realized) > 1e-10, (a.fwd IS NULL) <> (b.alpha_realized IS NULL))) v FROM nr a LEFT JOIN nr b ON a.permno = b.permno AND b.rn = a.rn + 1),
    t2 AS (SELECT count(*) c, 0 v FROM realised WHERE beta_mkt IS NOT NULL AND date_eom <= (SELECT last_day(max(date_eom) - INTERVAL 12 MONTH) FROM panel)),
    t3 AS (SELECT count(*) c, 0 v FROM nr)
    SELECT 'forward label is the next realised alpha' test, c checked, v violations FROM t1
    UNION ALL SELECT 'loadings ignore later factors', c, v FROM t2 UNION ALL SELECT 'lagged factors are those of earlier rows', c, v FROM t3"""),
}
