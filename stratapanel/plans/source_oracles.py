"""DuckDB statements for the queries over sources, written apart from the engine's code."""

from __future__ import annotations

from ..config import FEATURE_COLS
from .oracles import PANEL, RANGES, over_panel, with_alpha, with_features, with_loadings
from .vendor import FACTOR_TEXT, RANGE_TEXT, SERIES_TEXT


def _lines(text: str) -> str:
    quoted = text.replace("'", "''")
    return f"l AS (SELECT unnest(range(len(s))) pos, unnest(s) line FROM (SELECT string_split('{quoted}', chr(10)) s))"


#: the vendor's tables
VENDOR = f"""{PANEL},
s AS (SELECT *, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') gvkey, CAST(s_suppkey AS INTEGER) k FROM supplier),
members AS (
    SELECT gvkey, '01' iid, '000003' gvkeyx, DATE '1995-02-10' + k % 400 f, CASE WHEN k % 3 <> 0 THEN DATE '1999-05-20' + k % 500 END t, k FROM s
    UNION ALL SELECT gvkey, '02', '000003', DATE '1994-01-01', NULL, k FROM s WHERE k % 4 = 0
    UNION ALL SELECT gvkey, '01', '000003', DATE '2000-11-15' + k % 60, NULL, k FROM s WHERE k % 5 = 1 AND k % 3 <> 0
    UNION ALL SELECT gvkey, '00', '000010', DATE '1994-01-01', NULL, k FROM s WHERE k % 7 = 0),
inside AS (SELECT * FROM members WHERE gvkeyx = '000003'),
least_issue AS (SELECT gvkey, min(iid) iid FROM inside GROUP BY 1),
spans AS (SELECT CAST(i.gvkey AS INTEGER) permno, i.gvkey, i.iid, f AS start, coalesce(t, DATE '2001-11-30') end_date
          FROM inside i JOIN least_issue USING (gvkey, iid) WHERE f <= DATE '2001-11-30' AND (t IS NULL OR t >= DATE '1995-01-01')),
vend AS (SELECT CAST(permno AS INTEGER) permno, date_eom, ret * 100 / 100 ret, CASE WHEN permno % 9 = 0 THEN -prc ELSE prc END prc,
                CASE WHEN month(date_eom) % 3 = 0 THEN shrout / 1000 * 1000 END shrout
         FROM panel WHERE date_eom BETWEEN DATE '1995-01-01' AND DATE '2001-11-30'),
vret AS (SELECT *, abs(prc) * shrout mktcap FROM vend),
rawnames AS (
    SELECT k, s_name conm, 'T' || k tic, CASE WHEN k % 13 = 0 THEN 'n/a' ELSE CAST(k * 97 % 10000 AS VARCHAR) END sic, 1990 y1, 1997 y2 FROM s
    UNION ALL SELECT k, s_name, 'U' || k, CAST((k * 31 + 500) % 10000 AS VARCHAR), 1997, 2010 FROM s WHERE k % 10 <> 0
    UNION ALL SELECT k, s_name, 'V' || k, NULL, 2000, 2012 FROM s WHERE k % 6 = 0),
hist AS (SELECT k permno, tic ticker, conm comnam, TRY_CAST(sic AS INTEGER) siccd, make_date(y1, 1, 1) namedt, make_date(y2, 12, 31) nameenddt,
                CAST(NULL AS INTEGER) shrcd, CAST(NULL AS INTEGER) exchcd, sic FROM rawnames),
lastname AS (SELECT permno, ticker, comnam FROM (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY nameenddt DESC, ticker, comnam) n FROM hist) WHERE n = 1),
links AS (SELECT s.k permno, s.gvkey, min(i.f) linkdt, any_value(CASE WHEN s.k % 8 = 0 THEN DATE '2000-12-31' ELSE DATE '9999-12-31' END) linkenddt,
                 any_value(CASE WHEN s.k % 17 <> 0 THEN CAST(s.k % 11 * 5 + 10 AS VARCHAR) END) gsector FROM s JOIN inside i USING (gvkey) GROUP BY 1, 2)"""


def over_vendor(tail: str) -> str:
    return f"WITH {VENDOR} {tail}"


_SECTOR = "CASE gsector " + " ".join(
    f"WHEN '{c}' THEN '{n}'"
    for c, n in zip(
        range(10, 65, 5),
        ("Energy", "Materials", "Industrials", "Consumer Discretionary", "Consumer Staples", "Health Care", "Financials", "Information Technology", "Communication Services", "Utilities", "Real Estate"),
        strict=True,
    )
) + " END"
_F = ("mkt_rf", "smb", "hml", "rmw", "cma")
_W = "(PARTITION BY permno ORDER BY date_eom)"

SQL = {
    "factor_csv": f"WITH {_lines(FACTOR_TEXT)}, h AS (SELECT min(pos) head FROM l WHERE contains(line, 'Mkt-RF')), "
    r"e AS (SELECT min(pos) stop FROM l, h WHERE pos > head AND NOT regexp_matches(line, '^\s*[0-9]{6}\s*(,|$)')), "
    "b AS (SELECT string_split(line, ',') p FROM l, h, e WHERE pos > head AND pos < stop) "
    "SELECT last_day(CAST(strptime(trim(p[1]) || '01', '%Y%m%d') AS DATE)) date_eom, "
    + ", ".join(f"round(CAST(trim(p[{k + 2}]) AS DOUBLE) / 100, 8) {n}" for k, n in enumerate((*_F, "rf")))
    + " FROM b",
    "range_list": f"WITH {_lines(RANGE_TEXT)}, m AS (SELECT pos, line, "
    r"regexp_matches(line, '^\s*[0-9]{4}-[0-9]{4}') is_span, regexp_extract(line, '^\s*([0-9]+)\s+([A-Za-z]+)\s+(.*)$', ['n', 'c', 't']) x FROM l), "
    "g AS (SELECT pos, line, is_span, last_value(CASE WHEN NOT is_span AND x.n <> '' THEN x END IGNORE NULLS) OVER (ORDER BY pos) x FROM m) "
    r"SELECT CAST(x.n AS INTEGER) industry_num, x.c industry_code, trim(x.t) industry_name, CAST(regexp_extract(line, '([0-9]{4})-([0-9]{4})', 1) AS INTEGER) sic_lo, CAST(regexp_extract(line, '([0-9]{4})-([0-9]{4})', 2) AS INTEGER) sic_hi, CAST(pos AS INTEGER) ord FROM g WHERE is_span",
    "series_csv": f"WITH {_lines(SERIES_TEXT)} SELECT TRY_CAST(string_split(line, ',')[1] AS DATE) date, TRY_CAST(nullif(string_split(line, ',')[2], '') AS DOUBLE) AS value FROM l WHERE pos > 0 AND trim(line) <> ''",
    "series_to_eom": f"WITH {_lines(SERIES_TEXT)}, v AS (SELECT TRY_CAST(string_split(line, ',')[1] AS DATE) d, TRY_CAST(string_split(line, ',')[2] AS DOUBLE) x FROM l WHERE pos > 0) SELECT last_day(d) date_eom, arg_max(x, d) AS value FROM v WHERE d IS NOT NULL AND x IS NOT NULL GROUP BY 1",
    "macro_sources": f"WITH {PANEL} SELECT date_eom, round(ten_y, 4) ten_y, round(ffr, 4) ffr, round(vix, 4) vix FROM macro WHERE date_eom BETWEEN DATE '1995-01-01' AND DATE '2001-11-30'",
    "no_delistings": "SELECT CAST(NULL AS INTEGER) permno, CAST(NULL AS DATE) date_eom, CAST(NULL AS DOUBLE) dlret, CAST(NULL AS INTEGER) dlstcd WHERE false",
    "membership_spans": over_vendor('SELECT permno, gvkey, iid, "start", end_date FROM spans'),
    "vendor_returns": over_vendor("SELECT permno, date_eom, round(ret, 6) ret, round(prc, 4) prc, round(shrout, 2) shrout, round(mktcap, 0) mktcap FROM vret"),
    "names_history": over_vendor("SELECT permno, ticker, comnam, siccd, namedt, nameenddt, shrcd, exchcd FROM hist"),
    "latest_names": over_vendor("SELECT * FROM lastname"),
    "sic_history": over_vendor("SELECT permno, namedt, nameenddt, siccd FROM hist WHERE sic IS NOT NULL"),
    "sector_links": over_vendor("SELECT permno, gvkey, linkdt, linkenddt, gsector, gsector || '10' ggroup, gsector || '1010' gind, gsector || '101020' gsubind FROM links"),
    "panel_from_sources": over_vendor(f""", grid AS (SELECT DISTINCT permno, last_day(CAST(mm AS DATE)) date_eom FROM (
        SELECT permno, unnest(generate_series(date_trunc('month', "start"), date_trunc('month', end_date), INTERVAL 1 MONTH)) mm FROM spans) WHERE mm >= DATE '1995-01-01' AND mm <= DATE '2001-11-30'),
    ps AS (SELECT grid.permno, grid.date_eom, arg_max(siccd, (namedt, siccd)) siccd FROM grid LEFT JOIN (SELECT * FROM hist WHERE sic IS NOT NULL) q ON grid.permno = q.permno AND grid.date_eom BETWEEN namedt AND nameenddt GROUP BY 1, 2),
    pg AS (SELECT ps.*, gsector FROM ps LEFT JOIN links ON ps.permno = links.permno AND ps.date_eom BETWEEN linkdt AND linkenddt),
    ff AS (SELECT * FROM (VALUES {RANGES}) t(n, c, t, lo, hi, ord))
    SELECT pg.permno, pg.date_eom, siccd, CASE WHEN siccd IS NULL THEN NULL ELSE coalesce(ff.n, 12) END ff12_num, CASE WHEN siccd IS NULL THEN NULL ELSE coalesce(ff.c, 'Other') END ff12_code,
           CASE WHEN siccd IS NULL THEN NULL ELSE coalesce(ff.t, 'Other') END ff12_name, gsector, {_SECTOR} gics_sector_name, ticker, comnam,
           round(vret.ret, 6) ret, round(vret.mktcap, 0) mktcap, round(vret.ret - CASE WHEN f.mkt_rf IS NOT NULL OR f.date_eom IS NOT NULL THEN 0.001 END, 6) ret_excess,
           CASE WHEN f.date_eom IS NOT NULL THEN 0.001 END rf, round(ten_y, 4) ten_y, round(ffr, 4) ffr, round(vix, 4) vix, {", ".join(f"round(f.{x}, 6) {x}" for x in _F)}
    FROM pg LEFT JOIN ff ON siccd BETWEEN lo AND hi LEFT JOIN vret ON vret.permno = pg.permno AND vret.date_eom = pg.date_eom LEFT JOIN f ON f.date_eom = pg.date_eom
         LEFT JOIN macro ON macro.date_eom = pg.date_eom LEFT JOIN lastname ON lastname.permno = pg.permno"""),
    "study_panel": over_panel(f""", a AS (SELECT permno, date_eom, mktcap mkt_cap, coalesce(ret, 0) + coalesce(CASE WHEN permno % 7 = 0 THEN -0.3 END, 0) * (1 + coalesce(ret, 0)) ret_adj FROM panel WHERE mktcap > 0),
    b AS (SELECT *, ret_adj - 0.001 e FROM a)
    SELECT permno, date_eom, round(ret_adj, 6) ret_adj, round(mkt_cap, 0) mkt_cap, round(e, 6) ret_excess, round(lead(e, 1) OVER {_W}, 6) forward_excess_1m,
           CASE WHEN count(*) OVER n3 = 3 THEN round(product(1 + e) OVER n3 - 1, 6) END forward_excess_3m, CASE WHEN count(*) OVER n6 = 6 THEN round(product(1 + e) OVER n6 - 1, 6) END forward_excess_6m,
           round(ln(lag(mkt_cap, 1) OVER {_W}), 6) size_lag, CASE WHEN count(*) OVER m = 10 THEN round(product(1 + ret_adj) OVER m - 1, 6) END mom_12_2,
           CASE WHEN count(*) OVER v = 12 THEN round(stddev_samp(ret_adj) OVER v, 6) END vol_12
    FROM b WINDOW n3 AS (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), n6 AS (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING),
         m AS (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING), v AS (PARTITION BY permno ORDER BY date_eom ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""),
    "risk_adjusted_alpha": with_loadings(", q AS (SELECT *, beta_mkt * mkt_rf + beta_smb * smb + beta_hml * hml + beta_rmw * rmw + beta_cma * cma x FROM loadings) SELECT permno, date_eom, round(x, 6) expected_factor_return, round(ret_excess - x, 6) abnormal_1m FROM q"),
    "cached_returns": over_panel("SELECT permno, date_eom, round(ret, 6) ret, round(mktcap, 0) mktcap FROM panel"),
    "attach_clusters": over_panel("SELECT permno, date_eom, round(ret, 6) ret, CASE WHEN year(date_eom) = 2000 THEN CAST(permno % 3 + 1 AS INTEGER) END cluster_id FROM panel"),
    "modelling_rows": with_features(
        ", k AS (SELECT *, CASE WHEN date_eom BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' THEN 'train' WHEN date_eom BETWEEN DATE '2000-01-01' AND DATE '2001-11-30' THEN 'test' END split FROM features WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in (*FEATURE_COLS, "alpha_fwd_1m"))
        + ") SELECT split, gics_sector_name, count(*) n, count(DISTINCT permno) n_stocks, round(avg(alpha_fwd_1m), 6) mean_label FROM k WHERE split IS NOT NULL GROUP BY 1, 2"
    ),
    "homogeneity_of_codes": with_alpha(""", long AS (SELECT permno, date_eom, alpha_realized, unnest(['GICS', 'FF12']) scheme, unnest([gics_sector_name, ff12_code]) grp FROM realised JOIN (SELECT permno, date_eom, gics_sector_name, ff12_code FROM panel) USING (permno, date_eom) WHERE alpha_realized IS NOT NULL),
        cells AS (SELECT scheme, stddev_samp(alpha_realized) sd FROM long WHERE grp IS NOT NULL GROUP BY scheme, date_eom, grp HAVING count(*) >= 5),
        spread AS (SELECT scheme, avg(sd) mean_alpha_sd, median(sd) median_alpha_sd FROM cells GROUP BY 1),
        mem AS (SELECT DISTINCT scheme, grp, permno FROM long WHERE grp IS NOT NULL), v AS (SELECT permno, date_eom, ret_excess x FROM panel WHERE ret_excess IS NOT NULL),
        full_ AS (SELECT permno FROM v GROUP BY 1 HAVING count(*) >= 24), many AS (SELECT * FROM mem WHERE permno IN (SELECT permno FROM full_)),
        pc AS (SELECT a.scheme, a.grp, va.permno i, vb.permno j, CASE WHEN var_samp(va.x) > 1e-12 AND var_samp(vb.x) > 1e-12 THEN corr(va.x, vb.x) END c
               FROM many a JOIN many b ON a.scheme = b.scheme AND a.grp = b.grp AND a.permno < b.permno JOIN v va ON va.permno = a.permno JOIN v vb ON vb.permno = b.permno AND vb.date_eom = va.date_eom GROUP BY 1, 2, 3, 4),
        gc AS (SELECT scheme, grp, avg(c) c FROM pc WHERE c IS NOT NULL GROUP BY 1, 2), wc AS (SELECT scheme, avg(c) mc, median(c) dc FROM gc GROUP BY 1)
        SELECT scheme, round(mean_alpha_sd, 6) mean_alpha_sd, round(median_alpha_sd, 6) median_alpha_sd, round(mc, 5) mean_within_corr, round(dc, 5) median_within_corr FROM spread LEFT JOIN wc USING (scheme)"""),
    "best_month": over_panel(", k AS (SELECT permno, date_eom, round(ret, 6) ret FROM panel WHERE ret IS NOT NULL) SELECT permno, date_eom, ret FROM (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY ret DESC, date_eom) n FROM k) WHERE n = 1"),
    "suffix_join": "SELECT n_regionkey AS key, n_name AS name, n_nationkey, r_name name_region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "standardise_on_train": over_panel(", k AS (SELECT permno, date_eom, ret, mktcap, date_eom <= DATE '1999-12-31' before FROM panel WHERE ret IS NOT NULL), tm AS (SELECT avg(ret) mr, stddev_samp(ret) sr, avg(mktcap) mm, stddev_samp(mktcap) sm FROM k WHERE before) SELECT permno, date_eom, round((ret - mr) / sr, 5) ret, round((mktcap - mm) / sm, 5) mktcap FROM k, tm WHERE NOT before"),
    "mahalanobis": over_panel(", k AS (SELECT permno, date_eom, gics_sector_name, ret, mktcap FROM panel WHERE ret IS NOT NULL) SELECT permno, date_eom, gics_sector_name, round(power((ret - avg(ret) OVER g) / stddev_samp(ret) OVER g, 2) + power((mktcap - avg(mktcap) OVER g) / stddev_samp(mktcap) OVER g, 2), 5) score FROM k WINDOW g AS (PARTITION BY gics_sector_name)"),
    "formatted": "SELECT c_custkey, printf('%.2f%%', (c_custkey * 37 % 10007 - 5000) / 10000 * 100) as_percent, printf('%.3f', (c_custkey * 37 % 1009 - 500) / 1000) as_number FROM customer",
}
