import os
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.config import BETAS, FACTORS, FEATURE_COLS, EngineConfig
from stratapanel.operators import clustering, matrix
from stratapanel.operators.elastic_net import Gram, cross_validated, descend, fit_path, minimise
from stratapanel.operators.iforest import IsolationForest
from stratapanel.operators.windows import momentum, rolling_ols, rolling_sd, with_lags
from stratapanel.plans import compare, features
from stratapanel.sources import text


@pytest.fixture(scope="module")
def synthetic(spark):
    """60 stocks x 132 months in three groups with known loadings."""
    rng = np.random.default_rng(42)
    months = pd.date_range("2014-01-31", "2024-12-31", freq="ME")
    sd = [0.045, 0.025, 0.025, 0.020, 0.020]
    factor = rng.normal([0.005, 0.001, 0, 0.002, 0.001], sd, (len(months), 5))
    beta = {1: [0.8, -0.2, 0.4], 2: [1.2, 0.5, -0.3], 3: [1.0, 0.0, 0.0]}
    names = {1: ("Manuf", "Industrials", "20"), 2: ("Hlth", "Health Care", "35"), 3: ("Money", "Financials", "40")}
    parts = []
    for k in range(60):
        g = k % 3 + 1
        b = np.concatenate([beta[g] + rng.normal(0, 0.1, 3), rng.normal(0, 0.2, 2)])
        excess = factor @ b + rng.normal(0, 0.04, len(months))
        part = pd.DataFrame({"permno": 10001 + k, "date_eom": months.date, "ret_excess": excess, "ret": excess + 0.001, "mktcap": np.exp(rng.normal(22, 1, len(months)))})
        part[list(FACTORS)] = factor
        part[["ff12_code", "gics_sector_name", "gsector"]] = names[g]
        parts.append(part)
    rows = pd.concat(parts).assign(ten_y=0.025, ffr=0.02, vix=18.0)
    return rows, spark.createDataFrame(rows)


CONFIG = EngineConfig()


def test_rolling_ols_equals_least_squares(spark, synthetic):
    rows, df = synthetic
    few = [10001, 10002]
    gaps = df.where(F.col("permno").isin(few)).withColumn("ret_excess", F.when(F.dayofyear("date_eom") % 5 != 0, F.col("ret_excess")))
    got = features.with_loadings(gaps, CONFIG).orderBy("permno", "date_eom").toPandas()
    one = got[got.permno == 10001].reset_index(drop=True)
    for k in (36, 37, 60, 131):
        if k < 37:
            assert np.isnan(one.beta_mkt[k]) and np.isnan(one.n_obs[k])
            continue
        window = one.iloc[k - 37 : k - 1].dropna(subset=["ret_excess"])
        x = np.column_stack([np.ones(len(window)), window[list(FACTORS)]])
        b, *_ = np.linalg.lstsq(x, window.ret_excess, rcond=None)
        fit = x @ b
        assert one.n_obs[k] == len(window)
        assert np.allclose(one.loc[k, ["alpha", *BETAS]].to_numpy(float), b, atol=1e-9)
        assert one.rsq[k] == pytest.approx(1 - ((window.ret_excess - fit) ** 2).sum() / ((window.ret_excess - window.ret_excess.mean()) ** 2).sum())


def test_rolling_ols_guards(spark):
    def fit(n, missing):
        rng = np.random.default_rng(1)
        rows = [(1, date(1990 + k // 12, k % 12 + 1, 28), None if k < missing else float(rng.normal()), float(rng.normal())) for k in range(n)]
        names = {"alpha": "a", "x": "b", "rsq": "r", "n_obs": "n"}
        return rolling_ols(spark.createDataFrame(rows, "permno int, date_eom date, y double, x double"), "y", ("x",), names).orderBy("date_eom").collect()[-1]

    assert (fit(37, 0).b, fit(37, 0).n) == (None, None)
    assert fit(38, 0).b is not None and fit(38, 0).n == 36
    assert (fit(38, 13).b, fit(38, 13).n) == (None, 23)
    assert fit(38, 12).b is not None
    flat = [(1, date(1990 + k // 12, k % 12 + 1, 28), float(k % 5), 1.0) for k in range(40)]
    names = {"alpha": "a", "x": "b", "rsq": "r", "n_obs": "n"}
    last = rolling_ols(spark.createDataFrame(flat, "permno int, date_eom date, y double, x double"), "y", ("x",), names).orderBy("date_eom").collect()[-1]
    assert last.b is None and last.n == 36


def test_positional_lag_momentum_and_volatility(spark):
    rows = spark.createDataFrame([(1, date(2020, m, 28), 0.1 if m != 3 else None) for m in (1, 2, 4)], "permno int, date_eom date, ret double")
    got = with_lags(rows, {"l": ("ret", 1)}).orderBy("date_eom").collect()
    assert [r.l for r in got] == [None, 0.1, 0.1]
    rows = spark.createDataFrame([(1, date(2020 + k // 12, k % 12 + 1, 28), 0.01 * k if k != 5 else None) for k in range(14)], "permno int, date_eom date, ret double")
    got = rows.withColumns({"m": momentum(), "v": rolling_sd()}).orderBy("date_eom").collect()
    assert got[11].m is None and got[10].v is None and got[11].v is not None
    want = np.prod([1 + (0.01 * k if k != 5 else 0) for k in range(1, 11)]) - 1
    assert got[12].m == pytest.approx(want)


def test_features_and_invariants(spark, synthetic):
    _, df = synthetic
    built = features.build_features(df, CONFIG)
    assert {"alpha_realized", "alpha_fwd_1m", "mom_12_1", "z_beta_mkt"} <= set(built.columns)
    assert {r.test: r.violations for r in features.violations(built, df, CONFIG).collect()} == dict.fromkeys(
        ["forward label is the next realised alpha", "loadings ignore later factors", "lagged factors are those of earlier rows"], 0
    )
    broken = built.withColumn("alpha_fwd_1m", F.col("alpha_realized"))
    with pytest.raises(AssertionError, match="leakage"):
        features.assert_no_leakage(broken, df, CONFIG)


def test_clusters_and_comparisons(spark, synthetic):
    rows, df = synthetic
    assigned, diagnosis = clustering.clusters_annual(df, CONFIG, grid=(2, 3, 4), starts=5)
    found = diagnosis.toPandas()
    assert len(found) == 7 and found.k.notna().all() and (found.n_stocks == 60).all()
    assert assigned.count() == 60 * 84
    built = compare.attach_clusters(features.build_features(df, CONFIG), assigned).cache()
    assert built.count() == len(rows)
    rand, tables = compare.composition(built)
    got = {r.comparison: (r.adj_rand, r.n_stocks) for r in rand.collect()}
    assert got["GICS vs FF12"] == (1, 60) and -1 <= got["GICS vs Cluster"][0] <= 1
    assert tables["gics_vs_ff12"].agg(F.sum("n")).first()[0] == 60
    same = {r.scheme: r for r in compare.homogeneity(built, df).collect()}
    assert same["GICS"].mean_within_corr == pytest.approx(same["FF12"].mean_within_corr) and 0 < same["GICS"].mean_alpha_sd < 0.2
    groups, schemes = compare.prediction(built, CONFIG)
    by = {r.scheme: r for r in schemes.collect()}
    assert set(by) == {"GICS", "FF12", "Cluster", "Pooled"} and by["GICS"].n_groups == 3 and by["Pooled"].n_test_total >= by["GICS"].n_test_total
    assert all(0 <= r.dir_acc <= 1 for r in groups.collect())
    flags, overlap, ahead = compare.anomalies(built, CONFIG, trees=20)
    shares = flags.groupBy("scheme", "grp").agg(F.avg(F.col("flagged").cast("double")).alias("s")).collect()
    assert all(0.04 < r.s < 0.08 for r in shares)
    pairs = {(r.a, r.b): r.jaccard for r in overlap.collect()}
    assert pairs["GICS", "Cluster"] == pairs["Cluster", "GICS"] and pairs["FF12", "FF12"] == 1
    assert {(r.scheme, r.horizon) for r in ahead.collect()} == {(s, h) for s in ("GICS", "FF12", "Cluster") for h in (1, 3, 6)}


def test_homogeneity_makes_an_entitys_series_once(spark, synthetic, monkeypatch):
    made, series = [], matrix._series

    def counted(*args):
        out = series(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(matrix, "_series", counted)
    _, df = synthetic
    built = features.build_features(df, CONFIG)
    schemes = {"GICS": "gics_sector_name", "FF12": "ff12_code"}
    got = {r.scheme: r for r in compare.homogeneity(built, df, schemes).collect()}
    assert made == [60]
    members = built.where("alpha_realized is not null").select("permno", F.col("gics_sector_name").alias("grp")).distinct()
    plain = matrix.mean_correlations(df.join(members, "permno"), "permno", "date_eom", "ret_excess", 24, ["grp"])
    assert got["GICS"].mean_within_corr == pytest.approx(plain.agg(F.avg("corr")).first()[0])


def test_label_matching():
    same = {k: k % 4 + 1 for k in range(20)}
    assert clustering.match_labels(same, {k: (v % 4) + 1 for k, v in same.items()}) == same
    assert clustering.match_labels({}, {1: 2}) == {1: 2}
    got = clustering.match_labels({1: 1, 2: 1, 3: 2}, {1: 5, 2: 5, 3: 6, 9: 7})
    assert got == {1: 1, 2: 1, 3: 2, 9: None}
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n in (1, 2, 4, 5):
        gain = rng.random((n, n))
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert sum(gain[i, j] for i, j in enumerate(clustering.assignment(gain))) == pytest.approx(best)


def test_correlation_and_silhouette(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 1.0
    got = matrix.correlation_matrix(x)
    both = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1])
    assert got[0, 1] == pytest.approx(np.corrcoef(x[both, 0], x[both, 1])[0, 1])
    assert (got[3] == 0).all()
    rows = spark.createDataFrame([(e, t, float(x[t, e])) for e in range(4) for t in range(30) if not np.isnan(x[t, e])], "e int, t int, v double")
    long = {(r.a, r.b): r["corr"] for r in matrix.pair_correlations(rows, "e", "t", "v", 1).collect()}
    assert long[0, 1] == pytest.approx(got[0, 1]) and long[0, 3] is None
    y = np.vstack([rng.normal(0, 1, (10, 2)), rng.normal(6, 1, (12, 2)), [[50, 50]]])
    label = np.array([0] * 10 + [1] * 12 + [2])
    wide = spark.createDataFrame([(k, y[k].tolist(), int(label[k])) for k in range(len(y))], "k int, v array<double>, c int")
    each = matrix.silhouettes(wide, "k", "v", "c").collect()
    assert np.mean([r.silhouette for r in each]) == pytest.approx(matrix.mean_silhouette(y, label))
    assert {r.k: r.silhouette for r in each}[22] == 0


def test_elastic_net_reaches_the_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * [1, 2, 3, 1, 1, 0]
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=200) + 3
    r, c, *_ = Gram.of(x, y).scaled()
    lam, alpha = 0.05, 0.5
    b = descend(r, c, lam, alpha, np.zeros(6))

    def objective(b):
        return b @ r @ b / 2 - c @ b + lam * (alpha * np.abs(b).sum() + (1 - alpha) / 2 * b @ b)

    assert all(objective(b) <= objective(b + rng.normal(0, 0.01, 6) * (np.arange(6) < 5)) for _ in range(200))
    twins = np.column_stack([x, x[:, 0], x[:, 1] + 1e-6 * rng.normal(size=200)])
    for wide in (x, twins):
        r, c, *_ = Gram.of(wide, y).scaled()
        start = np.zeros(len(c))
        for lam in np.geomspace(1, 1e-4, 30):
            start = minimise(r, c, lam, alpha, start)
            g = c - r @ start - lam * (1 - alpha) * start  # the conditions of a minimum
            assert np.all(np.abs(g[(start == 0) & (np.diag(r) > 0)]) <= lam * alpha + 1e-6) and np.allclose(g[start != 0], lam * alpha * np.sign(start[start != 0]), atol=1e-5)
    free = fit_path(Gram.of(x[:, :5], y), np.zeros(1), 0.5)[0]
    exact, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x[:, :5]]), y, rcond=None)
    assert np.allclose(free, exact, atol=1e-4)
    beta, _ = cross_validated(x, y, np.arange(200) % 5)
    assert abs(beta[1] - 2) < 0.3 and beta[6] == 0


def test_isolation_forest_finds_the_outlier():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(300, 3)), [[9, 9, 9]]])
    scores = IsolationForest(x, 100, 256, 1).scores(x)
    assert scores.argmax() == 300 and 0 < scores.min() < scores.max() < 1
    assert np.allclose(IsolationForest(np.ones((40, 3)), 5).scores(np.ones((2, 3))), IsolationForest(np.ones((40, 3)), 5).scores(np.ones((2, 3))))


def test_registered_models_do_the_operators_whole_work(spark, monkeypatch):
    from stratapanel.plans import queries

    asked = []
    monkeypatch.setattr(queries, "panel", lambda spark, d: spark.range(1).select(F.lit(1).alias("permno"), F.lit("2020-01-31").alias("date_eom")))
    monkeypatch.setattr(queries, "compared", lambda spark, d: (None, None))
    monkeypatch.setattr(queries, "clusters_annual", lambda *a, **k: asked.append((a[2:], k)) or (None, None))
    monkeypatch.setattr(queries.compare, "anomalies", lambda *a, **k: asked.append((a[2:], k)) or (None, None, None))
    monkeypatch.setattr(queries.resample, "bootstrap_mean", lambda *a, **k: asked.append((a[4:], k)))
    for name in ("clusters_annual_diagnosis", "iforest_group", "iforest_overlap", "bootstrap_ci"):
        queries.QUERIES[name](spark, "")
    assert asked == [((), {})] * 4


def test_forest_of_embeddings_sees_every_coordinate(spark, tmp_path):
    from stratapanel.plans.queries import QUERIES

    x = np.random.default_rng(16).normal(size=(200, 64))
    x[17, 40:] = 9.0
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    scores = {r.permno: r.iso_score for r in QUERIES["iforest_embeddings"](spark, str(tmp_path)).collect()}
    assert len(scores) == 200 and max(scores, key=scores.get) == 17


def test_parsers(spark, tmp_path):
    csv = tmp_path / "factors.csv"
    csv.write_text("preamble, 199901\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n199901, 1.00,2,3,4,5,0.5\n199902,-1.0,x,3,4,5,0.5\n\n Annual\n1999,9,9,9,9,9,9\n")
    got = sorted(tuple(r) for r in text.parse_factor_csv(text.lines(spark, str(csv))).collect())
    assert [g[0] for g in got] == [date(1999, 1, 31), date(1999, 2, 28)] and got[0][1:] == pytest.approx((0.01, 0.02, 0.03, 0.04, 0.05, 0.005)) and got[1][2] is None
    ranges = tmp_path / "codes.txt"
    ranges.write_text(" 1 NoDur  Nondurables -- Food\n          0100-0999\n          2000-2399\n\n 2 Durbl  Durables\n          2500-2519\n12 Other  Other\n")
    got = [tuple(r)[:5] for r in text.parse_range_list(text.lines(spark, str(ranges))).orderBy("ord").collect()]
    assert got == [(1, "NoDur", "Nondurables -- Food", 100, 999), (1, "NoDur", "Nondurables -- Food", 2000, 2399), (2, "Durbl", "Durables", 2500, 2519)]
    series = tmp_path / "series.csv"
    series.write_text("date,value\n2020-01-02,1.5\n2020-01-03,.\n2020-01-06,NA\n2020-01-07,\n")
    assert [r.value for r in text.read_series_csv(spark, str(series)).orderBy("date").collect()] == [1.5, None, None, None]


def test_cache_and_raw_sources(spark, tmp_path):
    from stratapanel.sources import cache, raw

    calls = []
    path = f"file://{tmp_path}/t"

    def make():
        calls.append(1)
        return spark.range(3)

    assert cache.cached_table(spark, path, make).count() == cache.cached_table(spark, path, make).count() == 3 and len(calls) == 1
    cache.cached_table(spark, path, make, force=True)
    assert len(calls) == 2 and cache.list_files(spark, f"{path}/*.parquet").count() >= 1
    members = spark.createDataFrame(
        [("001", "02", "I", date(2013, 1, 1), None), ("001", "01", "I", date(2010, 1, 1), date(2012, 1, 1)), ("002", "01", "I", date(2015, 1, 1), date(2016, 1, 1)), ("003", "01", "J", date(2015, 1, 1), None)],
        "gvkey string, iid string, gvkeyx string, `from` date, thru date",
    )
    got = raw.membership(members, "I", date(2014, 1, 1), date(2024, 12, 31)).collect()
    assert [(r.permno, r.iid) for r in got] == [(2, "01")]  # firm 1's least issue left before the window
    months = spark.createDataFrame([("002", "01", date(2015, 3, 15), -10.0, 5.0, None, 1), ("002", "01", date(2015, 6, 30), 11.0, None, 2.0, 1)], "gvkey string, iid string, datadate date, prccm double, trt1m double, cshoq double, exchg int")
    got = {r.date_eom: r for r in raw.monthly_returns(months, members, "I", date(2014, 1, 1), date(2024, 12, 31)).collect()}
    assert got[date(2015, 3, 31)].ret == 0.05 and got[date(2015, 3, 31)].mktcap is None and got[date(2015, 6, 30)].mktcap == 22000
    names = spark.createDataFrame([("002", "Two", "TWO", "x12", 2010, 2020), ("002", "Two B", "TWOB", "2000", 2015, 2020)], "gvkey string, conm string, tic string, sic string, year1 int, year2 int")
    hist = raw.stock_names(names, members, "I")
    assert sorted((r.siccd is None, r.namedt) for r in hist.collect()) == [(False, date(2015, 1, 1)), (True, date(2010, 1, 1))]
    assert raw.latest_names(hist).first().ticker == "TWO"
    company = spark.createDataFrame([("002", "20", None)], "gvkey string, gsector string, dldte date").selectExpr("*", "'2010' ggroup", "'201010' gind", "'20101010' gsubind")
    link = raw.sector_links(company, members, "I").first()
    assert (link.linkdt, link.linkenddt) == (date(2015, 1, 1), date(9999, 12, 31))


def test_clusters_hold_no_matrix_of_entities(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(6)
    n, t = 2100, 40
    x = rng.normal(size=(t, 3)) @ rng.normal(size=(3, n)) + rng.normal(size=(t, n))
    for e in range(0, n, 3):
        x[e % 4, e] = np.nan
    x[7:9, 5] = x[11, 8] = np.nan
    x[~np.isnan(x[:, 20]), 20] = 1.0
    times = [np.flatnonzero(~np.isnan(c)) for c in x.T]
    window = pd.DataFrame({"permno": np.arange(n), "t": times, "v": [c[at] for c, at in zip(x.T, times, strict=True)]})
    tracemalloc.start()
    got = clustering.embed(window)
    points = np.stack(got["x"])
    label, _, _ = matrix.kmeans(points, 4, 5, 20, 1)
    sums = clustering.silhouette_sums(points, label[:, None], np.arange(n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * n
    assert sums[0] / n == pytest.approx(matrix.mean_silhouette(points, label), abs=1e-9)
    monkeypatch.setattr(clustering, "DENSE", n)
    dense = np.stack(clustering.embed(window)["x"])
    assert np.abs(points - dense).max() < 1e-8 * np.abs(dense).max()
    monkeypatch.setattr(matrix, "PIECE", 700)
    assert (matrix.kmeans(points, 4, 5, 20, 1)[0] == label).all()


def test_a_refit_reads_its_entities_batch_by_batch():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    n, t = 6000, 48
    x = rng.normal(size=(t, 2)) @ rng.normal(size=(2, n)) + rng.normal(size=(t, n))
    for e in range(0, n, 9):
        x[e % 4, e] = np.nan
    order = rng.permutation(n)
    times = [np.flatnonzero(~np.isnan(x[:, e])) for e in order]
    window = pd.DataFrame({"permno": order, "t": times, "v": [x[at, e] for e, at in zip(order, times, strict=True)]})
    batches = (pa.RecordBatch.from_pandas(window[lo : lo + 700], preserve_index=False) for lo in range(0, n, 700))
    who, wide = clustering.months(batches)
    assert (who == np.arange(n)).all() and np.array_equal(wide, x, equal_nan=True)
    batches = (pa.RecordBatch.from_pandas(window[lo : lo + 700], preserve_index=False) for lo in range(0, n, 700))
    got, whole = clustering.embed(batches), clustering.embed(window)
    assert got.permno.tolist() == whole.permno.tolist() and np.array_equal(np.stack(got.x), np.stack(whole.x))
    assert len(clustering.embed(iter(()))) == 0
    found, v = clustering.Correlations(x), rng.normal(size=(n, 14))
    want = matrix.correlation_matrix(x)[np.ix_(found.order, found.order)] @ v
    found.times(v)
    tracemalloc.start()
    times = found.times(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(times - want).max() < 1e-9 * np.abs(want).max()
    assert peak < x.nbytes  # no copy of the values for a pair of patterns


def test_kmeans_of_many_points_holds_one_start(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(4)
    n, starts = 40_000, 25
    x = rng.normal(size=(n, 5)) + 2 * rng.integers(0, 3, size=(n, 1))
    tracemalloc.start()
    label, centres, within = matrix.kmeans(x, 6, starts, 12, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * starts * n  # not a number for each point and start
    few = np.repeat(rng.normal(size=(3, 2)), 15_000, 0)  # of five centres two stay empty
    copies, k5 = np.repeat(x[:700], 60, 0), matrix.kmeans(few, 5, 4, 20, 1)
    k4 = matrix.kmeans(copies, 4, 7, 30, 3)
    monkeypatch.setattr(matrix, "PIECE", 1 << 21)  # all starts side by side
    for (a, b, c), points, args in (((label, centres, within), x, (6, starts, 12, 2)), (k5, few, (5, 4, 20, 1)), (k4, copies, (4, 7, 30, 3))):
        same, at, sum_ = matrix.kmeans(points, *args)
        assert np.array_equal(a, same) and np.allclose(b, at, rtol=0, atol=1e-9) and c == pytest.approx(sum_, rel=1e-9, abs=1e-12)


def test_tasks_of_points_hold_flat_numbers():
    import pyarrow as pa

    rows = pa.table({"permno": pa.array([5, 2, 9, 4], pa.int64()), "x": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]], "ks": pa.array([[2, 3]] * 4, pa.list_(pa.int32())), "own": [0, 1, 0, 1]})
    first, last = rows[:3].to_batches()[0], rows[3:].to_batches()[0]
    who, x, ks, own = clustering.entities(iter([first, last.slice(0, 0), last]), "x", "ks", "own")
    assert who.tolist() == [2, 4, 5, 9] and x.tolist() == [[3, 4], [7, 8], [1, 2], [5, 6]] and ks.tolist() == [[2, 3]] * 4 and own.tolist() == [1, 1, 0, 0]
    parts = list(clustering.slices({"k": pa.scalar(None, pa.float64()), "permno": np.arange(clustering.ROWS + 1)}))
    assert [len(p) for p in parts] == [clustering.ROWS, 1] and parts[1].to_pylist() == [{"k": None, "permno": clustering.ROWS}]


def test_features_keep_only_what_is_asked_for(spark, synthetic):
    _, df = synthetic
    few = df.where("permno < 10004")
    keep = ("permno", "date_eom", "z_beta_hml", "alpha_fwd_3m")
    got = features.build_features(few, CONFIG, keep)
    assert got.columns == list(keep)
    assert "beta_mkt" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.exceptAll(features.build_features(few, CONFIG).select(*keep)).count() == 0 and got.count() == few.count()


def test_feature_list_is_built():
    assert len(FEATURE_COLS) == 16 and os.path.exists(os.path.dirname(__file__))


def test_groups_with_too_few_rows_give_none(spark, synthetic):
    _, df = synthetic
    few = df.where("permno < 10004").withColumn("cluster_id", F.lit(1))
    built = features.build_features(few, CONFIG)
    groups, schemes = compare.prediction(built.where(F.col("date_eom") > F.lit(date(2022, 11, 1))), CONFIG)
    assert groups.count() == 0 and {r.scheme for r in schemes.collect()} <= {"Pooled"}
    flags, _, ahead = compare.anomalies(built.where(F.col("date_eom") > F.lit(date(2022, 11, 1))), CONFIG, trees=5)
    assert flags.count() == 0 and ahead.count() == 0
    assert clustering.fit_refits(few, CONFIG).count() == 0
