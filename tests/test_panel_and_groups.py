"""The panel build on small sources, and grouped statistics and models against plain versions of them."""

import itertools
import zipfile
import zlib
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.config import EngineConfig
from stratapanel.operators import elastic_net, iforest
from stratapanel.operators.clustering import match_labels, relabelled
from stratapanel.operators.crosssection import quantiles, with_zscores
from stratapanel.operators.joins import with_suffix
from stratapanel.plans import study
from stratapanel.plans.panel import build_panel
from stratapanel.sources import text

CONFIG = EngineConfig(start_date=date(2020, 1, 1), end_date=date(2020, 4, 30))


@pytest.fixture(scope="module")
def sources(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    d = date
    return {
        "members": frame([(1, d(2019, 5, 1), d(2020, 3, 10)), (1, d(2020, 2, 1), d(2020, 2, 20)), (2, d(2020, 4, 5), d(2020, 12, 31)), (3, d(2018, 1, 1), d(2019, 1, 1))], "permno int, start date, end_date date"),
        "sic_history": frame([(1, d(2019, 1, 1), d(2020, 2, 29), 150), (1, d(2020, 2, 1), d(2020, 12, 31), 9999), (2, d(2020, 5, 1), d(2020, 12, 31), 150)], "permno int, namedt date, nameenddt date, siccd int"),
        "gics": frame([(1, d(1900, 1, 1), d(2020, 2, 29), "40"), (2, d(1900, 1, 1), d(9999, 12, 31), "99")], "permno int, linkdt date, linkenddt date, gsector string"),
        "monthly": frame([(1, d(2020, 1, 31), 0.1, 5.0), (1, d(2020, 3, 31), None, 7.0), (9, d(2020, 1, 31), 1.0, 1.0)], "permno int, date_eom date, ret_total double, mktcap double"),
        "stocknames_latest": frame([(1, "ONE", "One Inc")], "permno int, ticker string, comnam string"),
        "ff5": frame([(d(2020, 1, 31), *[0.01] * 5, 0.001)], "date_eom date, mkt_rf double, smb double, hml double, rmw double, cma double, rf double"),
        "ff12_def": frame([(1, "NoDur", "Nondurables", 100, 999, 0)], "industry_num int, industry_code string, industry_name string, sic_lo int, sic_hi int, ord int"),
        "macro": frame([(d(2020, 1, 31), 1.5, 0.1, 18.0)], "date_eom date, ten_y double, ffr double, vix double"),
    }


def test_panel_has_a_row_for_each_member_and_month(spark, sources):
    rows = {(r.permno, r.date_eom.month): r for r in build_panel(sources, CONFIG).collect()}
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, 4)}
    assert (rows[1, 1].siccd, rows[1, 2].siccd, rows[2, 4].siccd) == (150, 9999, None)  # the later start of two that hold
    assert (rows[1, 1].ff12_code, rows[1, 2].ff12_code, rows[2, 4].ff12_code) == ("NoDur", "Other", None)
    assert (rows[1, 1].gics_sector_name, rows[1, 3].gsector, rows[2, 4].gsector, rows[2, 4].gics_sector_name) == ("Financials", None, "99", None)
    assert rows[1, 1].ret_excess == pytest.approx(0.099) and rows[1, 2].ret is None and rows[1, 3].mktcap == 7 and rows[1, 1].vix == 18
    assert (rows[1, 1].ticker, rows[2, 4].ticker) == ("ONE", None)
    twice = sources | {"monthly": sources["monthly"].unionByName(sources["monthly"])}
    assert build_panel(twice, CONFIG).count() == 6
    with pytest.raises(ValueError, match="repeated"):
        build_panel(twice, CONFIG, check=True)
    assert build_panel(sources | {"members": sources["members"].where("false")}, CONFIG).count() == 0


def test_quantiles_equal_numpys(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 3 else g, float(v)) for g, n in ((0, 400), (1, 1), (2, 37), (3, 50), (4, 300)) for v in (rng.integers(0, 5, n) if g == 4 else rng.normal(size=n))] + [(0, None), (7, None)]
    frame = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = {r.g: (r.a, r.b, r.c) for r in quantiles(frame, "x", ["g"], {"a": 0.05, "b": 0.5, "c": 0.99}).collect()}
    want = {}
    for g, x in rows:
        if x is not None:
            want.setdefault(g, []).append(x)
    assert set(got) == set(want)
    for g, x in want.items():
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.05, 0.5, 0.99])))
    assert quantiles(frame.where("false"), "x", ["g"], {"a": 0.5}).count() == 0
    z = {r.g: r.z for r in with_zscores(frame, {"x": "z"}, "g").where("g = 1 or g = 7").collect()}
    assert z == {1: 0.0, 7: 0.0}


def test_nets_from_sums_equal_those_from_rows(spark):
    rng = np.random.default_rng(5)
    table = pd.DataFrame(rng.normal(size=(600, 3)), columns=["a", "b", "c"])
    table["y"] = table.a * 2 - table.b + rng.normal(size=600) * 0.3
    table["scheme"], table["grp"] = "s", np.where(np.arange(600) % 3 == 0, "one", "two")
    table["permno"], table["date_eom"], table["split"], table["fold"] = np.arange(600), date(2020, 1, 31), np.where(np.arange(600) % 4 == 0, "test", "train"), np.arange(600) % 5
    table.loc[table.index[:3], "grp"] = "few"
    got = elastic_net.predict_groups(spark.createDataFrame(table), ("a", "b", "c"), "y").toPandas()
    assert set(got.grp) == {"one", "two"}
    for grp, part in table[table.grp != "few"].groupby("grp"):
        train, test = part[part.split == "train"], part[part.split == "test"]
        beta, _ = elastic_net.cross_validated(train[["a", "b", "c"]].to_numpy(), train.y.to_numpy(), train.fold.to_numpy())
        own = got[got.grp == grp].sort_values("permno")
        assert (own.n_train == len(train)).all() and np.allclose(own.y_hat, beta[0] + test[["a", "b", "c"]].to_numpy() @ beta[1:], atol=1e-6)
    hot = study.one_hot_net(spark.createDataFrame(table).withColumn("kind", F.col("grp")), ("a", "b", "c"), "y", "kind", 1).toPandas()
    assert len(hot) == 150 and set(hot.scheme) == {"kind"} and np.corrcoef(hot.y_hat, hot.y_true)[0, 1] > 0.9


def test_forests_score_groups_part_by_part(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 2))
    x[7] = 30
    rows = pd.DataFrame({"scheme": "s", "grp": np.where(np.arange(500) < 460, "big", "small"), "permno": np.arange(500), "date_eom": date(2020, 1, 31), "split": np.where(np.arange(500) % 2 == 0, "train", "test"), "u": x[:, 0], "v": x[:, 1]})
    frame = spark.createDataFrame(rows)
    whole = iforest.score_groups(frame, ("u", "v"), 20).toPandas().set_index("permno").iso_score
    monkeypatch.setattr(iforest, "PART", 50)
    parts = iforest.score_groups(frame, ("u", "v"), 20).toPandas()
    assert len(parts) == 230 and set(parts.grp) == {"big"}  # the small group trains on 20 rows
    assert np.allclose(parts.set_index("permno").iso_score.sort_index(), whole.sort_index()) and whole.idxmax() == 7
    big = rows[(rows.grp == "big") & (rows.split == "train")].sort_values("permno")
    forest = iforest.IsolationForest(big[["u", "v"]].to_numpy(), 20, 256, 8675309 + zlib.crc32(b"s/big"))
    assert np.allclose(forest.scores(rows[rows.permno.isin(whole.index)][["u", "v"]].to_numpy()), whole.sort_index())
    flags = study.in_group_flags(frame.drop("split"), ("u", "v"), 20).toPandas()
    assert len(flags) == 500 and flags[flags.grp == "small"].iso_score.isna().all() and not flags[flags.grp == "small"].flagged.any() and flags.flagged.sum() == 23


def test_labels_from_counts(spark):
    before = {k: k % 3 + 1 for k in range(30)}
    after = {k: {1: 9, 2: 8, 3: 7}[k % 3 + 1] if k < 25 else 7 for k in range(32)}
    want = match_labels(before, after)
    frames = [spark.createDataFrame(sorted(x.items()), "permno int, cluster_id int") for x in (before, after)]
    assert {r.permno: r.cluster_id for r in relabelled(*frames).collect()} == want and want[0] == 1
    assert {r.cluster_id for r in relabelled(frames[0].where("false"), frames[1]).collect()} == {7, 8, 9}


def test_suffixes_and_the_study_panel(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, n string"), spark.createDataFrame([(1, "y", 2)], "k int, n string, m int")
    assert with_suffix(a, b, ["k"], "_b").first().asDict() == {"k": 1, "n": "x", "n_b": "y", "m": 2}
    months = [(1, date(2020 + k // 12, k % 12 + 1, 1), 0.01 * k, -0.3 if k == 3 else None, float(k)) for k in range(16)]
    frame = spark.createDataFrame(months, "permno int, date_eom date, ret double, dlret double, mktcap double").withColumn("date_eom", F.last_day("date_eom"))
    rows = study.study_panel(frame, frame.select("date_eom", F.lit(0.001).alias("rf"))).orderBy("date_eom").collect()
    assert len(rows) == 15 and rows[2].ret_adj == pytest.approx(0.03 - 0.3 - 0.009)
    ahead = [r.ret_excess for r in rows]
    assert rows[4].forward_excess_3m == pytest.approx(np.prod([1 + x for x in ahead[5:8]]) - 1) and rows[12].forward_excess_3m is None
    assert rows[11].vol_12 is None and rows[12].vol_12 == pytest.approx(np.std([r.ret_adj for r in rows[:12]], ddof=1))
    assert rows[12].mom_12_2 == pytest.approx(np.prod([1 + r.ret_adj for r in rows[:10]]) - 1)


def test_zipped_texts_are_read_in_place(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("folder/factors.csv", ",Mkt-RF,SMB,HML,RMW,CMA,RF\r\n199901, 1,2,3,4,5,6\r\n")
        z.writestr("other.txt", "no")
    lines = text.read_zipped(spark, str(tmp_path / "a.zip"), "factors.csv")
    assert [r.rf for r in text.parse_factor_csv(lines).collect()] == [0.06]


def test_bootstrap_intervals_cover_the_mean(spark):
    from stratapanel.operators import resample

    weights = resample.poisson_weights(np.arange(4000, dtype=np.int64), np.arange(50))
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05 and abs((weights == 0).mean() - np.exp(-1)) < 0.01
    rng = np.random.default_rng(7)
    rows = [(k, "a" if k % 2 else "b", float(v)) for k, v in enumerate(rng.normal(5, 2, 800))] + [(900, "a", None)]
    frame = spark.createDataFrame(rows, "k int, g string, x double").repartition(3)
    got = {r.g: r for r in resample.bootstrap_mean(frame, "x", "k", ["g"], 400).collect()}
    for g in "ab":
        x = np.array([v for _, h, v in rows if h == g and v is not None])
        half = 1.96 * x.std(ddof=1) / np.sqrt(len(x))
        assert got[g].n == len(x) and got[g].estimate == pytest.approx(x.mean()) and got[g].low < x.mean() < got[g].high
        assert (got[g].high - got[g].low) / 2 == pytest.approx(half, rel=0.2)
    again = {r.g: r for r in resample.bootstrap_mean(frame.repartition(5), "x", "k", ["g"], 400).collect()}
    assert again["a"].low == pytest.approx(got["a"].low)


def test_remote_tables_push_down(spark):
    """The JDBC sources against the in-memory database that ships with Spark."""
    from stratapanel.sources import cache

    options = {"url": "jdbc:derby:memory:panel;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    assert cache.jdbc_options("h", "db", "u", "p")["url"] == "jdbc:postgresql://h:5432/db?sslmode=require"
    rows = spark.createDataFrame([(k, float(k) / 2) for k in range(100)], "k int, x double")
    rows.write.format("jdbc").options(**options).option("dbtable", "months").mode("overwrite").save()
    lazy = cache.jdbc_table(spark, options, "months", ("k", 0, 100, 4))
    assert lazy.rdd.getNumPartitions() == 4 and lazy.count() == 100
    some = lazy.where("k > 90").select("x")
    plan = some._jdf.queryExecution().executedPlan().toString().lower()
    assert "pushedfilters: [" in plan and "greaterthan(k,90)" in plan and some.count() == 9
    assert cache.jdbc_query(spark, options, 'SELECT MAX("x") AS m FROM months').first()[0] == 49.5


def test_mean_correlations_by_blocks(spark, monkeypatch):
    from stratapanel.operators import matrix

    rng = np.random.default_rng(8)
    rows = [(e % 3, e, t, float(rng.normal() + (t % 5) * (e % 2)) if e else 1.0) for e in range(40) for t in range(30) if rng.random() < 0.8]
    frame = spark.createDataFrame(rows, "g int, e int, t int, v double")
    pairs = matrix.pair_correlations(frame, "e", "t", "v", 24, ["g"]).where("corr is not null").groupBy("g").agg(F.avg("corr").alias("c")).collect()
    monkeypatch.setattr(matrix, "BLOCK", 5)
    got = {r.g: r["corr"] for r in matrix.mean_correlations(frame, "e", "t", "v", 24, ["g"]).collect()}
    assert got == pytest.approx({r.g: r.c for r in pairs}) and len(got) == 3


def test_pair_correlations_by_blocks(spark, monkeypatch):
    from stratapanel.operators import matrix

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 25))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 3]), np.nan, 1.5)
    x[15:, 5] = x[:15, 6] = np.nan
    monkeypatch.setattr(matrix, "PAIRS", 7)
    monkeypatch.setattr(matrix, "STRIP", 40)
    frame = spark.createDataFrame([(f"e{e}", int(t), float(x[t, e])) for t, e in zip(*np.nonzero(~np.isnan(x)), strict=True)], "e string, t int, v double")
    got = matrix.pair_correlations(frame, "e", "t", "v", 12)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join [t#" not in plan and "Join [e#" not in plan  # products by time are no rows
    kept = [e for e in range(25) if (~np.isnan(x[:, e])).sum() >= 12]
    want = {}
    for a, b in itertools.combinations(sorted(f"e{e}" for e in kept), 2):
        u, v = (x[:, int(e[1:])] for e in (a, b))
        both = ~np.isnan(u) & ~np.isnan(v)
        if both.any():
            vary = both.sum() > 1 and "e3" not in (a, b)
            want[a, b] = (both.sum(), np.corrcoef(u[both], v[both])[0, 1] if vary else None)
    found = {(r.a, r.b): (r.n, r["corr"]) for r in got.collect()}
    assert found.keys() == want.keys() and got.count() == len(want)
    for pair, (n, c) in want.items():
        assert found[pair][0] == n and found[pair][1] == (c if c is None else pytest.approx(c, abs=1e-9))


def test_sums_of_correlations_by_pattern(monkeypatch):
    from stratapanel.operators import correlation, matrix

    rng = np.random.default_rng(12)
    x = rng.normal(size=(20, 90))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 4] = 2.0
    x[3, 9] = np.inf
    x[:9, 11] = x[9:, 12] = np.nan
    finite = np.where(np.isinf(x), 0, x)
    plain = matrix.cross_correlations(finite, finite)
    plain[9] = plain[:, 9] = np.nan
    side = np.arange(90) % 3 == 0
    monkeypatch.setattr(correlation, "TILE_ROWS", 7)
    monkeypatch.setattr(correlation, "TILE_COLUMNS", 16)
    for big in (1, 5, 1000):
        monkeypatch.setattr(correlation, "BIG", big)
        found = correlation.Correlations(x)
        scaled = [found.scaled(p, p).any() for p in range(found.big)]
        assert found.pairs()[1] == (~np.isnan(plain[np.triu_indices(90, 1)])).sum() and (big > 999 or any(scaled))
        assert found.pairs()[0] == pytest.approx(np.nansum(plain[np.triu_indices(90, 1)]))
        between = plain[side][:, ~side]
        assert found.pairs(side) == (pytest.approx(np.nansum(between)), (~np.isnan(between)).sum())


def test_components_take_little_more_than_the_values():
    import tracemalloc

    from stratapanel.operators import correlation, matrix

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5000))
    x[(rng.random((40, 25)) < 0.1)[:, np.arange(5000) % 25]] = np.nan
    found = correlation.Correlations(x)
    tracemalloc.start()
    found.components(10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * found.values.nbytes
    few = x[:, :300]
    few[rng.random(few.shape) < 0.1] = np.nan
    want = matrix.principal_components(matrix.correlation_matrix(few), 10)
    for blocks in (1, 6):  # begun anew again and again, or not
        assert np.abs(correlation.Correlations(few).components(10, blocks=blocks) - want).max() < 1e-7


def test_principal_components_of_embeddings(spark, tmp_path):
    from stratapanel.plans.queries import QUERIES

    x = np.random.default_rng(9).normal(size=(60, 12)) * np.arange(1, 13)
    spark.createDataFrame([(k, r.tolist(), 0) for k, r in enumerate(x)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["pca_embeddings"](spark, str(tmp_path)).orderBy("vec_id").toPandas().drop(columns="vec_id").to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u * s)[:, :10]
    assert got.shape == (60, 10) and np.allclose(np.abs(got), np.abs(want), atol=1e-3)
