"""Two-sample measures against numpy, and the behaviour expected of healthy and collapsed data."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import collapse as cd
from plumbline.operators import column_stats as cs
from plumbline.operators import learned
from plumbline.operators import longform as lf
from plumbline.functions.tails import chi_square_tail
from plumbline.plans.scorecard import scorecard

COLS = [f"f{i}" for i in range(4)]


def frame(spark, x, side):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])]).assign(side=side))


def pair(spark, syn, orig):
    return frame(spark, syn, "synthetic").unionByName(frame(spark, orig, "original"))


def samples(seed=1, n=400):
    rng = np.random.default_rng(seed)
    return rng.normal(0.3, 1.2, (n, 4)).round(2), rng.normal(0, 1, (n + 100, 4)).round(2)


def cdf_gap(a, b):
    v = np.unique(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), v, "right") / len(a), np.searchsorted(np.sort(b), v, "right") / len(b)
    return v, np.abs(fa - fb)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_rank_measures_do_not_depend_on_buckets(spark, buckets):
    syn, orig = samples()
    p = pair(spark, syn, orig)
    got = cd.rank_metrics(cd.rank_table(p, COLS, buckets)).toPandas().set_index("col")
    for i, c in enumerate(COLS):
        v, gap = cdf_gap(syn[:, i], orig[:, i])
        assert got.loc[c, "ks"] == pytest.approx(gap.max())
        assert got.loc[c, "w1"] == pytest.approx((gap[:-1] * np.diff(v)).sum())
        r = pd.Series(np.concatenate([syn[:, i], orig[:, i]])).rank().to_numpy()
        u1 = r[: len(syn)].sum() - len(syn) * (len(syn) + 1) / 2
        assert got.loc[c, "u"] == pytest.approx(max(u1, len(syn) * len(orig) - u1))


def test_edges_need_not_fit_the_data(spark):
    syn, orig = samples()
    counts = cd.counted_cells(pair(spark, syn, orig), COLS)
    a = lf.running_counts(counts, ["n_syn", "n_orig"], {c: [] for c in COLS}).toPandas()
    b = lf.running_counts(counts, ["n_syn", "n_orig"], {c: [-9.0, -0.5, 0.1, 0.2, 77.0] for c in COLS}).toPandas()
    key = ["col", "val"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_histograms_against_numpy(spark):
    syn, orig = samples(3)
    got = cd.per_column(pair(spark, syn, orig), COLS).toPandas().set_index("col")
    for i, c in enumerate(COLS):
        hs, edges = np.histogram(syn[:, i], bins=50)
        ho, _ = np.histogram(orig[:, i], bins=edges)
        p, q = hs / (hs.sum() + 1e-10), ho / (ho.sum() + 1e-10)
        assert got.loc[c, "intersection"] == pytest.approx(np.minimum(p, q).sum(), abs=0.02)
        own = np.histogram(orig[:, i], bins=50)[0] + 1e-10
        own = own / own.sum()
        assert got.loc[c, "h_orig"] == pytest.approx(-(own * np.log(own)).sum(), abs=0.02)


def test_anderson_darling_level(spark):
    """Under equal distributions the statistic is near zero with deviation near one."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 40)), rng.normal(size=(250, 40))
    cols = [f"f{i}" for i in range(40)]
    ad = cd.rank_metrics(cd.rank_table(pair(spark, x, y), cols)).toPandas()["ad"]
    assert abs(ad.mean()) < 0.6 and 0.5 < ad.std() < 1.7


def test_harmonic_sums_at_every_size(spark):
    from pyspark.sql import functions as F

    sizes = [2, 3, 6, 50, 1000, 1001, 3000]
    rows = spark.createDataFrame([(float(n),) for n in sizes], "n double").select("n", cd.harmonic(F.col("n")).alias("h"), cd.harmonic_pairs(F.col("n")).alias("g")).collect()
    for r in rows:
        n = int(r["n"])
        assert r["h"] == pytest.approx(sum(1 / i for i in range(1, n)), abs=1e-9)
        below = np.concatenate([[0], np.cumsum([1 / (n - i) for i in range(1, n)])])
        assert r["g"] == pytest.approx(sum(below[j - 1] / j for j in range(1, n)), abs=1e-9)


def holey(seed, n, d, side=None):
    x = np.random.default_rng(seed).normal(size=(n, d)).cumsum(axis=1)
    x[np.random.default_rng(seed + 1).random((n, d)) < 0.2] = np.nan
    return x


def with_nulls(spark, x, side):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (side,) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", side string")


@pytest.mark.parametrize("d", [12, 13])
def test_nulls_follow_one_rule_at_every_width(spark, d):
    x = holey(3, 200, d)
    df, cols = with_nulls(spark, x, "original"), [f"f{i}" for i in range(d)]
    want = pd.DataFrame(x)
    got = {(r["i"], r["j"]): r["r"] for r in cs.correlations(df, cols).collect()}
    cov = learned.covariances(df, cols)[""]
    for i in range(d):
        for j in range(i + 1, d):
            assert got[(i, j)] == pytest.approx(want.corr()[i][j])
            assert cov[i, j] == pytest.approx(want.cov()[i][j])
        assert cov[i, i] == pytest.approx(want[i].var())


def test_two_sample_measures_take_nulls(spark):
    p = with_nulls(spark, holey(5, 150, 3), "synthetic").unionByName(with_nulls(spark, holey(6, 170, 3), "original"))
    cols = ["f0", "f1", "f2"]
    assert cd.per_column(p, cols).count() == 3 and cd.mutual_information(p, cols).count() == 3
    series = p.selectExpr("*", "monotonically_increasing_id() AS row_id")
    rows = {r["dim_name"]: r["score"] for r in scorecard(p, cols, (series, cols, "row_id", 64)).collect()}
    assert len(rows) == 9 and all(0 <= v <= 100 for v in rows.values())


def test_spectra_keep_the_place_of_nulls(spark):
    from plumbline.operators import spectral

    x = np.sin(np.arange(150) * 0.7)
    rows = [(s, i, None if i == 40 else float(x[i])) for s, n in (("synthetic", 150), ("original", 100)) for i in range(n)]
    bins = spectral.power_bins(spectral.blocks(spark.createDataFrame(rows, "side string, row_id long, v double"), ["v"], "row_id", 64), 64)
    got = {(r["side"], r["block"], r["k"]): r["psd"] for r in bins.collect()}
    x[40] = 0.0
    for side, n in (("synthetic", 150), ("original", 100)):
        for b in range(-(-n // 64)):
            part = np.zeros(64)
            part[: len(x[b * 64 : min(n, b * 64 + 64)])] = x[b * 64 : min(n, b * 64 + 64)]
            assert np.allclose([got[(side, b, k)] for k in range(33)], np.abs(np.fft.rfft(part)) ** 2)
    assert spectral.compare_spectra(bins).count() == 1


def test_information_of_every_column(spark):
    x = np.random.default_rng(1).normal(size=(60, 25))
    assert cd.mutual_information(pair(spark, x, x + 1), [f"f{i}" for i in range(25)]).count() == 25


def test_own_dimensions_count(spark):
    x = np.random.default_rng(8).normal(size=(80, 4))
    extra = {"same_rows": (90.0, lambda p, cols: p.selectExpr("count(*) AS rows").selectExpr("rows", "50.0D AS score"))}
    rows = {r["dim_name"]: r for r in scorecard(pair(spark, x, x), COLS, extra=extra).collect()}
    assert rows["same_rows"]["score"] == 50.0 and not rows["same_rows"]["passed"] and rows["same_rows"]["metrics"]["rows"] == 160
    eight = [r["score"] for n, r in rows.items() if n != "overall"]
    assert len(eight) == 9 and rows["overall"]["score"] == pytest.approx(sum(eight) / 9)


def test_tails():
    assert chi_square_tail(30.1435, 19) == pytest.approx(0.05, abs=1e-4)
    assert chi_square_tail(31.4104, 20) == pytest.approx(0.05, abs=1e-4)


def test_identical_sides_score_full(spark):
    _, x = samples()
    m = cd.per_column(pair(spark, x, x), COLS).toPandas()
    assert (m["ks"] == 0).all() and (m["w1"] == 0).all()
    assert np.allclose(m["kl"], 0) and np.allclose(m["intersection"], 1) and np.allclose(m["chi2"], 0)


def test_healthy_and_collapsed(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(1000, 4))
    tiled = np.tile(rng.normal(size=(10, 4)), (100, 1))
    good = {r["dim_name"]: r for r in scorecard(pair(spark, x, x), COLS).collect()}
    bad = {r["dim_name"]: r for r in scorecard(pair(spark, tiled, x), COLS).collect()}
    assert good["overall"]["score"] > 65 and good["overall"]["passed"]
    assert bad["overall"]["score"] < 80 and bad["overall"]["score"] < good["overall"]["score"]
    assert good["gradient_health"]["score"] == good["gradient_health"]["threshold"]


def test_constant_side_scores_low(spark):
    x = np.random.default_rng(0).normal(size=(100, 4))
    rows = {r["dim_name"]: r["score"] for r in scorecard(pair(spark, np.ones((100, 4)), x), COLS).collect()}
    assert rows["overall"] < 55 and rows["distribution_fidelity"] < 50


def test_input_gate(spark):
    x = np.full((10, 1), np.nan)
    x[:3] = 1.0
    df = frame(spark, x, "original")
    assert cd.input_gate(df, ["f0"]).first()["verdict"] == "too_many_nan"
    assert cd.input_gate(df.limit(0), ["f0"]).first()["verdict"] == "empty"
    assert cd.input_gate(frame(spark, np.ones((3, 1)), "a"), ["f0"], max_rows=2).first()["verdict"] == "too_many_rows"
    with pytest.raises(ValueError):
        cd.require_valid(df, ["f0"])


def test_aligned_to_the_shorter_list(spark):
    a, b = spark.createDataFrame([(1.0, 2.0, "x")], "p double, q double, t string"), spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    both, cols = cd.align(a, b)
    assert cols == ["a", "b"] and both.count() == 2
    assert lf.dropped_columns(a) == ["t"]


def test_wide_correlations_equal_narrow_ones(spark):
    x = np.random.default_rng(2).normal(size=(500, 5))
    x[:, 4] = 3.0  # flat
    df = frame(spark, x, "original")
    cols = [f"f{i}" for i in range(5)]
    a = cs.correlations(df, cols).toPandas().sort_values(["i", "j"])["r"].to_numpy()
    b = cs.gram_correlations(df, cols, []).toPandas().sort_values(["i", "j"])["r"].to_numpy()
    want = np.corrcoef(x[:, :4].T)
    assert np.allclose(a, b)
    assert a[0] == pytest.approx(want[0, 1]) and a[3] == 0


def test_effective_dimension():
    assert learned.effective_dimension(np.diag([9.5, 0.3, 0.2])) == 1
    assert learned.effective_dimension(np.eye(4)) == 4
    assert learned.effective_dimension(np.eye(65)) == 59


def test_stats_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (1.0, None, 2.0), (1.0, None, float("inf"))], "c double, n double, x double")
    s = {r["col"]: r for r in cs.column_stats(df, ["c", "n", "x"]).collect()}
    assert s["c"]["distinct"] == 1 and s["c"]["skew"] == 0 and s["c"]["std"] == 0
    assert s["n"]["nulls"] == 3 and s["n"]["count"] == 0 and s["n"]["median"] is None
    assert s["x"]["max"] == 1e10 and s["x"]["min"] == 0


def test_sql_names(spark):
    from plumbline.functions import sql_names

    sql_names.register(spark)
    r = spark.sql("SELECT bin_counts(array(0D, 0.5D, 9D, NULL, -3D, 99D), 0D, 10D, 5) AS h, psi(array(1L, 1L), array(1L, 1L)) AS p, ks_of_counts(array(4L, 0L), array(0L, 4L)) AS k").first()
    assert r["h"] == [3, 0, 0, 0, 2] and r["p"] == 0 and r["k"] == 1
