"""As-of joins, gaps, grids and smoothers against pandas / NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwater.config import DAY, LENIENT, STRICT
from stillwater.operators import asof, grid as G, kalman, kernels, lowess, screens, smoothers

rng = np.random.default_rng(3)


def series(n=120, lakes=(1, 2), span=400.0):
    parts = []
    for i in lakes:
        t = np.sort(rng.choice(int(span * DAY), n, replace=False)).astype(float)
        parts.append(pd.DataFrame({"lake_id": i, "index_col": np.arange(n), "time": t, "wse": np.sin(t / 1e6) + rng.normal(0, 0.1, n)}))
    return pd.concat(parts, ignore_index=True)


def test_asof_against_pandas(spark):
    left, right = series(150), series(60).rename(columns={"time": "gauge_time", "wse": "gauge_wse"})
    right = pd.concat([right, left.head(5).rename(columns={"time": "gauge_time", "wse": "gauge_wse"})]).drop_duplicates(["lake_id", "gauge_time"])
    l, g = spark.createDataFrame(left), spark.createDataFrame(right[["lake_id", "gauge_time", "gauge_wse"]])
    for tol in (DAY, 16 * DAY):
        got = asof.nearest(l, g, "lake_id", "time", "gauge_time", ["gauge_wse"], tol).toPandas()
        a = left.assign(t=pd.to_timedelta(left.time, "s")).sort_values("t")
        b = right.assign(t=pd.to_timedelta(right.gauge_time, "s")).sort_values("t")[["t", "lake_id", "gauge_wse"]]
        ref = pd.merge_asof(a, b, on="t", by="lake_id", direction="nearest", tolerance=pd.Timedelta(seconds=tol))
        m = got.merge(ref, on=["lake_id", "index_col"])
        assert len(m) == len(left)
        assert np.allclose(m.gauge_wse_x.fillna(-1), m.gauge_wse_y.fillna(-1))


def test_equal_distance_takes_the_earlier(spark):
    l = spark.createDataFrame([(1, 10.0 * DAY)], "lake_id long, time double")
    g = spark.createDataFrame([(1, 9.5 * DAY, 1.0), (1, 10.5 * DAY, 2.0)], "lake_id long, gauge_time double, gauge_wse double")
    assert asof.nearest(l, g, "lake_id", "time", "gauge_time", ["gauge_wse"], DAY).first().gauge_wse == 1.0


def test_gaps_and_coverage(spark):
    pdf = series(80)
    df = spark.createDataFrame(pdf)
    ref = pdf.assign(gap=pdf.groupby("lake_id").time.diff())
    got = asof.series_gaps(df, "lake_id", "time").toPandas().merge(ref, on=["lake_id", "index_col"])
    assert np.allclose(got.gap_seconds.fillna(-1), got.gap.fillna(-1))
    cov = asof.coverage(df, ["lake_id"], "time").toPandas().set_index("lake_id")
    assert np.allclose(cov.max_gap, ref.groupby("lake_id").gap.max())


def test_support_is_strict_on_gap_and_inclusive_on_span(spark):
    def verdict(days):
        df = spark.createDataFrame([(1, d * DAY) for d in days], "lake_id long, time double")
        c = asof.coverage(df, ["lake_id"], "time")
        return tuple(c.select(screens.supported(c, STRICT), screens.supported(c, LENIENT)).first())

    assert verdict([0, 90, 180, 270, 300, 365]) == (True, True)
    assert verdict([0, 90, 180, 271, 300, 365]) == (False, True)
    assert verdict([0, 90, 180, 270, 300, 364]) == (False, True)
    assert verdict([0, 90, 180, 270, 365]) == (False, False)


def test_gap_drop(spark):
    base = spark.createDataFrame([(1, d * DAY) for d in (0, 9, 78)], "lake_id long, time double")
    cand = spark.createDataFrame([(1, d * DAY) for d in (0, 5, 9, 10, 50, 78, 90)] + [(1, None), (2, 3.0)], "lake_id long, time double")
    got = screens.drop_in_gaps(cand, base, 30).toPandas()
    kept = sorted(x / DAY for x in got[got.lake_id == 1].time.dropna())
    assert kept == [0, 5, 9, 78, 90] and got.time.isna().sum() == 1 and (got.lake_id == 2).sum() == 1


def test_linear_grid_and_evaluation(spark):
    pdf = series(70)
    df = spark.createDataFrame(pdf)
    o = G.grid_origin(df)
    g = G.regular_grid(df)
    gp = g.toPandas()
    ev = series(50, span=450.0)
    at = G.at_times(spark.createDataFrame(ev), g.withColumn("curve", F.col("y")), o).toPandas()
    for i, s in pdf.groupby("lake_id"):
        x = s.time.min() + np.arange(int((s.time.max() - s.time.min()) // DAY) + 1) * DAY
        mine = gp[gp.lake_id == i].sort_values("k")
        y = np.interp(x, s.time, s.wse)
        assert np.allclose(mine.y, y)
        e = at[at.lake_id == i]
        assert np.allclose(e.smooth, np.interp(e.time, x, y))


def pchip_reference(x, y, at):
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    s = np.zeros_like(y)
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            s[i] = (w1 + w2) / (w1 / d[i - 1] + w2 / d[i])

    def end(h0, h1, d0, d1):
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(v) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v

    s[0], s[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    c = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    u = (at - x[c]) / h[c]
    return (y[c] * (1 + 2 * u) * (1 - u) ** 2 + s[c] * h[c] * u * (1 - u) ** 2 + y[c + 1] * u**2 * (3 - 2 * u)
            + s[c + 1] * h[c] * u**2 * (u - 1))


def test_pchip_grid_and_evaluation(spark):
    pdf = series(300, lakes=(1,), span=100.0)  # several rows per day
    df = spark.createDataFrame(pdf)
    g = G.pchip_grid(df).toPandas().sort_values("k")
    ref = pchip_reference(pdf.time.to_numpy(), pdf.wse.to_numpy(), g.g.to_numpy())
    assert np.allclose(g.y, ref)
    c = G.pchip_grid(df).withColumn("curve", F.col("y"))
    at = G.pchip_at_times(df, c, G.grid_origin(df)).toPandas()
    assert np.allclose(at.smooth, pchip_reference(g.g.to_numpy(), g.y.to_numpy(), at.time.to_numpy()))


def grid_frame(spark, values):
    rows = [(i, k, len(v) - 1, k * DAY, float(x)) for i, v in values.items() for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "lake_id long, k long, k_last long, g double, y double")


def test_savgol_reproduces_cubics_and_matches_helper(spark):
    x = np.arange(60)
    vals = {1: 5 + 0.3 * x - 0.02 * x**2 + 1e-4 * x**3, 2: rng.normal(size=60), 3: rng.normal(size=20), 4: rng.normal(size=7),
            5: rng.normal(size=4), 6: rng.normal(size=21), 7: rng.normal(size=22)}
    got = smoothers.savgol(grid_frame(spark, vals)).toPandas()
    for i, v in vals.items():
        mine = got[got.lake_id == i].sort_values("k").curve.to_numpy(dtype=float)
        assert np.allclose(mine, kernels.savgol(np.asarray(v, dtype=float)), equal_nan=True)
    assert np.allclose(got[got.lake_id == 1].sort_values("k").curve, vals[1])
    q = smoothers.savgol(grid_frame(spark, vals), 11, 2).toPandas()
    assert np.allclose(q[q.lake_id == 2].sort_values("k").curve, kernels.savgol(vals[2], 11, 2))


def test_running_median_pads_with_zeros(spark):
    vals = {1: 10 + rng.random(40), 2: 10 + rng.random(8)}
    got = smoothers.running_median(grid_frame(spark, vals)).toPandas()
    for i, v in vals.items():
        assert np.allclose(got[got.lake_id == i].sort_values("k").curve, kernels.running_median(v))
    assert got[(got.lake_id == 1) & (got.k == 0)].curve.iloc[0] == vals[1][:11].min()


def test_helpers_invariants():
    flat = np.full(50, 3.0)
    assert np.allclose(kernels.hampel(flat, 21), flat)
    assert np.allclose(kernels.local_level_smooth(flat), flat)
    noisy = np.cumsum(rng.normal(size=137))
    for name in kernels.WAVELET_TAPS:
        assert np.allclose(kernels.wavelet_denoise(noisy, name, threshold=0.0), noisy)
    spike = flat + rng.normal(0, 0.01, 50)
    spike[25] += 9
    assert abs(kernels.hampel(spike, 21)[25] - 3) < 0.1
    assert np.var(np.diff(kernels.local_level_smooth(noisy + rng.normal(0, 3, 137)))) < np.var(np.diff(noisy)) * 9
    x = np.sort(rng.random(80)) * 100
    for c in kernels.lowess_curves(x, 2 + 0.5 * x, x[3:60], [0.2, 0.5], [0, 2]):
        assert np.allclose(c, 2 + 0.5 * x[3:60])


@pytest.mark.parametrize("block", [256, 8])
def test_level_scan_equals_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(kalman, "BLOCK", block)
    vals = {1: np.cumsum(rng.normal(size=83)), 2: 5 + rng.normal(size=16), 3: np.array([2.0]), 4: np.array([1.0, 5.0]),
            5: np.full(30, 3.0), 6: 100 + 0.01 * rng.normal(size=17)}
    got = smoothers.kalman(grid_frame(spark, vals), 3).toPandas()
    for i, v in vals.items():
        c = got[got.lake_id == i].sort_values("k")
        assert np.allclose(c.y, v) and np.allclose(c.curve, kernels.local_level_smooth(v, 3), rtol=1e-10, atol=1e-10)


def test_midnight_grid_with_shape_preserving_cubics(spark):
    times = [0.25, 0.75, 3.5, 4.0, 6.5]
    rows = [(1, i, x * DAY, x) for i, x in enumerate(times)] + [(2, 9, 0.5 * DAY, 7.0)] + [
        (3, i, x * DAY, x * x) for i, x in enumerate((0.5, 1.5, 2.5))]
    df = spark.createDataFrame(rows, "lake_id long, index_col long, time double, wse double")
    g = G.pchip_grid(df, midnight=True).toPandas().sort_values(["lake_id", "k"])
    assert np.allclose(g[g.lake_id == 1].y, range(7)) and g[g.lake_id == 2].y.tolist() == [7.0]
    # slopes by hand: end 1, inner 8 / 3 of secants 2 and 4; u = -1/2 for the point ahead, 1/2 for the others
    ahead = 0.25 * 0 * 1.5**2 + 1 * -0.5 * 1.5**2 + 2.25 * 0.25 * 4 + 8 / 3 * 0.25 * -1.5
    assert np.isclose(g[(g.lake_id == 3) & (g.k == 0)].y.iloc[0], ahead)
    s = smoothers.sweep(df.filter("lake_id = 1"), df.filter("lake_id = 1"), "hampel", [{"window": 3}], interpolation="pchip").toPandas()
    assert np.allclose(s.bottom, s.wse)


def test_spline_is_the_least_squares_cubic(spark):
    pdf = series(60)
    df = spark.createDataFrame(pdf)
    got = smoothers.spline(df, df).toPandas()
    for i, s in got.groupby("lake_id"):
        s = s.sort_values("time")
        p = np.polynomial.Polynomial.fit(s.time, s.wse, 3)
        assert np.allclose(s.smooth, p(s.time)) and s.spline_ok.all()
    far = smoothers.spline(df, df, smoothing=1e-6).toPandas()
    assert far.smooth.isna().all() and not far.spline_ok.any()


def test_sweep_envelope_and_smallest_residual(spark):
    df = spark.createDataFrame(series(60, lakes=(1,)))
    s = smoothers.sweep(df, df, "median", [{"window": 5}, {"window": 11}])
    r = s.withColumn("r", screens.smallest_residual([F.get("curves", F.lit(i)) for i in range(2)], F.col("wse"))).toPandas()
    c = np.vstack(r.curves)
    assert np.allclose(r.bottom, c.min(axis=1)) and np.allclose(r.top, c.max(axis=1))
    d = c - r.wse.to_numpy()[:, None]
    assert np.allclose(r.r, d[np.arange(len(d)), np.abs(d).argmin(axis=1)])


@pytest.mark.parametrize("block", [1024, 16])
def test_lowess_blocks_equal_whole_series(spark, monkeypatch, block):
    monkeypatch.setattr(lowess, "BLOCK", block)
    pdf = series(90, lakes=(1, 2)).assign(is_base=True, is_eval=True)
    pdf.loc[pdf.index % 5 == 0, "is_base"] = False
    pdf.loc[pdf.index % 7 == 0, "is_eval"] = False
    df = spark.createDataFrame(pdf)
    got = smoothers.lowess(df, iterations=(0, 2)).toPandas()
    for i, s in pdf.groupby("lake_id"):
        s = s.sort_values("time")
        b, e = s[s.is_base], s[s.is_eval]
        x0 = b.time.iloc[0]
        c = kernels.lowess_curves(((b.time - x0) / DAY).to_numpy(), b.wse.to_numpy(), ((e.time - x0) / DAY).to_numpy(),
                                  smoothers.lowess_fractions(0.1, 0.5, 0.1), [0, 2])
        mine = got[got.lake_id == i].set_index("index_col").loc[e.index_col]
        assert np.allclose(mine.bottom, c.min(axis=0)) and np.allclose(mine.top, c.max(axis=0))
        r = c - e.wse.to_numpy()
        assert np.allclose(np.abs(mine.residual), np.abs(r).min(axis=0))


def test_lowess_of_long_series_in_blocks_of_the_rest_in_one_call(spark, monkeypatch):
    pdf = pd.concat([series(90, lakes=(1, 2)), series(40, lakes=(3,))]).assign(is_base=True, is_eval=True)
    pdf.loc[pdf.index % 5 == 0, "is_base"] = False
    pdf.loc[pdf.index % 7 == 0, "is_eval"] = False
    df = spark.createDataFrame(pdf)
    one = smoothers.lowess(df, iterations=(0, 1, 3))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "FlatMapCoGroupsInPandas" not in plan
    want = one.toPandas().sort_values(["lake_id", "index_col"])
    for rows, block in ((50, 16), (50, 1024), (1, 16)):
        monkeypatch.setattr(lowess, "GATHERED_ROWS", rows)
        monkeypatch.setattr(lowess, "BLOCK", block)
        got = smoothers.lowess(df, iterations=(0, 1, 3)).toPandas().sort_values(["lake_id", "index_col"])
        assert np.array_equal(got.index_col, want.index_col)
        for c in ("bottom", "top", "residual"):
            assert np.allclose(got[c], want[c], equal_nan=True)


def test_lowess_of_very_short_series(spark):
    df = spark.createDataFrame([(1, i, 86400.0 * i, 1.0, i < 2, True) for i in range(4)],
                               "lake_id long, index_col long, time double, wse double, is_base boolean, is_eval boolean")
    assert {r.residual for r in smoothers.lowess(df).collect()} == {None}


@pytest.mark.parametrize("name, level, threshold", [("db4", None, None), ("sym2", None, 0.3), ("coif1", 3, None), ("db4", 4, 0.1)])
def test_wavelet_bands_against_the_array_form(spark, name, level, threshold):
    curves = {i: np.cumsum(rng.normal(size=n)) for i, n in enumerate([1, 2, 5, 9, 29, 30, 113, 400])}
    rows = [(i, k, len(y) - 1, float(k), float(v)) for i, y in curves.items() for k, v in enumerate(y)]
    grid = spark.createDataFrame(rows, "lake_id long, k long, k_last long, g double, y double")
    got = smoothers.wavelet(grid, name, level, threshold).toPandas()
    assert len(got) == len(rows) and not got.duplicated(["lake_id", "k"]).any()
    taps = len(kernels.WAVELET_TAPS[name])
    for i, y in curves.items():
        have = got[got.lake_id == i].sort_values("k").curve.to_numpy()
        as_is = level is not None and 2 * len(y) < taps - 1
        assert np.allclose(have, y if as_is else kernels.wavelet_denoise(y, name, level, threshold)), (i, len(y))
