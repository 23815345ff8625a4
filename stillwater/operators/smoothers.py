"""Low-pass curves.

Savitzky-Golay, running median and the smoothing cubic are Column expressions;
Hampel runs a small NumPy helper on the series' regular grid (bounded by the
calendar); LOWESS is in ``lowess``, the wavelet bands in ``wavelets``, the local
level in ``kalman``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..config import DAY
from ..session import cut
from . import grid as G, kalman as kalman_scan, kernels, lowess as L, wavelets

KEY = "lake_id"
HOUR = 3600.0


# ---------------------------------------------------------------- native
def _effective_half(n, window, polyorder, compat):
    """Half-width after the short-grid rule; NULL where no window fits."""
    largest = F.floor(n / 2).cast("int") * 2 + 1
    if not compat:  # largest odd not above n
        largest = F.floor((n - 1) / 2).cast("int") * 2 + 1
    wl = F.when(F.lit(window) >= n, largest).otherwise(F.lit(window))
    least = polyorder + 2 if polyorder % 2 else polyorder + 3
    wl = F.when(wl <= polyorder, F.lit(least)).otherwise(wl)
    return F.when(wl <= n, ((wl - 1) / 2).cast("int"))


def savgol(grid: DataFrame, window: int = 21, polyorder: int = 3, value="y", out="curve", compat=False) -> DataFrame:
    """L3: least-squares polynomial smoothing on the grid.

    Interior points use the closed-form symmetric weights, the first and last
    half-window the polynomial fitted to the end window, expanded in discrete
    orthogonal polynomials whose norms have closed forms in the half-width.
    """
    if polyorder not in (2, 3):
        raise ValueError("polyorder must be 2 or 3")
    if window % 2 == 0:
        raise ValueError("window must be odd")
    series = W.partitionBy(KEY)
    reach = (window - 1) // 2
    ordered = series.orderBy("k")
    k, y = F.col("k").cast("double"), F.col("__y")
    g = grid.withColumn("__n", (F.col("k_last") + 1).cast("double"))
    g = g.withColumns(
        {
            "__h": _effective_half(F.col("__n"), window, polyorder, compat).cast("double"),
            "__ref": F.avg(value).over(series),
        }
    )
    h = F.col("__h")
    # norms of the discrete orthogonal polynomials on -h..h
    g = g.withColumns(
        {
            "__y": F.col(value) - F.col("__ref"),
            "__s2": h * (h + 1) * (2 * h + 1) / 3,
            "__c2": h * (h + 1) / 3,
            "__c3": (3 * h * h + 3 * h - 1) / 5,
            "__s6": h * (h + 1) * (2 * h + 1) * (3 * h**4 + 6 * h**3 - 3 * h + 1) / 21,
        }
    )
    s2, c2, c3 = F.col("__s2"), F.col("__c2"), F.col("__c3")
    g = g.withColumns(
        {"__q0": 2 * h + 1, "__q1": s2, "__q2": s2 * c3 - c2 * s2, "__q3": F.col("__s6") - c3 * c3 * s2}
    )
    n = F.col("__n")
    sums = {}

    def basis(j):
        return [F.lit(1.0), j, j * j - c2, j * j * j - c3 * j][: polyorder + 1]

    at_head, at_tail = k - h, k - (n - 1 - h)
    for m, (ph, pt) in enumerate(zip(basis(at_head), basis(at_tail))):
        q = F.col(f"__q{m}")
        sums[f"__f{m}"] = F.sum(F.when(k <= 2 * h, ph * y)).over(series) / q
        sums[f"__l{m}"] = F.sum(F.when(k >= n - 1 - 2 * h, pt * y)).over(series) / q
    g = g.withColumns(sums)
    # interior weights (a - b j^2), j the offset from the centre
    r = float(reach)
    den = (2 * r - 1) * (2 * r + 1) * (2 * r + 3)
    a, b = 3 * (3 * r * r + 3 * r - 1) / den, 15 / den
    inner = F.lit(a) * y
    for j in range(1, reach + 1):
        inner = inner + F.lit(a - b * j * j) * (F.lag("__y", j).over(ordered) + F.lead("__y", j).over(ordered))
    g = g.withColumn("__mid", inner)
    poly = lambda prefix, j: sum((p * F.col(f"{prefix}{m}") for m, p in enumerate(basis(j))), F.lit(0.0))
    # short grids have at most two interior points, both centres of an end window
    res = (
        F.when(h.isNull(), None)
        .when((k < h) | ((h < reach) & (k == h)), poly("__f", at_head))
        .when((k > n - 1 - h) | (h < reach), poly("__l", at_tail))
        .otherwise(F.col("__mid"))
    )
    return g.withColumn(out, res + F.col("__ref")).select(*grid.columns, out)


def running_median(grid: DataFrame, window: int = 21, value="y", out="curve") -> DataFrame:
    """L4: centred median; positions outside the grid count as zero."""
    window += 1 - window % 2
    reach = (window - 1) // 2
    ordered = W.partitionBy(KEY).orderBy("k")
    n = F.col("k_last") + 1
    half = F.when(F.lit(window) >= n, F.floor(n / 2).cast("int")).otherwise(F.lit(reach))
    g = grid.withColumn("__h", half)
    cells = [F.col(value)]
    for j in range(1, reach + 1):
        for fn in (F.lag, F.lead):
            cells.append(F.when(F.lit(j) <= F.col("__h"), fn(value, j, 0.0).over(ordered)))
    g = g.withColumn("__w", F.array(*cells))
    return g.withColumn(out, F.get(F.array_sort(F.array_compact("__w")), F.col("__h"))).drop("__h", "__w")


def spline(base: DataFrame, rows: DataFrame, smoothing: float = 1e6, time="time", value="wse", out="smooth") -> DataFrame:
    """Smoothing cubic. While the least-squares cubic leaves a residual sum
    of squares within ``smoothing`` it is the smoothing spline (no knots are
    needed), and it follows from eleven sums per series. A series beyond that
    gets a NULL curve and ``spline_ok`` = false."""
    span = base.groupBy(KEY).agg(F.min(time).alias("__a"), F.max(time).alias("__b"), F.count("*").alias("__m"))
    x = F.try_divide(2 * (F.col(time) - F.col("__a")), F.col("__b") - F.col("__a")) - 1
    sums = [F.sum(F.pow(x, F.lit(float(p)))).alias(f"x{p}") for p in range(7)]
    sums += [F.sum(F.pow(x, F.lit(float(p))) * F.col(value)).alias(f"y{p}") for p in range(4)]
    mom = base.join(span, KEY).groupBy(KEY, "__a", "__b", "__m").agg(*sums)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(m: pd.DataFrame) -> pd.Series:
        v = m.to_numpy(dtype=float)
        gram = np.stack([v[:, i:i + 4] for i in range(4)], axis=1)
        sol = []
        for a, b in zip(gram, v[:, 7:]):
            good = np.isfinite(a).all() and np.linalg.matrix_rank(a) == 4
            sol.append(np.linalg.solve(a, b).tolist() if good else None)
        return pd.Series(sol)

    coef = mom.select(
        KEY, "__a", "__b",
        F.when(F.col("__m") > 3, solve(F.struct(*[f"x{p}" for p in range(7)], *[f"y{p}" for p in range(4)]))).alias("__c"),
    )

    def poly(u):
        c = F.col("__c")
        return c[0] + u * (c[1] + u * (c[2] + u * c[3]))

    rss = base.join(coef, KEY).groupBy(KEY).agg(F.sum(F.pow(F.col(value) - poly(x), F.lit(2.0))).alias("__rss"))
    j = rows.join(coef, KEY, "left").join(rss, KEY, "left")
    ok = F.coalesce(F.col("__rss") <= F.lit(float(smoothing)), F.lit(False))
    return (
        j.withColumn("spline_ok", ok)
        .withColumn(out, F.when(F.col("spline_ok"), poly(x)))
        .drop("__a", "__b", "__c", "__rss")
    )


# ------------------------------------------------------- helpers on the grid
def _on_grid(grid: DataFrame, fn, value="y", out="curve") -> DataFrame:
    """Run a NumPy helper per series on its grid, bounded by the calendar length of the series divided by the step."""
    return G.unpacked(G.packed(grid, ["g", value], ["k_last"]), lambda lines: [fn(y) for y in lines], value, out)


def wavelet(grid: DataFrame, name="db4", level=None, threshold=None, hourly=False, value="y", out="curve"):
    """L6."""
    return wavelets.denoise(grid, name, level, threshold, 8 if hourly else 5, value, out)


def hampel(grid: DataFrame, window=21, value="y", out="curve"):
    """Use a midnight grid."""
    return _on_grid(grid, lambda y: kernels.hampel(y, window), value, out)


def kalman(grid: DataFrame, n_iter=10, value="y", out="curve"):
    """L9."""
    return kalman_scan.smooth(grid, n_iter, value, out)


# ----------------------------------------------------------------- LOWESS
def lowess_fractions(minfrac, maxfrac, step):
    return np.linspace(minfrac, maxfrac, int(np.ceil((maxfrac - minfrac) / step) + 1))


def workflow_minfrac(n, large_std_share):
    """Span floor of round 1 from series length and share of large wse_std."""
    if large_std_share >= 0.25 or n <= 50:
        return 0.15
    return 0.05 if n < 120 else 0.03


def lowess(
    rows: DataFrame, base_flag="is_base", eval_flag="is_eval", minfrac=0.1, maxfrac=0.5, frac_step=0.1,
    iterations=(0, 1), time="time", value="wse", minfrac_col: str | None = None,
) -> DataFrame:
    """Robust local lines over the parameter sweep. Adds ``bottom``, ``top``
    and ``residual`` (signed, smallest size over the sweep) to eval rows; NULL for
    a series with fewer than three base rows and for a curve without weight there.
    """
    used = rows.filter(F.col(base_flag) | F.col(eval_flag))
    low = F.col(minfrac_col) if minfrac_col else F.lit(float(minfrac))
    got = L.sweep(used, base_flag, eval_flag, time, value, low, float(maxfrac), float(frac_step), iterations)
    return rows.filter(F.col(eval_flag)).join(got, [KEY, "index_col"], "left")


# ------------------------------------------------------------- sweep
def grid_of(base: DataFrame, kind: str, step=DAY, interpolation="linear"):
    """(origin, grid) that the curves of one kind need."""
    midnight = kind == "hampel"
    if interpolation not in ("linear", "pchip"):
        raise ValueError("interpolation must be linear or pchip")
    origin = G.grid_origin(base, step, midnight)
    return origin, G.regular_grid(base, step, midnight, origin=origin) if interpolation == "linear" else G.pchip_grid(base, step, midnight)


def curve_on(grid: DataFrame, kind: str, step=DAY, **params) -> DataFrame:
    """The curve of one parameter set on a grid of ``grid_of``."""
    per_day = int(DAY // step)
    if kind in ("savgol", "median", "hampel") and per_day > 1:
        params["window"] = params.get("window", 21) * per_day + 1 - (params.get("window", 21) * per_day) % 2
    if kind == "wavelet":
        params["hourly"] = per_day > 1
    if kind == "kalman":
        params.setdefault("n_iter", 20 if per_day > 1 else 10)
    fn = {"savgol": savgol, "median": running_median, "hampel": hampel, "wavelet": wavelet, "kalman": kalman}[kind]
    return fn(grid, **params)


def grid_curve(base: DataFrame, kind: str, step=DAY, interpolation="linear", **params):
    """(origin, curve) of one grid smoother with one parameter set."""
    origin, grid = grid_of(base, kind, step, interpolation)
    return origin, curve_on(grid, kind, step, **params)


DEFAULT_SWEEPS = {
    "savgol": [{"window": w, "polyorder": p} for p in (2, 3) for w in (11, 21, 31)],
    "median": [{"window": w} for w in (11, 21, 31)],
    "hampel": [{"window": w} for w in (11, 21, 31)],
    "wavelet": [{"name": n} for n in ("db4", "sym2", "coif1")],
    "kalman": [{}],
}


def sweep(base: DataFrame, rows: DataFrame, kind: str, params: list[dict] | None = None, step=DAY,
          interpolation="linear") -> DataFrame:
    """Rows with ``curves`` (one value per parameter set) and the envelope
    ``bottom`` / ``top``."""
    params = DEFAULT_SWEEPS[kind] if params is None else params
    out = rows
    origin, grid = grid_of(base, kind, step, interpolation)
    names = [f"__curve{i}" for i in range(len(params))]
    if interpolation == "pchip":
        grid = cut(grid)  # one grid under all parameter sets
        for p, name in zip(params, names):
            out = G.pchip_at_times(out, curve_on(grid, kind, step, **p), origin, step=step, out=name)
    elif kind in ("savgol", "median"):  # windows over the rows of a series, which pass through all of them
        curves = grid.select(KEY, "k", "k_last", "g", "y")
        for p, name in zip(params, names):
            curves = curve_on(curves, kind, step, out=name, **p)
        out = G.at_times(out, curves, origin, names, step, out=names)
    else:
        grid = cut(grid.select(KEY, "k", "k_last", "g", "y"))
        for p, name in zip(params, names):
            out = G.at_times(out, curve_on(grid, kind, step, **p), origin, step=step, out=name)
    out = out.withColumn("curves", F.array(*names))
    return out.withColumn("bottom", F.array_min("curves")).withColumn("top", F.array_max("curves")).drop(*names)
