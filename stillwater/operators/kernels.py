"""NumPy helpers for the sequential smoothers.

Each works on one short array: a grid bounded by the calendar, or (LOWESS) a
series below the heavy-row limit. Partitioning is done by the callers.
"""

from __future__ import annotations

import math

import numpy as np

# Orthogonal wavelet reconstruction low-pass taps.
WAVELET_TAPS = {
    "db4": [
        0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
        -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
    ],
    "sym2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "coif1": [
        -0.0727326195128539, 0.3378976624578092, 0.8525720202122554, 0.38486484686420286,
        -0.0727326195128539, -0.01565572813546454,
    ],
}


def _filters(name):
    lo = np.asarray(WAVELET_TAPS[name])
    sign = np.where(np.arange(lo.size) % 2 == 0, -1.0, 1.0)
    dec_hi = sign * lo
    return lo[::-1], dec_hi, lo, dec_hi[::-1]


def _analyse(x, dec_lo, dec_hi):
    pad = dec_lo.size - 1
    ext = np.pad(x, pad, mode="symmetric")
    return np.convolve(ext, dec_lo, "valid")[1::2], np.convolve(ext, dec_hi, "valid")[1::2]


def _synthesise(a, d, rec_lo, rec_hi):
    up_a, up_d = np.zeros(2 * a.size), np.zeros(2 * d.size)
    up_a[::2], up_d[::2] = a, d
    full = np.convolve(up_a, rec_lo) + np.convolve(up_d, rec_hi)
    start = rec_lo.size - 2
    return full[start:start + 2 * a.size - rec_lo.size + 2]


def wavelet_denoise(y, name="db4", level=None, threshold=None, max_level=5):
    """Soft thresholding of the detail bands with the universal threshold."""
    dec_lo, dec_hi, rec_lo, rec_hi = _filters(name)
    n = y.size
    top = int(math.floor(math.log2(n / (dec_lo.size - 1)))) if n >= dec_lo.size - 1 else 0
    top = max(top, 0)
    steps = min(max_level, top) if level is None else level
    approx, details = y, []
    for _ in range(steps):
        approx, d = _analyse(approx, dec_lo, dec_hi)
        details.append(d)
    finest = details[0] if details else approx
    sigma = np.median(np.abs(finest)) / 0.6745
    thr = sigma * math.sqrt(2 * math.log(n)) if threshold is None else threshold
    for d in reversed(details):
        d = np.sign(d) * np.maximum(np.abs(d) - thr, 0.0)
        if approx.size == d.size + 1:
            approx = approx[:-1]
        approx = _synthesise(approx, d, rec_lo, rec_hi)
    return approx[:n]


def hampel(y, window, block=64):
    """Replace a centre beyond 3 scaled MADs by the window median; replaced
    values are seen by later windows, the ends stay.

    A block of windows is judged at once. Up to its first outlier nothing has
    changed, so those verdicts stand; the next block starts behind it.
    """
    width = window | 1
    out = np.array(y, dtype=float)
    if out.size < width:
        return out
    windows, centre, done = np.lib.stride_tricks.sliding_window_view(out, width), width // 2, 0
    while done < len(windows):
        w = windows[done:done + block]
        middle = np.median(w, axis=1)
        spread = 1.4826 * np.median(np.abs(w - middle[:, None]), axis=1)
        outlier = (spread > 0) & (np.abs(w[:, centre] - middle) > 3 * spread)
        if not outlier.any():
            done += len(w)
            continue
        first = int(outlier.argmax())
        out[done + first + centre] = middle[first]
        done += first + 1
    return out


def local_level_smooth(y, n_iter=10):
    """Random walk plus noise: RTS smoother with parameters from EM. Starts at
    unit variances and the first value; EM updates both variances and the
    initial state."""
    y = np.asarray(y, dtype=float)
    n = y.size
    q = r = p0 = 1.0
    m0 = float(y[0])

    def smooth():
        pm, pv = [0.0] * n, [0.0] * n  # predicted
        fm, fv = [0.0] * n, [0.0] * n  # filtered
        m, v = m0, p0
        for t in range(n):
            if t:
                v = v + q
            pm[t], pv[t] = m, v
            gain = v / (v + r)
            m = m + gain * (y[t] - m)
            v = v - gain * v
            fm[t], fv[t] = m, v
        sm, sv, cross = fm[:], fv[:], [0.0] * n
        for t in range(n - 2, -1, -1):
            j = fv[t] / pv[t + 1]
            sm[t] = fm[t] + j * (sm[t + 1] - pm[t + 1])
            sv[t] = fv[t] + j * j * (sv[t + 1] - pv[t + 1])
            cross[t + 1] = sv[t + 1] * j
        return np.array(sm), np.array(sv), np.array(cross)

    for _ in range(n_iter):
        sm, sv, cross = smooth()
        r = float(np.mean((y - sm) ** 2 + sv))
        if n > 1:
            q = float(np.mean((sm[1:] - sm[:-1]) ** 2 + sv[1:] + sv[:-1] - 2 * cross[1:]))
        m0, p0 = float(sm[0]), float(sv[0])
        if r <= 0 or p0 + r <= 0:
            break
    if r <= 0:
        return y.copy()
    return smooth()[0]


#: Cells of a table of series that are smoothed side by side, 8 MB each of some ten tables.
CELLS = 1 << 20


def local_level_lines(lines, n_iter=10, block=256):
    """``local_level_smooth`` of many series: a step of the recursions takes a slot of all series of a table at once,
    the longest first, so that those which have the slot lie together."""
    out, order, done = [None] * len(lines), sorted(range(len(lines)), key=lambda i: -lines[i].size), 0
    while done < len(order):
        some = order[done:done + max(1, min(block, CELLS // lines[order[done]].size))]
        for i, c in zip(some, _smooth_table([lines[i] for i in some], n_iter)):
            out[i] = c
        done += len(some)
    return out


def _smooth_table(lines, n_iter):
    size = np.array([v.size for v in lines])
    top, width = int(size[0]), len(lines)
    inside = np.arange(top)[:, None] < size
    live = inside.sum(axis=1).tolist() + [0]
    y = np.zeros((top, width))
    for i, v in enumerate(lines):
        y[:v.size, i] = v
    q, r, p0, m0 = np.ones(width), np.ones(width), np.ones(width), y[0].copy()

    def smooth():
        pm, pv, fm, fv, cross = (np.zeros((top, width)) for _ in range(5))
        m, v = m0.copy(), p0.copy()
        for t in range(top):
            a = live[t]
            mt, vt = m[:a], v[:a]
            if t:
                vt += q[:a]
            pm[t, :a], pv[t, :a] = mt, vt
            gain = vt / (vt + r[:a])
            mt += gain * (y[t, :a] - mt)
            vt -= gain * vt
            fm[t, :a], fv[t, :a] = mt, vt
        for t in range(top - 2, -1, -1):  # the filtered values become the smoothed ones
            a = live[t + 1]
            j = fv[t, :a] / pv[t + 1, :a]
            fm[t, :a] += j * (fm[t + 1, :a] - pm[t + 1, :a])
            cross[t + 1, :a] = fv[t + 1, :a] * j
            fv[t, :a] += j * j * (fv[t + 1, :a] - pv[t + 1, :a])
        return fm, fv, cross

    ended = np.zeros(width, dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(n_iter):
            sm, sv, cross = smooth()
            miss = ((y - sm) ** 2 + sv).sum(axis=0) / size
            move = np.where(inside[1:], (sm[1:] - sm[:-1]) ** 2 + sv[1:] + sv[:-1] - 2 * cross[1:], 0.0).sum(axis=0)
            r = np.where(ended, r, miss)
            q = np.where(ended | (size < 2), q, move / (size - 1))
            m0, p0 = np.where(ended, m0, sm[0]), np.where(ended, p0, sv[0])
            ended |= (r <= 0) | (p0 + r <= 0)
        sm = smooth()[0]
    return [v.copy() if flat else sm[:v.size, i] for i, (v, flat) in enumerate(zip(lines, r <= 0))]


def _local_fit(x, y, w_resid, at, k, block=512):
    """Tricube-weighted local lines through the k nearest points of each ``at``."""
    n = x.size
    mid = (x[: n - k] + x[k:]) / 2
    out = np.empty(at.size)
    for s in range(0, at.size, block):
        a = at[s:s + block]
        idx = np.searchsorted(mid, a, side="left")[:, None] + np.arange(k)
        xs, ys = x[idx], y[idx]
        radius = np.maximum(a - xs[:, 0], xs[:, -1] - a)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.abs(xs - a[:, None]) / radius[:, None]
            w = (1 - np.clip(d, 0, 1) ** 3) ** 3 * w_resid[idx]
            total = w.sum(axis=1, keepdims=True)
            w = w / total
            mx = (w * xs).sum(axis=1, keepdims=True)
            dev = (w * (xs - mx) ** 2).sum(axis=1, keepdims=True)
            line = w * (1 + (a[:, None] - mx) * (xs - mx) / np.maximum(dev, 1e-12))
            fit = (line * ys).sum(axis=1)
        fit[~(total[:, 0] > 0)] = np.nan
        out[s:s + block] = fit
    return out


def _quadratic_fallback(x, fit, at):
    """Piecewise quadratic through the fitted points, extrapolating: used where
    direct evaluation leaves gaps."""
    ok = np.isfinite(fit)
    x, fit = x[ok], fit[ok]
    x, first = np.unique(x, return_index=True)
    fit = fit[first]
    if x.size < 3:
        return np.interp(at, x, fit) if x.size else np.full(at.size, np.nan)
    c = np.clip(np.searchsorted(x, at) - 1, 0, x.size - 3)
    x0, x1, x2 = x[c], x[c + 1], x[c + 2]
    return (
        fit[c] * (at - x1) * (at - x2) / ((x0 - x1) * (x0 - x2))
        + fit[c + 1] * (at - x0) * (at - x2) / ((x1 - x0) * (x1 - x2))
        + fit[c + 2] * (at - x0) * (at - x1) / ((x2 - x0) * (x2 - x1))
    )


def lowess_curves(x, y, at, fracs, iterations):
    """One curve per (iterations, frac); the reweighted fits of a frac are shared."""
    curves = {}
    n = x.size
    for frac in fracs:
        k = min(n, max(1, int(frac * n + 1e-10)))
        weights = np.ones(n)
        fit = _local_fit(x, y, weights, x, k)
        for it in range(max(iterations) + 1):
            if it:
                size = np.abs(y - fit)
                med = np.median(size)
                size = np.where(size > 0, 1.0, 0.0) if med == 0 else size / (6 * med)
                weights = np.where(size < 1, (1 - np.minimum(size, 1) ** 2) ** 2, 0.0)
                fit = _local_fit(x, y, weights, x, k)
            if it in iterations:
                value = _local_fit(x, y, weights, at, k)
                if np.isnan(value).any():
                    value = _quadratic_fallback(x, fit, at)
                curves[(it, frac)] = value
    return np.vstack([curves[(it, f)] for it in iterations for f in fracs])


# ------------------------------------------- one bounded series, whole fixpoint
def savgol(y, window=21, polyorder=3):
    """Least-squares polynomial smoothing with end windows fitted once."""
    n = y.size
    wl = window if window < n else (n - 1) // 2 * 2 + 1
    if wl <= polyorder:
        wl = polyorder + 2 if polyorder % 2 else polyorder + 3
    if wl > n:
        return np.full(n, np.nan)
    h = wl // 2
    j = np.arange(-h, h + 1)
    basis = np.vander(j / max(h, 1), polyorder + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = np.empty(n)
    ref = y.mean()
    z = y - ref
    out[h:n - h] = np.correlate(z, fit[0], "valid")
    out[:h] = (basis @ (fit @ z[:wl]))[:h]
    out[n - h:] = (basis @ (fit @ z[n - wl:]))[h + 1:]
    return out + ref


def running_median(y, window=21):
    n = y.size
    half = (window if window < n else n // 2 * 2 + 1) // 2
    padded = np.pad(y, half)
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)


def residual_to_curve(kind, bt, by, et, ey, minfrac):
    """Curve through (bt, by) minus ey at et; signed smallest over a sweep."""
    day = 86400.0
    if kind == "lowess":
        fr = np.linspace(minfrac, 0.2, int(np.ceil((0.2 - minfrac) / 0.02) + 1))
        r = lowess_curves((bt - bt[0]) / day, by, (et - bt[0]) / day, fr, [1, 2, 3, 4]) - ey
        size = np.where(np.isnan(r), np.inf, np.abs(r))
        return r[size.argmin(axis=0), np.arange(r.shape[1])]
    if kind == "spline":
        span = bt[-1] - bt[0]
        if bt.size <= 3 or span == 0:
            return np.full(et.size, np.nan)
        p = np.polynomial.Polynomial.fit(2 * (bt - bt[0]) / span - 1, by, 3)
        if ((by - p(2 * (bt - bt[0]) / span - 1)) ** 2).sum() > 1e6:
            return np.full(et.size, np.nan)
        return p(2 * (et - bt[0]) / span - 1) - ey
    t0, t1 = (np.floor(bt[0] / day) * day, np.floor(bt[-1] / day) * day) if kind == "hampel" else (bt[0], bt[-1])
    g = t0 + np.arange(int((t1 - t0) // day) + 1) * day
    y = np.interp(g, bt, by)
    smooth = {
        "savgol": savgol, "median": running_median, "wavelet": wavelet_denoise,
        "kalman": local_level_smooth, "hampel": lambda v: hampel(v, 21),
    }[kind](y)
    return np.interp(et, g, smooth) - ey
