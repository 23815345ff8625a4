"""Regular grids per series (L1, L2) and evaluation back at observations.

A slot is one grid step. The only thing the grid needs from the observations
is the first and last one of each slot, a map-side-combined aggregate, so a
series of any size becomes at most one row per grid step before any ordered
work starts; everything after is bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..config import DAY
from ..functions import groups

KEY = "lake_id"


def grid_origin(base: DataFrame, step: float = DAY, midnight: bool = False, time="time") -> DataFrame:
    """Per series: origin and last grid index. The origin is the first time,
    or (Hampel) its midnight with the grid ending at the last midnight."""
    t = base.groupBy(KEY).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    if midnight:
        snap = lambda c: F.floor(F.col(c) / F.lit(DAY)) * F.lit(DAY)
        t = t.withColumn("t0", snap("t0")).withColumn("t1", snap("t1"))
    return t.withColumn("k_last", F.floor((F.col("t1") - F.col("t0")) / F.lit(float(step))).cast("long"))


def slot_ends(base: DataFrame, origin: DataFrame, step: float = DAY, time="time", value="wse") -> DataFrame:
    """First and last observation of every occupied slot."""
    j = base.join(origin.select(KEY, "t0"), KEY)
    k = F.floor((F.col(time) - F.col("t0")) / F.lit(float(step))).cast("long")
    s = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    return j.groupBy(KEY, k.alias("k")).agg(F.min(s).alias("first"), F.max(s).alias("last"))


def _slots(ends: DataFrame, origin: DataFrame) -> DataFrame:
    """Every slot of the grid with its own ends, the last one ``before`` and the first one ``after`` it.

    Only occupied slots are ordered; each writes out itself and the empty slots up to the next one, the first also
    those ahead of it (a midnight grid). Slots past the last grid point still feed ``after``.
    """
    along = W.partitionBy(KEY).orderBy("k")
    e = ends.filter("k >= 0").withColumns({"before": F.lag("last").over(along), "after": F.lead("first").over(along), "__to": F.lead("k").over(along)})
    e = e.join(origin.select(KEY, "t0", "k_last"), KEY).withColumn("__k", F.col("k"))
    start = F.when(F.col("before").isNull(), F.lit(0).cast("long")).otherwise(F.col("__k"))
    stop = F.least(F.coalesce(F.col("__to") - 1, F.col("k_last")), F.col("k_last"))
    e = e.filter(start <= stop).withColumn("k", F.explode(F.sequence(start, stop)))
    own, ahead = F.col("k") == F.col("__k"), F.col("k") < F.col("__k")
    return e.select(
        KEY, "k", "k_last", "t0", F.when(own | ahead, F.col("before")).otherwise(F.col("last")).alias("before"),
        F.when(ahead, F.col("first")).otherwise(F.col("after")).alias("after"),
        F.when(own, F.col("first")).alias("first"), F.when(own, F.col("last")).alias("last"))


def regular_grid(base: DataFrame, step: float = DAY, midnight=False, time="time", value="wse",
                 origin: DataFrame | None = None) -> DataFrame:
    """L1: linear interpolation on the grid, flat beyond the ends.

    Columns: lake_id, k, g (grid time), y, and the slot's neighbours
    (before / first / last / after) used by the gap screen.
    """
    o = grid_origin(base, step, midnight, time) if origin is None else origin
    j = _slots(slot_ends(base, o, step, time, value), o)
    j = j.withColumn("g", F.col("t0") + F.col("k") * F.lit(float(step))).withColumn("__n", F.coalesce("first", "after"))
    a, b = F.col("before"), F.col("__n")
    slope = (b["v"] - a["v"]) / (b["t"] - a["t"])
    y = (
        F.when(b["t"] == F.col("g"), b["v"])
        .when(a.isNull(), b["v"])
        .when(b.isNull(), a["v"])
        .otherwise(slope * (F.col("g") - a["t"]) + a["v"])
    )
    return j.withColumn("y", y).drop("__n", "t0")


def pchip_slope(h0, h1, d0, d1):
    """Interior slope: weighted harmonic mean, zero at a turn."""
    w1, w2 = F.lit(2.0) * h1 + h0, h1 + F.lit(2.0) * h0
    mean = (w1 + w2) / (F.try_divide(w1, d0) + F.try_divide(w2, d1))
    return F.when((d0 * d1) <= 0, F.lit(0.0)).otherwise(mean)


def pchip_end_slope(h0, h1, d0, d1):
    """One-sided three-point slope at an end, kept monotone."""
    s = ((F.lit(2.0) * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(F.signum(s) != F.signum(d0), F.lit(0.0))
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > F.abs(F.lit(3.0) * d0)), F.lit(3.0) * d0)
        .otherwise(s)
    )


def with_neighbours(df: DataFrame, time: str, cols: list[str], reach: int, step: float = DAY) -> DataFrame:
    """Structs prev1..prevN / next1..nextN of ``cols`` per row in time order.

    Interior rows look inside their (series, day) partition; only the first and
    last ``reach`` rows of a day take part in the series-wide window, and that
    table is bounded by the calendar.
    """
    rows = df.withColumn("__s", F.floor(F.col(time) / F.lit(float(step))).cast("long"))
    inner = W.partitionBy(KEY, "__s").orderBy(time)
    item = F.struct(*cols)
    rows = rows.withColumn("__up", F.row_number().over(inner)).withColumn(
        "__down", F.row_number().over(W.partitionBy(KEY, "__s").orderBy(F.col(time).desc()))
    )
    outer = W.partitionBy(KEY).orderBy(time)
    names = []
    edge = rows.filter((F.col("__up") <= reach) | (F.col("__down") <= reach))
    pick = [F.col(KEY).alias("__k"), F.col("__s").alias("__es"), F.col(time).alias("__t")]
    for i in range(1, reach + 1):
        for name, fn in ((f"prev{i}", F.lag), (f"next{i}", F.lead)):
            rows = rows.withColumn(name, fn(item, i).over(inner))
            pick.append(fn(item, i).over(outer).alias(f"__e_{name}"))
            names.append(name)
    edge = edge.select(*pick)
    same = (F.col(KEY) == F.col("__k")) & (F.col("__s") == F.col("__es")) & (F.col(time) == F.col("__t"))
    j = rows.join(edge, same, "left").drop("__k", "__es", "__t")
    for n in names:
        j = j.withColumn(n, F.coalesce(n, f"__e_{n}"))
    return j.drop("__s", "__up", "__down", *[f"__e_{n}" for n in names])


def with_pchip_slopes(df: DataFrame, time: str, value: str) -> DataFrame:
    """Shape-preserving cubic slopes at the knots; column ``slope``."""
    n = with_neighbours(df, time, [time, value], 2)

    def h_d(a, b):
        h = b[time] - a[time]
        return h, (b[value] - a[value]) / h

    me = {time: F.col(time), value: F.col(value)}
    p1, p2, n1, n2 = (F.col(c) for c in ("prev1", "prev2", "next1", "next2"))
    hp, dp = h_d(p1, me)
    hn, dn = h_d(me, n1)
    hpp, dpp = h_d(p2, p1)
    hnn, dnn = h_d(n1, n2)
    slope = (
        F.when(p1.isNull() & n1.isNull(), F.lit(0.0))
        .when(p1.isNull() & n2.isNull(), dn)
        .when(n1.isNull() & p2.isNull(), dp)
        .when(p1.isNull(), pchip_end_slope(hn, hnn, dn, dnn))
        .when(n1.isNull(), pchip_end_slope(hp, hpp, dp, dpp))
        .otherwise(pchip_slope(hp, hn, dp, dn))
    )
    return n.withColumn("slope", slope).drop("prev1", "prev2", "next1", "next2")


def hermite(x, x0, x1, y0, y1, s0, s1):
    h = x1 - x0
    u = (x - x0) / h
    return (
        y0 * (1 + 2 * u) * (1 - u) * (1 - u)
        + s0 * h * u * (1 - u) * (1 - u)
        + y1 * u * u * (3 - 2 * u)
        + s1 * h * u * u * (u - 1)
    )


def pchip_grid(base: DataFrame, step: float = DAY, midnight=False, time="time", value="wse") -> DataFrame:
    """L2: shape-preserving cubic interpolation on the regular grid. A midnight grid starts before
    the first observation, where the first cubic goes on (one observation: its value)."""
    o = grid_origin(base, step, midnight, time)
    b = with_pchip_slopes(base.select(KEY, time, value), time, value).join(o.select(KEY, "t0"), KEY)
    k = F.floor((F.col(time) - F.col("t0")) / F.lit(float(step))).cast("long")
    s = F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.col("slope").alias("s"))
    ends = b.groupBy(KEY, k.alias("k")).agg(F.min(s).alias("first"), F.max(s).alias("last"))
    j = _slots(ends, o).select(KEY, "k", "k_last", "t0", F.col("before").alias("a"), F.coalesce("first", "after").alias("b"))
    g = F.col("t0") + F.col("k") * F.lit(float(step))
    a, c = F.col("a"), F.col("b")
    y = F.when(c["t"] == F.col("g"), c["v"]).otherwise(
        hermite(F.col("g"), a["t"], c["t"], a["v"], c["v"], a["s"], c["s"])
    )
    if midnight:
        first = b.groupBy(KEY).agg(F.min(s).alias("p"))
        second = b.join(first, KEY).filter(F.col(time) > F.col("p.t")).groupBy(KEY).agg(F.min(s).alias("n"))
        j = j.join(first, KEY).join(second, KEY, "left")
        p, n = F.col("p"), F.col("n")
        ahead = hermite(F.col("g"), p["t"], n["t"], p["v"], n["v"], p["s"], n["s"])
        y = F.when(F.col("g") < p["t"], F.coalesce(ahead, p["v"])).otherwise(y)
    return j.withColumn("g", g).withColumn("y", y).select(KEY, "k", "k_last", "g", "y")


def packed(grid: DataFrame, values: list[str], once: list[str] = ()) -> DataFrame:
    """One row per series with an array of each value in the order of its slots, and the columns that are the same in
    all of them. A grid is dealt by series already, so nothing is shuffled; an array that is not read is not built."""
    def line(c):
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col("k"), F.col(c).alias("v")))), lambda s: s["v"])

    return grid.groupBy(KEY).agg(*[F.first(c).alias(c) for c in once], *[line(c).alias(c) for c in values])


def unpacked(series: DataFrame, fn, value="y", out="curve", partitions: int | None = None) -> DataFrame:
    """Grid rows of ``packed`` series with the curve that ``fn`` gives for a list of NumPy arrays."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def curves(lines: pd.Series) -> pd.Series:
        return pd.Series(fn([np.array(y, dtype=float) for y in lines]), index=lines.index, dtype=object)

    rows = series.withColumn("__c", curves(value))
    # Spark forgets behind Python how rows are dealt; arrays are dealt again here, in place of their slots later
    rows = rows.repartition(KEY) if partitions is None else rows.repartition(partitions, KEY)
    rows = rows.select(KEY, "k_last", "g", value, F.posexplode("__c").alias("k", "__v"))
    return rows.select(KEY, F.col("k").cast("long").alias("k"), "k_last", F.get("g", F.col("k")).alias("g"),
                       F.get(value, F.col("k")).alias(value), F.col("__v").alias(out))


def at_times(rows: DataFrame, curve: DataFrame, origin: DataFrame, value="curve", step: float = DAY,
             time="time", out="smooth", carry: list[str] = ()) -> DataFrame:
    """Linear evaluation of a grid curve at row times, flat beyond the ends; of several curves with lists of names.

    ``curve`` has every slot of its series once. Where one task may take all rows of each series (counted first), they
    meet their curve packed to one row, so that no slot is shuffled. Otherwise the join key is (series, slot): a large
    series spreads over its slots.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    r = rows.join(origin.select(KEY, "t0", "k_last"), KEY, "left")
    pos = (F.col(time) - F.col("t0")) / F.lit(float(step))
    k = F.least(F.greatest(F.floor(pos).cast("long"), F.lit(0)), F.col("k_last"))
    r = r.withColumn("k", k)
    near, behind = [f"__y{i}" for i in range(len(values))], [f"__z{i}" for i in range(len(values))]
    if groups.largest_group(rows, [KEY]) <= groups.GATHERED_ROWS:
        lines = [f"__l{i}" for i in range(len(values) + len(carry))]
        c = curve.select(KEY, "k", *[F.col(c).alias(n) for c, n in zip([*values, *carry], lines)])
        j = r.join(packed(c, lines), KEY, "left")
        at = lambda n, i: F.get(n, (F.col("k") + i).cast("int"))
        j = j.select(*r.columns, *[at(n, 0).alias(c) for n, c in zip(lines, [*near, *carry])], *[at(n, 1).alias(c) for n, c in zip(lines, behind)])
    else:
        along = W.partitionBy(KEY).orderBy("k")
        c = curve.select(KEY, "k", *[F.col(v).alias(n) for v, n in zip(values, near)],
                         *[F.lead(v).over(along).alias(n) for v, n in zip(values, behind)], *carry)
        j = r.join(c, [KEY, "k"], "left")
    g = F.col("t0") + F.col("k") * F.lit(float(step))
    frac = (F.col(time) - g) / F.lit(float(step))
    for name, a, b in zip(outs, map(F.col, near), map(F.col, behind)):
        j = j.withColumn(name, F.when((frac <= 0) | b.isNull(), a).otherwise((b - a) * frac + a))
    return j.drop(*near, *behind, "k", "t0", "k_last")


def pchip_at_times(rows: DataFrame, curve: DataFrame, origin: DataFrame, value="curve", step: float = DAY,
                   time="time", out="smooth") -> DataFrame:
    """Shape-preserving evaluation of a grid curve at row times; the end
    polynomials extend beyond the grid."""
    w = W.partitionBy(KEY).orderBy("k")
    h = F.lit(float(step))
    c = curve.select(KEY, "k", F.col(value).alias("v"))
    lagv = lambda i: F.lag("v", i).over(w)
    leadv = lambda i: F.lead("v", i).over(w)
    c = c.select(KEY, "k", "v", lagv(1).alias("p1"), lagv(2).alias("p2"), leadv(1).alias("n1"), leadv(2).alias("n2"))
    dp, dn = (F.col("v") - F.col("p1")) / h, (F.col("n1") - F.col("v")) / h
    dpp, dnn = (F.col("p1") - F.col("p2")) / h, (F.col("n2") - F.col("n1")) / h
    slope = (
        F.when(F.col("p1").isNull() & F.col("n1").isNull(), F.lit(0.0))
        .when(F.col("p1").isNull() & F.col("n2").isNull(), dn)
        .when(F.col("n1").isNull() & F.col("p2").isNull(), dp)
        .when(F.col("p1").isNull(), pchip_end_slope(h, h, dn, dnn))
        .when(F.col("n1").isNull(), pchip_end_slope(h, h, dp, dpp))
        .otherwise(pchip_slope(h, h, dp, dn))
    )
    c = c.withColumn("s", slope)
    c = c.select(KEY, "k", "v", "s", F.lead("v").over(w).alias("v1"), F.lead("s").over(w).alias("s1"))
    r = rows.join(origin.select(KEY, "t0", "k_last"), KEY, "left")
    pos = (F.col(time) - F.col("t0")) / h
    k = F.least(F.greatest(F.floor(pos).cast("long"), F.lit(0)), F.greatest(F.col("k_last") - 1, F.lit(0)))
    j = r.withColumn("k", k).join(c, [KEY, "k"], "left")
    g = F.col("t0") + F.col("k") * h
    y = F.when(F.col("v1").isNull(), F.col("v")).otherwise(
        hermite(F.col(time), g, g + h, F.col("v"), F.col("v1"), F.col("s"), F.col("s1"))
    )
    return j.withColumn(out, y).drop("k", "t0", "k_last", "v", "s", "v1", "s1")
