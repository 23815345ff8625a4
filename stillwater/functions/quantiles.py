"""Exact linear-interpolated quantiles per group in bounded memory.

Where no group has over ``SKETCH_ACCURACY / 5`` rows (counted first), ``percentiles`` gathers each group, which is
exact and moves every row once. If one has more, all groups take the form that never gathers one: a mergeable sketch brackets each wanted rank. Values outside all brackets are only counted,
by how many brackets lie below them; values inside collapse to (value, count). What is
ranked per group is therefore about ``4 / SKETCH_ACCURACY`` of its rows, or all of a group
of fewer than ``2 * SKETCH_ACCURACY`` rows, whose brackets are its extremes. A rank outside
its bracket raises instead of giving a wrong value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .groups import largest_group

SKETCH_ACCURACY = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on keys where NULL matches NULL; keys come from the left."""
    tmp = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(tmp, cond, how).drop(*[f"__r_{k}" for k in keys])


def between_ranks(s: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array."""
    pos = F.lit(float(q)) * (F.size(s) - 1)
    a, b = F.get(s, F.floor(pos).cast("int")), F.get(s, F.ceil(pos).cast("int"))
    return F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b)


def percentiles(value: Column | str, probs: list[float]) -> Column:
    """Aggregate with the values of ``F.percentile`` as an array, for groups that one task may gather: the values are
    sorted once as plain doubles, where ``F.percentile`` counts each of them in a map of objects."""
    ordered = F.sort_array(F.collect_list((F.col(value) if isinstance(value, str) else value).cast("double")))
    # an array of one, so that the values are sorted once for all ranks
    return F.get(F.transform(F.array(ordered), lambda s: F.array(*[between_ranks(s, q) for q in probs])), F.lit(0))


def gathered(largest: int) -> bool:
    """Are groups of at most ``largest`` rows so small that one task may gather each?"""
    return largest <= SKETCH_ACCURACY // 5


def _gathered(df: DataFrame, keys: list[str], largest: int | None) -> bool:
    """``gathered`` for groups that are counted unless the caller knows a bound."""
    return gathered(largest_group(df, keys) if largest is None else largest)


def _brackets(df, keys, v, probs, aggs):
    """Per group: row count, extra aggregates and the bracket of every rank."""
    eps = 2.0 / SKETCH_ACCURACY
    edges = [x for q in probs for x in (max(0.0, q - eps), min(1.0, q + eps))]
    base = df.groupBy(*keys).agg(
        F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"),
        F.percentile_approx(v, F.array(*[F.lit(x) for x in edges]), F.lit(SKETCH_ACCURACY)).alias("__e"), *aggs,
    )
    whole = F.col("__n") * F.lit(eps) < 4  # too few rows for a bracket wider than the sketch's error
    ends = {}
    for i, q in enumerate(probs):
        ends[f"__lo{i}"] = F.when(whole | F.lit(q - eps <= 0), F.col("__min")).otherwise(F.col("__e")[2 * i])
        ends[f"__hi{i}"] = F.when(whole | F.lit(q + eps >= 1), F.col("__max")).otherwise(F.col("__e")[2 * i + 1])
    return base.withColumns(ends).drop("__min", "__max", "__e")


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str], aggs: list[Column] = (),
    largest: int | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys`` (NULL values are skipped, NULL keys are a group).

    Extra aggregates may be computed alongside. Without keys there is one row. ``largest`` is a known bound on the
    rows of a group; without one they are counted, so ``df`` had better be a written table.
    """
    if any(not 0 <= q <= 1 for q in probs):
        raise ValueError("quantiles must be between 0 and 1")
    if not keys:
        one = grouped_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, names, aggs, largest)
        return one.drop("__all")
    if _gathered(df, keys, largest):
        got = df.groupBy(*keys).agg(percentiles(value, probs).alias("__q"), *aggs)
        plain = [c for c in got.columns if c not in {*keys, "__q"}]
        return got.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)], *plain)
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    probs, names_ = [probs[i] for i in order], [names[i] for i in order]
    # one struct as the key: it matches NULL with NULL and one exchange serves the join and all that follows
    key = F.struct(*keys).alias("__k")
    base = _brackets(df.withColumn("__k", key), ["__k"], F.col(value), probs, list(aggs))
    edges = [f"__{e}{i}" for i in range(len(probs)) for e in ("lo", "hi")]
    carried = [c for c in base.columns if c not in {"__k", *edges}]  # plain columns: those can be hashed
    v = F.col("__v")
    j = df.select(key, F.col(value).alias("__v")).join(base.hint("shuffle_hash"), "__k")
    lo, hi = ([F.col(f"__{e}{i}") for i in range(len(probs))] for e in ("lo", "hi"))
    passed = sum([(h < v).cast("int") for h in hi], F.lit(0))
    inside = reduce(lambda a, b: a | b, [(x <= v) & (v <= h) for x, h in zip(lo, hi)])
    # values of a class that lie outside come before those inside: a NULL sorts first
    counted = j.groupBy("__k", F.when(v.isNotNull(), passed).alias("__c"), F.when(inside, v).alias("__v")).agg(
        F.count(v).alias("__w"), *[F.first(c).alias(c) for c in carried])
    upto = W.partitionBy("__k").orderBy("__c", "__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("__last", F.sum("__w").over(upto) - 1)
    first, picks = F.col("__last") - F.col("__w") + 1, []
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        for end, name in ((F.floor(pos), f"__a{i}"), (F.ceil(pos), f"__b{i}")):
            picks.append(F.max(F.when((first <= end) & (end <= F.col("__last")), v)).alias(name))
    got = ranked.groupBy("__k").agg(*[F.first(c).alias(c) for c in carried], *picks)
    out = {}
    for i, (q, name) in enumerate(zip(probs, names_)):
        pos, a, b = F.lit(float(q)) * (F.col("__n") - 1), F.col(f"__a{i}"), F.col(f"__b{i}")
        lost = F.raise_error(F.lit("quantile rank left its bracket")).cast("double")
        mixed = F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b)
        out[name] = F.when(F.col("__n") == 0, None).when(a.isNull() | b.isNull(), lost).otherwise(mixed.cast("double"))
    return got.select(*[F.col(f"__k.{k}").alias(k) for k in keys], *[out[n].alias(n) for n in names], *[c for c in carried if c != "__n"])


def grouped_medians(df: DataFrame, keys: list[str], values: dict[str, Column], aggs=()) -> DataFrame:
    """Exact medians of several expressions per group, each a group of its own."""
    if _gathered(df, keys, None):
        return df.groupBy(*keys).agg(*aggs, *[percentiles(c, [0.5])[0].alias(n) for n, c in values.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("__name"), c.cast("double").alias("__value")) for n, c in values.items()])
    long = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    med = grouped_quantiles(long, keys + ["__name"], "__value", [0.5], ["__m"], largest=SKETCH_ACCURACY)
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("__m"))).alias(n) for n in values])
    return null_safe_join(df.groupBy(*keys).agg(*aggs), wide, keys, "left") if aggs else wide
