import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwater.functions import ranks
from stillwater.functions.quantiles import grouped_medians, grouped_quantiles
from stillwater.operators import metrics


def frame(seed=0):
    rng = np.random.default_rng(seed)
    a = pd.DataFrame({"lake_id": 1, "pass_id": rng.integers(0, 3, 600), "x": rng.normal(size=600).round(1)})
    b = pd.DataFrame({"lake_id": 2, "pass_id": rng.integers(0, 3, 20), "x": rng.normal(size=20)})
    c = pd.DataFrame({"lake_id": [3, 3], "pass_id": [0, 0], "x": [np.nan, 5.0]})
    return pd.concat([a, b, c], ignore_index=True)


@pytest.mark.parametrize("keys", [["lake_id"], ["lake_id", "pass_id"], []])
def test_quantiles_equal_numpy(spark, narrow_brackets, keys):
    pdf = frame()
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = grouped_quantiles(df, keys, "x", probs, list("abcde"), [F.count("x").alias("n")]).toPandas()
    groups = pdf.dropna().groupby(keys) if keys else [((), pdf.dropna())]
    for key, g in groups:
        row = got
        for k, v in zip(keys, key if isinstance(key, tuple) else (key,)):
            row = row[row[k] == v]
        assert len(row) == 1 and row.n.iloc[0] == len(g)
        assert np.allclose(row[list("abcde")].iloc[0], np.quantile(g.x, probs))


def test_many_copies_of_one_value(spark, narrow_brackets):
    df = spark.range(500).selectExpr("1L lake_id", "case when id < 450 then 7.0D else cast(id as double) end x")
    got = grouped_quantiles(df, ["lake_id"], "x", [0.1, 0.89, 0.95], ["a", "b", "c"]).first()
    ref = np.quantile([7.0] * 450 + list(range(450, 500)), [0.1, 0.89, 0.95])
    assert np.allclose([got.a, got.b, got.c], ref)


def test_medians_of_several_expressions(spark, narrow_brackets):
    pdf = frame(1).dropna()
    df = spark.createDataFrame(pdf)
    got = grouped_medians(df, ["lake_id"], {"m": F.col("x"), "d": F.col("x") - F.col("pass_id")}, [F.count("*").alias("n")])
    got = got.toPandas().set_index("lake_id")
    for i, g in pdf.groupby("lake_id"):
        assert np.isclose(got.m[i], g.x.median()) and np.isclose(got.d[i], (g.x - g.pass_id).median())
        assert got.n[i] == len(g)


def test_bad_probability(spark):
    with pytest.raises(ValueError):
        grouped_quantiles(spark.range(3), ["id"], "id", [1.5], ["a"])


def test_whole_groups_missing_keys_and_repeated_ranks(spark):
    pdf = frame(2)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("lake_id", F.when(F.col("lake_id") != 2, F.col("lake_id")))
    df = df.unionByName(spark.createDataFrame([(9, 0, None)], "lake_id long, pass_id long, x double"))
    got = {r.lake_id: r for r in grouped_quantiles(df, ["lake_id"], "x", [0.9, 0.5, 0.9], list("abc"), [F.count("*").alias("n")]).collect()}
    assert set(got) == {1, None, 3, 9} and got[9].a is None and got[9].n == 1
    want = np.quantile(pdf.x[pdf.lake_id == 2], [0.9, 0.5, 0.9])
    assert np.allclose([got[None].a, got[None].b, got[None].c], want) and got[3].b == 5.0


def test_running_total_over_ranges(spark):
    rows = [(None if i % 5 == 0 else i % 3, float((i * 7919) % 1009), i % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v double, w int").groupBy("k", "v").agg(F.sum("w").alias("w"))
    got = ranks.running_total(df, ["k"], ["v"], "w").toPandas().fillna({"k": -1}).sort_values(["k", "v"])
    assert len(got) == df.count()
    assert (got.before == got.groupby("k").w.cumsum() - got.w).all()
    alone = ranks.running_total(df.select("v").distinct(), [], ["v"]).toPandas().sort_values("v")
    assert list(alone.before) == list(range(len(alone)))
    assert ranks.running_total(df.filter("v < 0"), ["k"], ["v"]).count() == 0


def test_spearman_with_ties_and_a_long_series(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"lake_id": np.where(rng.random(6000) < 0.7, 1, rng.integers(2, 9, 6000)), "a": rng.integers(0, 300, 6000) / 7.0})
    pdf["b"] = np.where(rng.random(6000) < 0.4, 5.0, pdf.a + rng.normal(0, 9, 6000))
    pdf.loc[::50, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    got = metrics.spearman(df, "a", "b").toPandas().set_index("lake_id").spearman
    for lake, part in pdf.dropna().groupby("lake_id"):
        assert abs(got[lake] - part.a.rank().corr(part.b.rank())) < 1e-9
