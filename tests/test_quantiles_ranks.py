import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartier.operators import lookup as L
from quartier.operators.quantiles import bucket_of, quantiles
from quartier.operators.ranks import spearman, values_below

PROBS = [0.0, 0.01, 1 / 3, 0.5, 0.77, 0.99, 1.0]


def pandas_quantiles(pdf, by):
    clean = pdf.dropna()
    return {k: g["v"].quantile(PROBS).tolist() for k, g in clean.groupby(by)}


def check(spark, pdf):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, v double")
    got = {r["g"]: r["q"] for r in quantiles(df, "v", PROBS, ["g"]).collect() if r["q"] is not None}
    want = pandas_quantiles(pdf, "g")
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)
    total = quantiles(df, "v", PROBS).first()["q"]
    assert total == pytest.approx(pdf["v"].dropna().quantile(PROBS).tolist(), rel=1e-9, abs=1e-9)


def skewed(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 20, n).astype(str))
    v = np.where(rng.random(n) < 0.3, 7.0, rng.lognormal(3, 2, n).round(3))
    return pd.DataFrame({"g": g, "v": v})


def test_small_path(spark):
    check(spark, skewed())


def test_spread_path(spark, spread_path):
    pdf = skewed()
    pdf.loc[::17, "v"] = np.nan
    pdf.loc[::31, "g"] = None
    clean = pdf.copy()
    check(spark, clean[clean["g"].notna()])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, v double")
    assert quantiles(df, "v", [0.5], ["g"]).where("g is null").count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-4000, 4000)), min_size=1, max_size=40))
def test_spread_path_any_input(spark, spread_path, rows):
    check(spark, pd.DataFrame([(g, v / 8) for g, v in rows], columns=["g", "v"]))


def test_empty_and_all_null(spark, spread_path):
    df = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, v double")
    assert quantiles(df, "v", [0.5], ["g"]).first()["q"] is None
    assert quantiles(df.limit(0), "v", [0.5]).first()["q"] is None


def test_bucket_of_counts_cuts_below(spark):
    cuts = [1.0, 2.0, 2.0, 5.0]
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 9.0)], "v double")
    array = F.array(*[F.lit(c) for c in cuts])
    got = [r["b"] for r in df.select(bucket_of(F.col("v"), array, 8).alias("b")).collect()]
    assert got == [0, 0, 1, 1, 3, 3, 4]


def test_values_below_spread(spark, spread_path):
    pdf = skewed()[["g", "v"]].drop_duplicates()
    df = spark.createDataFrame(pdf.values.tolist(), "g string, v double").withColumn("w", F.lit(2))
    got = {(r["g"], r["v"]): r["b"] for r in values_below(df, ["g"], "v", "w", "b").collect()}
    pdf["rank"] = pdf.groupby("g")["v"].rank(method="min")
    assert got == {(g, v): 2 * (k - 1) for g, v, k in pdf.itertuples(index=False)}


def test_spearman_with_ties_on_both_paths(spark, monkeypatch, request):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.34, 5, rng.integers(0, 400, 3000)).astype(float)
    y = x + rng.normal(0, 80, 3000).round(0)
    z = rng.normal(0, 1, 3000)
    pdf = pd.DataFrame({"x": x, "z": z, "y": y})
    want = {c: pdf[c].rank().corr(pdf["y"].rank()) for c in "xz"}
    df = spark.createDataFrame(pdf)
    for forced in (False, True):
        if forced:
            request.getfixturevalue("spread_path")
        got = {r["feature"]: r["rho"] for r in spearman(df, ["x", "z"], "y", "rho").collect()}
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_lookup_splits_hot_keys(spark, monkeypatch):
    rows = [(k, i) for i, k in enumerate(["hot"] * 500 + [str(j) for j in range(400)] + [None] * 30)]
    df = spark.createDataFrame(rows, "k string, i int")
    dim = spark.createDataFrame([("hot", 1.0)] + [(str(j), float(j)) for j in range(0, 400, 2)], "k string, v double")
    small = {r["i"]: r["v"] for r in L.lookup(df, dim, ["k"]).collect()}
    monkeypatch.setattr(L, "BROADCAST_ROWS", 1)
    split = {r["i"]: r["v"] for r in L.lookup(df, dim, ["k"]).collect()}
    assert len(rows) == len(small) and small == split
    assert L.bounded(dim, 5) is None and L.bounded(dim, 500).count() == dim.count()


def test_ranks_of_a_lookup_are_stored(spark):
    """Hot keys, their rows and the others each ranked everything anew before."""
    from quartier.operators.ranks import average_ranks

    pairs = spark.createDataFrame([("f", float(i % 5), 2) for i in range(20)], ["feature", "_x", "_w"])
    ranks, rows = average_ranks(pairs, ["feature"], "_x", "_w", "_r", exact_rows=2)
    assert rows == 5 and sorted(r["_r"] for r in ranks.collect()) == [4.5, 12.5, 20.5, 28.5, 36.5]
    assert "Window" not in ranks._jdf.queryExecution().toString()
