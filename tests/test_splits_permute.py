"""Exact split search and shuffled columns against brute force."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from quartier.operators import models
from quartier.operators.permute import permutation_importance, permuted
from quartier.operators.splits import exact_splits, exact_zones


def best(x, y, least):
    """(threshold, n_left, n_right, gain) by trying every cut."""
    found = None
    for v, after in zip(np.unique(x), np.unique(x)[1:]):
        a, b = y[x <= v], y[x > v]
        if min(len(a), len(b)) >= least:
            gain = ((y - y.mean()) ** 2).sum() - ((a - a.mean()) ** 2).sum() - ((b - b.mean()) ** 2).sum()
            if found is None or gain > found[3] * (1 + 1e-9):
                found = (float((v + after) / 2), len(a), len(b), float(gain))
    return found


def skewed(n=400, seed=0):
    """A value that holds a third of all rows, ties, nulls, NaN and a column with a single value."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = 3.5 if i % 3 == 0 else float(rng.integers(0, 40)) / 4
        b = None if i % 7 == 0 else float("nan") if i % 31 == 0 else float(rng.normal())
        y = None if i % 41 == 0 else float(int(a > 4) * 50 + int((b or 0) > 0.3) * 20 + rng.integers(0, 9))
        rows.append((i, ["p", "q", None][i % 3 if i % 5 else 2], a, b, 1.0, y))
    return rows, "id int, g string, a double, b double, c double, y double"


@pytest.mark.parametrize("exact_rows", [None, 10])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_splits_equal_every_cut(spark, by, exact_rows):
    rows, schema = skewed()
    df = spark.createDataFrame(rows, schema).repartition(6)
    got = exact_splits(df, ["a", "b", "c"], "y", 8, by, exact_rows)
    got = {(r["g"] if by else 0, r["feature"]): (r["threshold"], r["n_left"], r["n_right"], r["gain"]) for r in got.collect()}
    want = {}
    for group in {r[1] if by else 0 for r in rows}:
        for name, at in (("a", 2), ("b", 3), ("c", 4)):
            mine = [r for r in rows if not by or r[1] == group]
            mine = [(r[at], r[5]) for r in mine if r[at] is not None and r[at] == r[at] and r[5] is not None]
            cut = best(np.array([m[0] for m in mine]), np.array([m[1] for m in mine]), 8)
            if cut:
                want[group, name] = cut
    assert set(got) == set(want) and not any(name == "c" for _, name in got)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_no_split(spark):
    schema = "id int, a double, y double"
    assert exact_splits(spark.createDataFrame([], schema), ["a"], "y").count() == 0
    few = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 5.0)], schema)
    assert exact_splits(few, ["a"], "y", 2).count() == 0
    assert exact_splits(few, ["a"], "y", 1).first()["threshold"] == 1.5


@pytest.mark.parametrize("exact_rows", [None, 10])
def test_zones_equal_a_greedy_tree(spark, exact_rows):
    rows, schema = skewed(300, 1)
    placed = exact_zones(spark.createDataFrame(rows, schema), ["a", "b"], "y", 3, 10, "zone", exact_rows)
    assert placed.columns == ["id", "g", "a", "b", "c", "y", "zone"]
    got = {r["id"]: r["zone"] for r in placed.collect()}
    known = [r for r in rows if r[3] is not None and r[3] == r[3] and r[5] is not None]
    want = {r[0]: 1 for r in known}
    for level in range(3):
        for node in range(1 << level, 2 << level):
            mine = [r for r in known if want[r[0]] == node]
            cuts = [(best(np.array([r[at] for r in mine]), np.array([r[5] for r in mine]), 10), at) for at in (2, 3)] if mine else []
            cuts = [(c, at) for c, at in cuts if c]
            if cuts:
                (t, *_), at = max(cuts, key=lambda c: c[0][3])
                for r in mine:
                    want[r[0]] = 2 * node + (r[at] > t)
    assert got == {r[0]: want.get(r[0]) for r in rows}
    assert len(set(want.values())) > 4


@pytest.mark.parametrize("slice_rows", [None, 7])
def test_permuted_gives_each_row_once(spark, slice_rows):
    df = spark.createDataFrame([(i, i * 10, f"t{i}", None) for i in range(200)], "id int, a int, t string, _n string").repartition(5)
    rows = permuted(df, "id", ["a", "t"], 3, slice_rows=slice_rows).collect()
    assert sorted(r["id"] for r in rows) == list(range(200)) == sorted(r["a_perm"] // 10 for r in rows)
    assert all(r["t_perm"] == f"t{r['a_perm'] // 10}" for r in rows)  # whole rows are given
    assert sum(r["a"] == r["a_perm"] for r in rows) < 10
    again = permuted(df.repartition(3), "id", ["a", "t"], 3, slice_rows=11).collect()
    assert {r["id"]: r["a_perm"] for r in rows} == {r["id"]: r["a_perm"] for r in again}
    other = {r["id"]: r["a_perm"] for r in permuted(df, "id", ["a"], 4).collect()}
    assert other != {r["id"]: r["a_perm"] for r in rows}


def test_permuted_edges(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, None), (5, 4)], "id int, a int")
    assert sorted(str(r["a_perm"]) for r in permuted(df, "id", ["a"]).collect()) == ["1", "2", "4", "None"]
    assert permuted(df.limit(0), "id", ["a"]).count() == 0
    (row,) = permuted(df.limit(1), "id", ["a"]).collect()
    assert row["a"] == row["a_perm"]


def test_importance_of_used_and_unused_columns(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        a, b, noise = (float(v) for v in rng.normal(size=3))
        rows.append((i, a, b, noise, 1.0, 3 * a + b if i % 50 else None))
    df = spark.createDataFrame(rows, "id int, a double, b double, noise double, one double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "one"], outputCol="features"), models.ols()]).fit(df.dropna())
    found = {r["feature"]: r for r in permutation_importance(model, df, ["a", "b", "noise", "one"], "label", "id", repeats=3).collect()}
    assert found["noise"]["r2_drop"] == found["one"]["r2_drop"] == 0.0 == found["one"]["r2_drop_std"] == found["noise"]["mse_rise"]
    assert found["a"]["r2_drop"] == pytest.approx(1.8, abs=0.25) and found["b"]["r2_drop"] == pytest.approx(0.2, abs=0.1)
    assert {r["n"] for r in found.values()} == {490} and found["a"]["r2"] == pytest.approx(1.0)


def test_importance_counts_its_rows_once(spark, monkeypatch):
    """Each shuffle used to count the rows anew."""
    from quartier.operators import permute

    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], ["id", "a", "label"])
    line = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), models.ols()]).fit(df)
    counted = []
    real = permute.permuted
    monkeypatch.setattr(permute, "permuted", lambda *a, rows=None, **kw: counted.append(rows) or real(*a, rows=rows, **kw))
    (row,) = permute.permutation_importance(line, df, ["a"], "label", "id", repeats=2).collect()
    assert counted == [60, 60] and row["n"] == 60
