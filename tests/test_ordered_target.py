"""Ordered target statistics: training rows never see their own target."""

import hashlib

import pytest
from pyspark.ml import Pipeline, PipelineModel

from quartier.operators.encode import OrderedTarget, ordered_fold_stats
from quartier.session import scratch_path

SCHEMA = "id int, cat string, y double, fold int, _c string"


def rows():
    out = []
    for i in range(120):
        cat = "hot" if i % 3 else [None, "a", "b", ""][i // 3 % 4]
        out.append((i, cat, None if i % 11 == 0 else float(i * 7 % 23), None if i % 29 == 0 else i % 4, "kept"))
    return [*out, (500, "alone", 4.0, 1, None)]


def plain(data, fold, weight):
    """{id: statistic} by walking the rows in hashed order."""
    def order(r):
        return int(hashlib.md5(f"0:{r[0]}".encode()).hexdigest()[:8], 16), r[0]

    train = [r for r in data if r[3] is not None and r[3] != fold]
    known = [r[2] for r in train if r[2] is not None]
    mean = sum(known) / len(known)
    found = {}
    for r in data:
        same = [t for t in train if (t[1] or t[1] == "") == (r[1] or r[1] == "") and t[1] == r[1] and t[2] is not None]
        if r[3] is not None and r[3] != fold:
            same = [t for t in same if order(t) < order(r)]
        found[r[0]] = (sum(t[2] for t in same) + weight * mean) / (len(same) + weight)
    return found


@pytest.mark.parametrize("buckets", [1, 8, 4096])
def test_fold_stats_equal_a_walk(spark, buckets):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumnRenamed("_c", "extra").repartition(5)
    got = ordered_fold_stats(df, "cat", "y", "id", 2.5, "stat", "fold", 4, buckets=buckets)
    assert got.columns == ["id", "cat", "y", "fold", "extra", *[f"stat_{f}" for f in range(4)]]
    got = {r["id"]: r for r in got.collect()}
    assert len(got) == len(data)
    for f in range(4):
        want = plain(data, f, 2.5)
        assert {i: r[f"stat_{f}"] for i, r in got.items()} == pytest.approx(want)


def test_own_target_changes_nothing(spark):
    data = rows()
    other = [(i, c, (y or 0.0) + 1000.0 if i == 44 else y, f, e) for i, c, y, f, e in data]

    def stat(d):
        df = spark.createDataFrame(d, SCHEMA).drop("_c")
        # Without a prior the row's own target could only come in through its level.
        return {r["id"]: r for r in ordered_fold_stats(df, "cat", "y", "id", 0.0, "s", "fold", 4).collect()}

    before, after = stat(data)[44], stat(other)[44]
    assert [before[f"s_{f}"] for f in range(4)] == [after[f"s_{f}"] for f in range(4)]  # fold 0: held out


def test_stage_in_a_pipeline(spark):
    data = rows()
    df = spark.createDataFrame([(*r[:4], r[3] is not None and r[3] != 2) for r in data], "id int, cat string, y double, fold int, training boolean")
    stage = OrderedTarget(col="cat", y="y", key="id", prior_weight=2.5, out="stat")
    model = Pipeline(stages=[stage]).fit(df)
    want = plain(data, 2, 2.5)
    assert {r["id"]: r["stat"] for r in model.transform(df).collect()} == pytest.approx(want)
    path = scratch_path(spark, "ordered")
    model.write().save(path)
    new = spark.createDataFrame([(1, "hot"), (2, "never"), (3, None)], "id int, cat string")
    got = {r["id"]: r["stat"] for r in PipelineModel.load(path).transform(new).collect()}
    train = [r for r in data if r[3] is not None and r[3] != 2 and r[2] is not None]
    mean = sum(r[2] for r in train) / len(train)

    def full(level):
        same = [r[2] for r in train if r[1] == level]
        return (sum(same) + 2.5 * mean) / (len(same) + 2.5)

    assert got == pytest.approx({1: full("hot"), 2: mean, 3: full(None)})


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id int, cat string, y double, fold int, training boolean")
    assert ordered_fold_stats(empty, "cat", "y", "id", 1.0, "s", "fold", 2).count() == 0
    model = OrderedTarget(col="cat", y="y", key="id", out="s").fit(empty)
    assert model.transform(empty).count() == 0
    assert model.transform(spark.createDataFrame([("a",)], "cat string")).first()["s"] is None
