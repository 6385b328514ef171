import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quartier.operators import encode, metrics, models
from quartier.operators.evaluate import cv_score, grid_search, oof_predict, run_variants
from quartier.operators.folds import with_fold
from quartier.plans import evaluate
from quartier.plans.catalog.models import modelling_table


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(0, [1, 2, 5], (600, 3))
    y = X @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.3, 600)
    y[:12] += 40
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(X, y))]
    df = with_fold(spark.createDataFrame(rows, "id int, a double, b double, c double, label double"), "id", 3)
    return X, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()


def test_ridge_closed_form(linear):
    X, y, df = linear
    centred, target = X - X.mean(0), y - y.mean()
    want = np.linalg.solve(centred.T @ centred + 250 * np.eye(3), centred.T @ target)
    assert models.Ridge(250.0).fit(df).coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_huber_objective_falls_and_beats_ols(linear):
    X, y, df = linear
    estimator = models.HuberElasticNet(alpha=1e-3, l1Ratio=0.5, epsilon=0.5, maxIter=15, tol=1e-7)
    model = estimator.fit(df)
    assert all(b <= a + 1e-9 for a, b in zip(estimator.history, estimator.history[1:]))
    true = np.array([1.0, -2.0, 0.5])
    plain = models.ols().fit(df).coefficients.toArray()
    assert abs(model.coefficients.toArray() - true).max() < abs(plain - true).max()

    def objective(w, b):
        r = abs(y - X @ w - b)
        loss = np.where(r <= 0.5, r * r / 2, 0.5 * r - 0.125).mean()
        return loss + 1e-3 * (0.5 * abs(w).sum() + 0.25 * (w**2).sum())

    w, b = model.coefficients.toArray(), model.intercept
    best = objective(w, b)
    assert best == pytest.approx(estimator.history[-1], rel=1e-6)
    rng = np.random.default_rng(1)
    assert all(objective(w + rng.normal(0, 0.02, 3), b + rng.normal(0, 0.02)) >= best - 1e-6 for _ in range(200))


def test_every_row_is_predicted_once_by_another_fold(linear):
    _, _, df = linear
    scored = oof_predict(df, models.ols(), "fold", 3)
    assert scored.count() == df.count() == scored.select("id").distinct().count()
    by_hand = models.ols().fit(df.where("fold <> 1")).transform(df.where("fold = 1")).select("id", "prediction")
    joined = scored.where("fold = 1").select("id", F.col("prediction").alias("p")).join(by_hand, "id")
    assert joined.where("abs(p - prediction) > 1e-9").count() == 0


def test_grid_search_and_scores(linear):
    _, _, df = linear
    estimator = models.HuberElasticNet()
    table, best = grid_search(df, estimator, [{estimator.epsilon: e} for e in (0.1, 50.0)], "label", "fold", 3)
    assert table.count() == 2 and best.numFeatures == 3
    score = cv_score(df, models.ols(), "label", "fold", 3).first()
    assert score["folds"] == 3 and score["r2_std"] >= 0
    found = run_variants(df, {"ols": models.ols, "flat": lambda: models.Ridge(1e9)}, "label", "fold", 3)
    r2 = {r["variant"]: r["log_r2"] for r in found.collect()}
    assert r2["ols"] > r2["flat"]


def test_importance_sums_blocks(spark, linear):
    _, _, df = linear
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=["b", "c"], outputCol="pair"),
        VectorAssembler(inputCols=["a", "pair"], outputCol="slots"),
        models.boosted("slots", maxIter=3),
    ])
    model = pipeline.fit(df)
    got = {r["feature"]: r["importance"] for r in
           models.importance(model, model.transform(df), ["a", "pair"], "slots").collect()}
    assert sum(got.values()) == pytest.approx(1) and got["pair"] > got["a"]


def test_trees_beat_lines_on_a_bent_target(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float((a > 0) ^ (b > 0)) * 10 + float(e)) for i, (a, b, e) in
            enumerate(rng.normal(0, 1, (1500, 3)) * [1, 1, 0.3])]
    df = with_fold(spark.createDataFrame(rows, "id int, a double, b double, label double"), "id", 3)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    r2 = [cv_score(df, m, "label", "fold", 3).first()["r2_mean"] for m in (models.ols(), models.boosted(maxIter=5))]
    assert r2[1] > 0.8 > r2[0]


def test_metric_block_clips_and_matches_numpy(spark):
    y, p = np.array([10.0, 20.0, 40.0, 80.0]), np.array([-5.0, 25.0, 38.0, 70.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, p double")
    got = metrics.reg_metrics(df, "y", "p", log=False, min_usd=1.0).first()
    q = p.clip(1)
    r = np.log1p(y) - np.log1p(q)
    assert got["log_rmse"] == pytest.approx(np.sqrt((r**2).mean()))
    assert got["usd_r2"] == pytest.approx(1 - ((y - q) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["median_ape_pct"] == pytest.approx(np.median(abs(y - q) / y) * 100)


def test_ordered_statistic_never_sees_its_own_row(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", float(v)) for i, v in enumerate(rng.normal(0, 1, 900))]
    df = spark.createDataFrame(rows, "id int, c string, y double")
    got = {r["id"]: r["s"] for r in encode.ordered_target_stat(df, "c", "y", "id", 2.0, "s", buckets=16).collect()}
    one = {r["id"]: r["s"] for r in encode.ordered_target_stat(df, "c", "y", "id", 2.0, "s", buckets=1).collect()}
    assert len(got) == 900 and got == pytest.approx(one, rel=1e-9, abs=1e-12)
    mean = np.mean([r[2] for r in rows])
    assert sum(abs(v - mean) < 1e-12 for v in got.values()) >= len({r[1] for r in rows})


def test_onehot_unseen_and_missing_are_zero(spark):
    train = spark.createDataFrame([("x",), ("y",), ("x",)], "c string")
    model = Pipeline(stages=encode.onehot_stages(["c"])).fit(train)
    got = model.transform(spark.createDataFrame([("x",), ("new",), (None,)], "c string"))
    assert [float(r["c_ohe"].toArray().sum()) for r in got.collect()] == [1.0, 0.0, 0.0]


def test_spatial_variant_pipeline_keeps_rows(spark, sf_dir):
    df = modelling_table(spark, sf_dir)
    model = evaluate.linear_pipeline("tree_num_kmeans", buckets=16, min_rows=5).fit(df)
    scored = model.transform(df)
    assert scored.count() == df.count() and scored.where("prediction is null or isnan(prediction)").count() == 0
    importances = evaluate.boosted_importance(df, address="tfidf", cats="onehot_rich", buckets=16, rounds=2)
    assert importances.agg(F.sum("importance")).first()[0] == pytest.approx(100)


def test_folds_that_are_not_all_scored_are_refused(spark, linear):
    _, _, df = linear
    ten = with_fold(df.drop("fold"), "id", 10)
    with pytest.raises(ValueError):
        oof_predict(ten, models.Ridge(1.0), k=5)
    with pytest.raises(ValueError):
        oof_predict(ten.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold"))), models.Ridge(1.0), k=10)
    assert oof_predict(ten, models.Ridge(1.0), k=10).count() == df.count()


@pytest.fixture(scope="module")
def table(spark):
    words = ["north", "south", "mill", "lake", "hill", "park", "gate", "bridge", "field", "stone", "river"]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        picked = rng.choice(words, 4)
        value = sum(0.1 * words.index(w) for w in picked) + rng.normal(0, 0.1)
        rows.append((i, f"{' '.join(picked)} {i % 90}", None if i % 50 == 0 else words[i % 7], float(value) + 7, i * 7 % 5))
    return spark.createDataFrame(rows, "id int, address string, series string, label double, fold int").persist()


@pytest.mark.parametrize("size", [64, 8192])
def test_ridge_scores_prepare_once_and_fit_wide_folds_together(table, size, monkeypatch):
    from quartier.operators import evaluate as operators
    from quartier.operators.textfeatures import Grams, hashing_stages

    pipeline = Pipeline(stages=[*hashing_stages("address", "features", size), models.Ridge(1.0)])
    want = metrics.r2_per_fold(oof_predict(table, pipeline, "fold", 5, keep=["fold", "label"]), "label", "prediction", "fold").first()
    cut, fits, transform = [], [], Grams._transform
    monkeypatch.setattr(Grams, "_transform", lambda self, df: cut.append(1) or transform(self, df))
    if size > operators.WIDE:
        monkeypatch.setattr(operators, "oof_predict", lambda *a, **kw: fits.append(a))
    got = cv_score(table, pipeline, "label", "fold", 5).first()
    assert len(cut) == 1 and not fits and got["folds"] == 5
    assert (got["r2_mean"], got["r2_std"]) == pytest.approx((want["r2_mean"], want["r2_std"]), abs=1e-5)
