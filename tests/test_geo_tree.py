import heapq

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quartier.operators import geo
from quartier.operators.tree import ZONE_SCHEMA, GeoZones, GeoZonesModel, fit_zones
from quartier.session import scratch_path


def surface(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 40, n) / 10, rng.integers(0, 30, n) / 10
    v = 100 * (x > 1.7) + 50 * (y > 2.2) * (x <= 1.7) + 10 * x * y + rng.normal(0, 5, n)
    return x, y, v


def brute_force_best_first(points, v, leaves, min_rows):
    """Exhaustive best-first growth: (sorted leaf sizes, total squared error)."""

    def error(i):
        return ((v[i] - v[i].mean()) ** 2).sum()

    def best(i):
        found = (0.0, None)
        for axis in range(points.shape[1]):
            column = points[i, axis]
            for t in np.unique(column)[:-1]:
                left, right = i[column <= t], i[column > t]
                if min(len(left), len(right)) >= min_rows:
                    gain = error(i) - error(left) - error(right)
                    if gain > found[0] + 1e-9:
                        found = (gain, (left, right))
        return found

    everything = np.arange(len(v))
    done, heap, count = [], [], 0

    def push(i):
        nonlocal count
        gain, parts = best(i)
        count += 1
        if parts is None:
            done.append(i)
        else:
            heapq.heappush(heap, (-gain, count, i, parts))

    push(everything)
    while heap and len(done) + len(heap) < leaves:
        _, _, _, parts = heapq.heappop(heap)
        for p in parts:
            push(p)
    final = done + [h[2] for h in heap]
    return sorted(len(i) for i in final), sum(error(i) for i in final)


@pytest.mark.parametrize("leaves", [2, 7, 12])
def test_leaf_budget_tree_equals_best_first_growth(spark, leaves):
    x, y, v = surface()
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), v.tolist())), "lat double, lon double, v double")
    zones = fit_zones(df, "lat", "lon", "v", [leaves], 30)[leaves]
    sizes, error = brute_force_best_first(np.column_stack([x, y]), v, leaves, 30)
    assert sorted(z[6] for z in zones) == sizes
    table = spark.createDataFrame(zones, ZONE_SCHEMA)
    placed = geo.assign_zone(df, table, "lat", "lon", ["leaf", "value"])
    assert placed.where("leaf is null").count() == 0
    assert placed.agg(F.sum(F.pow(F.col("v") - F.col("value"), F.lit(2)))).first()[0] == pytest.approx(error, rel=1e-9)


def test_zone_features_by_mode(spark):
    x, y, v = surface()
    rows = list(zip(x.tolist(), y.tolist(), np.log1p(v.clip(1)).tolist()))
    df = spark.createDataFrame(rows, "lat double, lon double, label double").withColumn("area", F.lit(1.0))
    for mode, width in (("ohe", 8), ("num", 1), ("lognum", 1), ("ohe_num", 9)):
        model = GeoZones(x="lat", y="lon", target="label", area="area", max_leaves=8, min_rows=30, mode=mode, out="g").fit(df)
        out = model.transform(df)
        vectors = np.array([r["g"].toArray() for r in out.select("g").collect()])
        assert vectors.shape[1] == width
        if mode in ("num", "lognum"):
            assert vectors.mean() == pytest.approx(0, abs=1e-6) and vectors.std() == pytest.approx(1, rel=1e-6)
        if mode == "ohe":
            assert (vectors.sum(axis=1) == 1).all()
    path = scratch_path(spark, "zones")
    model.write().overwrite().save(path)
    again = GeoZonesModel.load(path).transform(df).select("g").collect()
    assert again == out.select("g").collect()


def test_assign_zone_edges_and_outside(spark):
    zones = spark.createDataFrame(
        [(1, 0.0, 1.0, 0.0, 1.0), (2, 1.0, 2.0, 0.0, 1.0)], "leaf int, lat_lo double, lat_hi double, lon_lo double, lon_hi double"
    )
    points = [(0.0, 0.5, None), (0.5, 0.5, 1), (1.0, 1.0, 1), (1.0000001, 1.0, 2), (2.0, 1.0, 2), (2.1, 0.5, None), (None, 0.5, None)]
    df = spark.createDataFrame(points, "lat double, lon double, want int")
    got = geo.assign_zone(df, zones, "lat", "lon", ["leaf"])
    assert got.count() == len(points) and got.where("NOT leaf <=> want").count() == 0


def test_nearest_ties_go_to_the_lowest_id(spark):
    centroids = spark.createDataFrame([(3, 0.0), (1, 2.0)], "cluster int, x double")
    df = spark.createDataFrame([(1.0,), (-5.0,), (None,)], "x double")
    got = [r["cluster"] for r in geo.assign_nearest(df, centroids, ["x"]).collect()]
    assert got == [1, 3, None]


def test_best_split_by_brute_force(spark):
    x, _, v = surface(600)
    df = spark.createDataFrame(list(zip(x.tolist(), v.tolist())), "x double, v double")
    row = geo.best_split(df, "x", "v", 39, 20).first()
    left = x <= row["threshold"] - 1e-9
    total = ((v - v.mean()) ** 2).sum()
    split = sum(((v[m] - v[m].mean()) ** 2).sum() for m in (left, ~left))
    assert row["gain"] == pytest.approx(total - split, rel=1e-6) and row["n_left"] == left.sum()


def test_kmeans_one_hot(spark):
    x, y, _ = surface(400)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "lat double, lon double")
    out = geo.GeoKMeans(cols=["lat", "lon"], k=4, restarts=2, out="k").fit(df).transform(df)
    vectors = np.array([r["k"].toArray() for r in out.select("k").collect()])
    assert (vectors.sum(axis=1) == 1).all() and (vectors.sum(axis=0) > 0).sum() == 4


def test_far_coordinates_lie_in_a_zone(spark):
    x, y, v = surface()
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), v.tolist())), "lat double, lon double, v double")
    model = GeoZones(x="lat", y="lon", target="v", max_leaves=5).fit(df)
    far = spark.createDataFrame([(2e9, -3e12), (-2e9, 5e9)], "lat double, lon double")
    assert model.assign(far).where("geo_zone_leaf is null").count() == 0


def test_restarts_together_equal_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in [(0, 0), (4, 0), (0, 4), (9, 9)]]).round(2)
    rows = [tuple(map(float, p)) for p in points] + [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame([*rows, *rows[:30]], "x double, y double").repartition(5)
    centres, cost = geo.kmeans_restarts(df, ["x", "y"], 4, 6, seed=2)
    full, centres = np.concatenate([points, points[:30]]), np.array(centres)
    for _ in range(5):
        near = ((full[:, None] - centres) ** 2).sum(2).argmin(1)
        again = np.array([full[near == c].mean(0) for c in range(4)])
        assert again == pytest.approx(centres, abs=1e-4)  # no centre moves any more
    assert cost == pytest.approx(((full - centres[near]) ** 2).sum(), rel=1e-6)
    assert sorted(np.bincount(near)) == [60, 60, 60, 90]
    (alone,), _ = geo.kmeans_restarts(df, ["x", "y"], 1, 2)
    assert alone == pytest.approx(full.mean(0).tolist())


def test_fewer_positions_than_clusters(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 2.0, "b"), (5.0, 2.0, "c"), (None, 2.0, "d"), (float("nan"), 1.0, "e")], "x double, y double, _0 string")
    model = geo.GeoKMeans(cols=["x", "y"], k=4, restarts=2, out="k").fit(df)
    model.write().save(str(tmp_path / "m"))
    got = {r["_0"]: (r["k_cluster"], r["k"].size) for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == got["e"] == (4, 5)
    with pytest.raises(ValueError):
        geo.kmeans_restarts(df.limit(0), ["x", "y"], 4, 2)


def test_strips_equal_cells(spark, monkeypatch):
    """Random nested cuts of the plane, with points on the edges, off the zones and without a place."""
    rng = np.random.default_rng(8)
    boxes = [(-1e9, 1e9, -1e9, 1e9)]
    while len(boxes) < 60:
        box = list(boxes.pop(int(rng.integers(len(boxes)))))
        axis = int(rng.integers(2))
        lo, hi = (max(box[2 * axis], 0), min(box[2 * axis + 1], 100))
        at = float(np.round(rng.uniform(lo, hi), 1))
        low, high = list(box), list(box)
        low[2 * axis + 1] = high[2 * axis] = at
        boxes += [tuple(b) for b in (low, high) if b[0] < b[1] and b[2] < b[3]] if box[2 * axis] < at < box[2 * axis + 1] else [tuple(box)]
    boxes.pop()  # a gap
    zones = spark.createDataFrame([(i, *b, None if i % 5 == 0 else f"z{i}") for i, b in enumerate(boxes)], "leaf int, lat_lo double, lat_hi double, lon_lo double, lon_hi double, name string")
    edges = [v for b in boxes for v in b if abs(v) < 1e8]
    points = [(float(a), float(b)) for a, b in rng.choice(edges, (200, 2))] + [(float(a), float(b)) for a, b in rng.uniform(-5, 105, (400, 2))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*points, (None, 1.0), (1.0, None), (2e9, 2e9)])], "id int, a double, b double")
    cells = geo.assign_zone(df, zones, "a", "b", ["leaf", "name"])
    monkeypatch.setattr(geo, "MAX_CELLS", 0)
    strips = geo.assign_zone(df, zones, "a", "b", ["leaf", "name"])
    assert strips.columns == cells.columns == ["id", "a", "b", "leaf", "name"]
    got = {r["id"]: (r["leaf"], r["name"]) for r in strips.collect()}
    assert got == {r["id"]: (r["leaf"], r["name"]) for r in cells.collect()} and len(got) == 603
    want = {i: [z for z, (a0, a1, b0, b1) in enumerate(boxes) if a0 < a <= a1 and b0 < b <= b1] for i, (a, b) in enumerate(points)}
    assert {i: z[0] if z else None for i, z in want.items()} == {i: got[i][0] for i in want}
