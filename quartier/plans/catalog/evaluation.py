"""Queries on regression metrics, fold scores, variant tables and one-variable fits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quartier.operators import histboost, manylinear, metrics, models, permute
from quartier.operators.encode import oof_target_mean
from quartier.operators.evaluate import cv_score, grid_search, oof_predict
from quartier.operators.filters import ZScore
from quartier.operators.folds import with_fold
from quartier.operators.geo import GeoKMeans
from quartier.operators.groupings import unpivot_levels
from quartier.plans.catalog.registry import LISTINGS, UNITS, fold_sql, query, r, rounded, unit_listings
from quartier.session import checkpointed, scratch_path
from quartier.sources.listings import clean_listings
from quartier.sources.tables import read_metrics_json, write_json_record, write_table

# Variants: the out-of-fold mean log price by one category, or by none.
_VARIANTS = ["nothing", "series", "building_material", "condition", "rooms_level"]

SCORED = f"""{LISTINGS}, f AS (SELECT *, ln(1 + usd_price_syn) AS y, 'all' AS nothing, rooms::VARCHAR AS rooms_level,
  {fold_sql('listing_id')} AS fold FROM l),
u AS ({' UNION ALL '.join(
    f"SELECT listing_id, fold, y, '{v}' AS variant, coalesce({v}, 'MISSING') AS level FROM f" for v in _VARIANTS)}),
s AS (SELECT variant, level, fold, sum(y) AS s, count(y) AS n FROM u GROUP BY 1, 2, 3),
m AS (SELECT variant, level, fold, (sum(s) OVER (PARTITION BY variant, level) - s)
        / nullif(sum(n) OVER (PARTITION BY variant, level) - n, 0) AS m FROM s),
o AS (SELECT fold, (SELECT sum(y) FROM f) AS ts, (SELECT count(y) FROM f) AS tn, sum(y) AS s, count(y) AS n FROM f GROUP BY 1),
p AS (SELECT u.*, coalesce(m.m, (o.ts - o.s) / (o.tn - o.n)) AS p FROM u LEFT JOIN m USING (variant, level, fold)
      JOIN o USING (fold))"""

_BLOCK = [
    ("n", "count(*)", None),
    ("log_r2", "1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))", 6),
    ("log_rmse", "sqrt(avg(pow(y - p, 2)))", 6),
    ("log_mae", "avg(abs(y - p))", 6),
    ("usd_r2", "1 - sum(pow(uy - up, 2)) / (var_pop(uy) * count(*))", 6),
    ("usd_rmse", "sqrt(avg(pow(uy - up, 2)))", 2),
    ("usd_mae", "avg(abs(uy - up))", 2),
    ("mape_pct", "avg(abs((uy - up) / uy) * 100)", 4),
    ("median_ape_pct", "median(abs((uy - up) / uy) * 100)", 4),
]
_DIGITS = {name: digits for name, _, digits in _BLOCK if digits}
METRICS_SQL = (
    f"{SCORED}, pu AS (SELECT *, exp(y) - 1 AS uy, exp(p) - 1 AS up FROM p), k AS (SELECT variant, "
    + ", ".join(f"{e if digits is None else r(e, digits)} AS {name}" for name, e, digits in _BLOCK)
    + " FROM pu GROUP BY 1)"
)


def scored(spark, d):
    """Long (variant, fold, y, prediction) of all variants, in one plan."""
    listings = clean_listings(spark, d).select(
        "listing_id", "series", "building_material", "condition",
        F.col("rooms").cast("string").alias("rooms_level"), F.lit("all").alias("nothing"),
        F.log1p("usd_price_syn").alias("y"),
    )
    folded = with_fold(listings, "listing_id")
    long = unpivot_levels(folded, _VARIANTS, ["listing_id", "fold", "y"], "MISSING")
    long = long.withColumnRenamed("feature", "variant")
    return oof_target_mean(long, ["variant", "level"], "y", "fold", "prediction")


def _metric_table(spark, d):
    return rounded(metrics.reg_metrics(scored(spark, d), "y", "prediction", ["variant"]), _DIGITS)


@query("reg_metrics", f"WITH {METRICS_SQL} SELECT * FROM k")
def reg_metrics(spark, d):
    return _metric_table(spark, d)


_NAMES = ["log_r2", "log_rmse", "median_ape_pct"]


@query(
    "variant_delta",
    f"WITH {METRICS_SQL}, x AS (" + " UNION ALL ".join(
        f"SELECT variant, '{m}' AS metric, {m} AS value FROM k" for m in _NAMES
    ) + f") SELECT x.variant, x.metric, x.value, {r('x.value - b.value')} AS delta FROM x JOIN x b"
    " ON b.metric = x.metric AND b.variant = 'nothing'",
)
def variant_delta(spark, d):
    return rounded(metrics.variant_delta(_metric_table(spark, d), "variant", "nothing", _NAMES))


@query("topk_configs", f"WITH {METRICS_SQL} SELECT * FROM k ORDER BY log_r2 DESC, variant LIMIT 3")
def topk_configs(spark, d):
    return metrics.top_configs(_metric_table(spark, d), "log_r2", 3, ["variant"])


@query("grid_best", f"WITH {METRICS_SQL} SELECT * FROM k ORDER BY log_rmse, variant LIMIT 1")
def grid_best(spark, d):
    return metrics.best_config(_metric_table(spark, d), "log_rmse", ["variant"])


@query(
    "r2_pooled",
    f"WITH {SCORED} SELECT {r('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))')} AS r2 FROM p WHERE variant = 'series'",
)
def r2_pooled(spark, d):
    rows = scored(spark, d).where("variant = 'series'")
    return rounded(metrics.r2_pooled(rows, "y", "prediction"))


_FOLD_R2 = (
    "fr AS (SELECT variant, fold, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY 1, 2)"
)


@query(
    "r2_per_fold",
    f"WITH {SCORED}, {_FOLD_R2} SELECT variant, {r('avg(r2)')} AS r2_mean, {r('stddev_pop(r2)')} AS r2_std,"
    " count(*) AS folds FROM fr GROUP BY 1",
)
def r2_per_fold(spark, d):
    return rounded(metrics.r2_per_fold(scored(spark, d), "y", "prediction", "fold", ["variant"]))


@query(
    "overfit_gap",
    f"""WITH {SCORED}, {_FOLD_R2}, c AS (SELECT variant, avg(r2) AS cv_r2 FROM fr GROUP BY 1),
i AS (SELECT u.*, avg(y) OVER (PARTITION BY variant, level) AS fit FROM u),
t AS (SELECT variant, 1 - sum(pow(y - fit, 2)) / (var_pop(y) * count(*)) AS train_r2 FROM i GROUP BY 1)
SELECT variant, {r('train_r2')} AS train_r2, {r('cv_r2')} AS cv_r2, {r('train_r2 - cv_r2')} AS overfit_gap
FROM t JOIN c USING (variant)""",
)
def overfit_gap(spark, d):
    rows = scored(spark, d)
    held_out = metrics.r2_per_fold(rows, "y", "prediction", "fold", ["variant"])
    # A group mean's training R2 from group sums alone: within-group over total variance.
    levels = rows.groupBy("variant", "level").agg(
        F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")
    )
    n, m = F.col("n"), F.col("m")
    within = F.sum(n * F.col("v"))
    total = within + F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)
    train = levels.groupBy("variant").agg((1 - within / total).alias("train_r2"))
    both = train.join(held_out.select("variant", F.col("r2_mean").alias("cv_r2")), "variant")
    return rounded(metrics.overfit_gap(both, "train_r2", "cv_r2"))


@query(
    "resid_diagnostics",
    f"""WITH {SCORED}, e AS (SELECT y - p AS r FROM p WHERE variant = 'series'), a AS (SELECT avg(r) AS mu FROM e)
SELECT count(*) AS n, {r('avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 1.5)', 5)} AS skew,
 {r('stddev_pop(r)')} AS std, {r('avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) - 3', 5)} AS kurt
FROM e CROSS JOIN a""",
)
def resid_diagnostics(spark, d):
    rows = scored(spark, d).where("variant = 'series'")
    return rounded(metrics.residual_diagnostics(rows, "y", "prediction"), {"skew": 5, "kurt": 5})


def _points(spark, d):
    df = clean_listings(spark, d).select("area_total", F.log1p("usd_price_syn").alias("label"))
    return VectorAssembler(inputCols=["area_total"], outputCol="features").transform(df)


def _line(spark, model, **more):
    row = {"slope": float(model.coefficients[0]), "intercept": float(model.intercept), **more}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))


_T = f"{LISTINGS}, t AS (SELECT area_total AS x, ln(1 + usd_price_syn) AS y FROM l)"


@query(
    "ols_1d",
    f"WITH {_T} SELECT {r('regr_slope(y, x)')} AS slope, {r('regr_intercept(y, x)')} AS intercept,"
    f" {r('regr_r2(y, x)')} AS r2, {r('1 - (1 - regr_r2(y, x)) * (count(*) - 1) / (count(*) - 2)')} AS r2_adj FROM t",
)
def ols_1d(spark, d):
    model = models.ols().fit(_points(spark, d))
    return rounded(_line(spark, model, r2=model.summary.r2, r2_adj=model.summary.r2adj))


_SLOPE = "regr_sxy(y, x) / (regr_sxx(y, x) + 5000.0::DOUBLE)"


@query(
    "ridge_1d",
    f"WITH {_T} SELECT {r(_SLOPE)} AS slope, {r(f'avg(y) - {_SLOPE} * avg(x)')} AS intercept FROM t",
)
def ridge_1d(spark, d):
    return rounded(_line(spark, models.Ridge(alpha=5000.0).fit(_points(spark, d))))


_FOLDED = f"""{_T.replace('t AS (SELECT', 't AS (SELECT listing_id, ' + fold_sql('listing_id') + ' AS fold,', 1)}"""


def _folded_points(spark, d):
    df = clean_listings(spark, d).select("listing_id", F.col("area_total"), F.log1p("usd_price_syn").alias("label"))
    return VectorAssembler(inputCols=["area_total"], outputCol="features").transform(with_fold(df, "listing_id"))


@query(
    "oof_ols_1d",
    f"WITH {_FOLDED}, k AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a"
    " FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1)"
    f" SELECT listing_id, fold, {r('a + b * x')} AS prediction FROM t JOIN k USING (fold)",
)
def oof_ols_1d(spark, d):
    """Every row scored by the model of the other folds."""
    scored = oof_predict(_folded_points(spark, d), models.ols(), keep=["listing_id", "fold"])
    return rounded(scored)


@query(
    "cv_ols_1d",
    f"WITH {_FOLDED}, k AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a"
    " FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1),"
    " s AS (SELECT fold, 1 - sum(pow(y - a - b * x, 2)) / (var_pop(y) * count(*)) AS r2 FROM t JOIN k USING (fold) GROUP BY 1)"
    f" SELECT {r('avg(r2)')} AS r2_mean, {r('stddev_pop(r2)')} AS r2_std, count(*) AS folds FROM s",
)
def cv_ols_1d(spark, d):
    return rounded(cv_score(_folded_points(spark, d), models.ols(), "label"))


_PENALTIES = [0.5, 5_000.0, 500_000.0]


@query(
    "grid_ridge_1d",
    f"WITH {_FOLDED}, g(config, alpha) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate(_PENALTIES))}),"
    " k AS (SELECT f.fold, config, regr_sxy(y, x) / (regr_sxx(y, x) + any_value(alpha)) AS b, avg(y) AS my, avg(x) AS mx"
    " FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold CROSS JOIN g GROUP BY 1, 2),"
    " s AS (SELECT config, fold, sqrt(avg(pow(y - my - b * (x - mx), 2))) AS rmse FROM t JOIN k USING (fold) GROUP BY 1, 2)"
    f" SELECT config::INTEGER AS config, {r('avg(rmse)', 5)} AS rmse_mean, {r('stddev_pop(rmse)', 5)} AS rmse_std FROM s GROUP BY 1",
)
def grid_ridge_1d(spark, d):
    """Fold scores of every penalty of a grid."""
    ridge = models.Ridge()
    grid = [{ridge.alpha: a} for a in _PENALTIES]
    table, _ = grid_search(_folded_points(spark, d), ridge, grid, "label")
    return rounded(table.drop("params"), 5)


@query(
    "boosted_stump",
    f"WITH {LISTINGS}, t AS (SELECT (condition IN ('1-URGENT', '2-HIGH'))::INTEGER AS flag, ln(1 + usd_price_syn) AS y FROM l"
    f" WHERE condition IS NOT NULL) SELECT flag, count(*) AS n, {r('avg(y)')} AS prediction, 1.0::DOUBLE AS importance FROM t GROUP BY 1",
)
def boosted_stump(spark, d):
    """One round of one split on a flag: the means of its two groups, and all the importance."""
    df = clean_listings(spark, d).dropna(subset=["condition"])
    df = df.select(F.col("condition").isin("1-URGENT", "2-HIGH").cast("int").alias("flag"), F.log1p("usd_price_syn").alias("label"))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["flag"], outputCol="features"), models.boosted(maxIter=1, maxDepth=1)])
    model = pipeline.fit(df)
    scored = model.transform(df)
    (weight,) = [r["importance"] for r in models.importance(model, scored, ["flag"]).collect()]
    means = scored.groupBy("flag").agg(F.count("*").alias("n"), F.avg("prediction").alias("prediction"))
    return rounded(means.withColumn("importance", F.lit(float(weight))))


@query(
    "kmeans_points",
    f"WITH {LISTINGS} SELECT listing_id % 2 * 10.0::DOUBLE AS a, listing_id % 3 * 10.0::DOUBLE AS b, count(*) AS n FROM l GROUP BY 1, 2",
)
def kmeans_points(spark, d):
    """As many clusters as distinct points: each cluster is one point."""
    ids = clean_listings(spark, d).select((F.col("listing_id") % 2 * 10.0).alias("a"), (F.col("listing_id") % 3 * 10.0).alias("b"))
    placed = GeoKMeans(cols=["a", "b"], k=6, out="c").fit(ids).transform(ids)
    return placed.groupBy("c_cluster").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.count("*").alias("n")).drop("c_cluster")


@query(
    "huber_weights",
    f"WITH {LISTINGS}, t AS MATERIALIZED (SELECT listing_id, area_total AS x, ln(1 + usd_price_syn) AS y FROM l),"
    " e AS (SELECT listing_id, abs(y - (SELECT regr_intercept(y, x) FROM t) - (SELECT regr_slope(y, x) FROM t) * x) AS e FROM t)"
    f" SELECT listing_id, {r('CASE WHEN e <= 0.1 THEN 1.0::DOUBLE ELSE 0.1 / e END')} AS weight FROM e",
)
def huber_weights(spark, d):
    df = clean_listings(spark, d).select("listing_id", "area_total", F.log1p("usd_price_syn").alias("label"))
    points = VectorAssembler(inputCols=["area_total"], outputCol="features").transform(df)
    scored_once = models.ols().fit(points).transform(points)
    weight = models.huber_weight(F.col("label") - F.col("prediction"), 0.1)
    return rounded(scored_once.select("listing_id", weight.alias("weight")))


_SCALED = f"""{LISTINGS}, t AS (SELECT {fold_sql('listing_id')} AS fold, (area_total - 100) / 50 AS x, ln(1 + usd_price_syn) AS y FROM l)"""
_ALPHAS = [1e-4, 0.1, 1.0]


@query(
    "many_ridge_1d",
    f"WITH {_SCALED}, g(config, alpha) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate(_ALPHAS))}),"
    " k AS (SELECT f.fold, config, regr_sxy(y, x) / (regr_sxx(y, x) + any_value(alpha) * count(*)) AS b, avg(y) AS my, avg(x) AS mx"
    " FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold CROSS JOIN g GROUP BY 1, 2),"
    " s AS (SELECT config, fold, sqrt(avg(pow(y - my - b * (x - mx), 2))) AS rmse FROM t JOIN k USING (fold) GROUP BY 1, 2)"
    f" SELECT config::INTEGER AS config, {r('avg(rmse)', 5)} AS rmse_mean, {r('stddev_pop(rmse)', 5)} AS rmse_std FROM s GROUP BY 1",
)
def many_ridge_1d(spark, d):
    """All folds and penalties of a ridge in one job an iteration."""
    df = clean_listings(spark, d).select("listing_id", ((F.col("area_total") - 100) / 50).alias("x"), F.log1p("usd_price_syn").alias("label"))
    points = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")])
    settings = [manylinear.setting(alpha=a) for a in _ALPHAS]
    scores, _, _ = manylinear.search_many(with_fold(df, "listing_id"), points, settings, tol=1e-8)
    rows = [(i, mean, std) for i, (mean, std) in enumerate(scores)]
    return rounded(spark.createDataFrame(rows, "config int, rmse_mean double, rmse_std double"), 5)


@query(
    "quantile_by_flag",
    f"WITH {LISTINGS}, t AS (SELECT (condition IN ('1-URGENT', '2-HIGH'))::INTEGER AS flag, ln(1 + usd_price_syn) AS y FROM l"
    " WHERE condition IS NOT NULL), q AS (SELECT flag, quantile_cont(y, 0.8) AS q FROM t GROUP BY 1)"
    f" SELECT flag, count(*) AS n, {r('avg((y - q) * (0.8 - (y < q)::INTEGER))', 4)} AS loss FROM t JOIN q USING (flag) GROUP BY 1",
)
def quantile_by_flag(spark, d):
    """Check loss of a quantile regression on one flag: that of the groups' own quantiles."""
    df = clean_listings(spark, d).dropna(subset=["condition"])
    df = df.select(F.col("condition").isin("1-URGENT", "2-HIGH").cast("int").alias("flag"), F.log1p("usd_price_syn").alias("label"))
    points = VectorAssembler(inputCols=["flag"], outputCol="features").transform(df).persist()
    left = F.col("label") - F.col("prediction")
    scored = manylinear.QuantileRegression(quantile=0.8).fit(points).transform(points)
    loss = F.avg(left * (F.lit(0.8) - (left < 0).cast("int"))).alias("loss")
    return rounded(scored.groupBy("flag").agg(F.count("*").alias("n"), loss), 4)


@query(
    "boosted_l2_stump",
    f"WITH {LISTINGS}, t AS MATERIALIZED (SELECT rooms AS x, ln(1 + usd_price_syn) AS y FROM l), m AS (SELECT avg(y) AS mu FROM t),"
    " v AS (SELECT x, sum(y - (SELECT mu FROM m)) AS g, count(*) AS n FROM t GROUP BY 1),"
    " c AS (SELECT x, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER () AS gt, sum(n) OVER () AS nt FROM v WINDOW w AS (ORDER BY x)),"
    " b AS (SELECT arg_max(x, gl * gl / (nl + 300) + (gt - gl) * (gt - gl) / (nt - nl + 300)) AS cut FROM c WHERE nl < nt)"
    f" SELECT x <= (SELECT cut FROM b) AS low, count(*) AS n, {r('(SELECT mu FROM m) + 0.5 * sum(y - (SELECT mu FROM m)) / (count(*) + 300)')}"
    " AS prediction FROM t GROUP BY 1",
)
def boosted_l2_stump(spark, d):
    """One round of one split with a leaf penalty: the cut of greatest gain, and shrunken means on both sides."""
    df = clean_listings(spark, d).select("rooms", F.log1p("usd_price_syn").alias("label"))
    stump = histboost.Model("stump", "label", ["rooms"], depth=1, rate=0.5, l2=300.0, rounds=1)
    scored = histboost.boost(df, [stump], ["rooms"], [], [], keep=["rooms"]).scored
    sides = scored.groupBy(F.round("prediction", 9).alias("p")).agg(F.count("*").alias("n"), F.avg("prediction").alias("prediction"), F.max("rooms").alias("most"))
    return rounded(sides.select((F.col("most") == sides.select(F.min("most")).scalar()).alias("low"), "n", "prediction"))


def _place_sql(seed: int, name: str) -> str:
    return f"row_number() OVER (ORDER BY ('0x' || substr(md5('{seed}:' || listing_id), 1, 8))::BIGINT, listing_id) AS {name}"


@query(
    "permuted_columns",
    f"WITH {LISTINGS}, a AS (SELECT listing_id, {_place_sql(0, 'place')} FROM l),"
    f" b AS (SELECT area_total AS area_total_perm, series AS series_perm, {_place_sql(1, 'place')} FROM l)"
    " SELECT listing_id, area_total_perm, series_perm FROM a JOIN b USING (place)",
)
def permuted_columns(spark, d):
    df = clean_listings(spark, d).select("listing_id", "area_total", "series")
    return permute.permuted(df, "listing_id", ["area_total", "series"], slice_rows=1_000).drop("area_total", "series")


_SHUFFLES = 3


@query(
    "permutation_importance",
    f"WITH {LISTINGS}, t AS MATERIALIZED (SELECT listing_id, area_total AS x, ln(1 + usd_price_syn) AS y FROM l),"
    " f AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, var_pop(y) * count(*) AS sst, regr_r2(y, x) AS r2, count(*) AS n FROM t),"
    + ", ".join(
        f" a{i} AS (SELECT x, y, {_place_sql(2 * i, 'place')} FROM t), b{i} AS (SELECT x AS z, {_place_sql(2 * i + 1, 'place')} FROM t),"
        f" d{i} AS (SELECT sum(pow(y - a - b * z, 2) - pow(y - a - b * x, 2)) AS rise FROM a{i} JOIN b{i} USING (place) CROSS JOIN f)"
        for i in range(_SHUFFLES)
    )
    + f", d AS ({' UNION ALL '.join(f'SELECT rise FROM d{i}' for i in range(_SHUFFLES))}),"
    " s AS (SELECT avg(rise / sst) AS r2_drop, stddev_pop(rise / sst) AS r2_drop_std, avg(rise / n) AS mse_rise FROM d CROSS JOIN f)"
    f" SELECT 'area_total' AS feature, n, {r('r2', 5)} AS r2, {r('r2_drop', 5)} AS r2_drop, {r('r2_drop_std', 5)} AS r2_drop_std,"
    f" {r('mse_rise', 5)} AS mse_rise FROM s CROSS JOIN f"
    f" UNION ALL SELECT 'constant', n, {r('r2', 5)}, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM f",
)
def permutation_importance(spark, d):
    """A line on the area beside a constant column, whose score is exactly 0."""
    df = clean_listings(spark, d).select("listing_id", "area_total", F.log1p("usd_price_syn").alias("label"), F.lit(1.0).alias("constant"))
    df = checkpointed(df)  # parsed once for the fit and the shuffles
    line = Pipeline(stages=[VectorAssembler(inputCols=["area_total", "constant"], outputCol="features"), models.ols()]).fit(df)
    return rounded(permute.permutation_importance(line, df, ["area_total", "constant"], "label", "listing_id", repeats=_SHUFFLES), 5)


@query(
    "stored_metrics_delta",
    f"WITH {METRICS_SQL}, x AS (" + " UNION ALL ".join(
        f"SELECT variant, '{m}' AS metric, {m} AS value FROM k" for m in _NAMES
    ) + f") SELECT a.metric, a.value, b.value AS other, {r('a.value - b.value')} AS delta FROM x a JOIN x b"
    " ON a.metric = b.metric AND a.variant = 'series' AND b.variant = 'nothing'",
)
def stored_metrics_delta(spark, d):
    """One run's metrics stored as JSON, read back by another run and compared with its own."""
    table = checkpointed(_metric_table(spark, d))
    path = scratch_path(spark, "metrics")
    write_json_record(spark, table.where("variant = 'nothing'").select(_NAMES).first().asDict(), path)
    own = table.where("variant = 'series'").unpivot([], _NAMES, "metric", "value")
    return rounded(metrics.compare_metrics(own, read_metrics_json(spark, path, _NAMES)))


@query(
    "result_table_roundtrip",
    f"WITH {UNITS} SELECT building_material, series, count(*) AS n, {r('avg(unit)', 4)} AS unit_mean FROM l GROUP BY 1, 2",
)
def result_table_roundtrip(spark, d):
    """A summary written as a table partitioned by material and read back; missing levels stay missing."""
    summary = unit_listings(spark, d).groupBy("building_material", "series").agg(F.count("*").alias("n"), F.avg("unit").alias("unit_mean"))
    path = scratch_path(spark, "summary")
    write_table(rounded(summary, 4), path, ["building_material"])
    return spark.read.schema(summary.schema).parquet(path)


@query(
    "assembled_blocks",
    f"WITH {LISTINGS}, m AS (SELECT avg(area_total) AS ma, stddev_pop(area_total) AS sa, avg(lat) AS ml, stddev_pop(lat) AS sl FROM l),"
    f" b AS (SELECT listing_id, 0 AS position, {r('(area_total - ma) / sa')} AS value FROM l CROSS JOIN m"
    f" UNION ALL SELECT listing_id, 1, {r('(lat - ml) / sl')} FROM l CROSS JOIN m"
    " UNION ALL SELECT listing_id, 2, rooms::DOUBLE FROM l) SELECT * FROM b",
)
def assembled_blocks(spark, d):
    """Two scaled columns and one passed through, side by side in one vector; all other columns are dropped."""
    df = clean_listings(spark, d)
    route = Pipeline(stages=[ZScore(cols=["area_total", "lat"]), VectorAssembler(inputCols=["area_total_z", "lat_z", "rooms"], outputCol="features")])
    vectors = route.fit(df).transform(df).select("listing_id", vector_to_array("features").alias("v"))
    return rounded(vectors.select("listing_id", F.posexplode("v").alias("position", "value")))
