"""Queries on folds and category encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.operators import encode
from quartier.operators.folds import with_fold
from quartier.plans.catalog.registry import LISTINGS, fold_sql, query, r, rounded
from quartier.sources.listings import clean_listings
from quartier.sources.tables import read_table


@query("kfold_assign", f"SELECT o_orderkey, {fold_sql('o_orderkey')} AS fold FROM orders")
def kfold_assign(spark, d):
    return with_fold(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("group_kfold_assign", f"SELECT event_id, user_id, {fold_sql('user_id', 5, 7)} AS fold FROM events")
def group_kfold_assign(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id")
    return with_fold(events, "event_id", 5, 7, group="user_id")


_ONEHOT = ["series", "building_material"]


@query(
    "onehot_long",
    f"WITH {LISTINGS}, f AS (SELECT *, {fold_sql('listing_id')} AS fold FROM l), u AS ("
    + " UNION ALL ".join(
        f"SELECT listing_id, fold, '{c}' AS feature, coalesce({c}, 'MISSING') AS level FROM f" for c in _ONEHOT
    )
    + "), k AS (SELECT DISTINCT feature, level FROM u WHERE fold <> 0)"
    " SELECT listing_id, feature, level, 1 AS value FROM u JOIN k USING (feature, level) WHERE fold = 0",
)
def onehot_long(spark, d):
    df = with_fold(clean_listings(spark, d).select("listing_id", *_ONEHOT), "listing_id")
    model = encode.OneHotLong(key="listing_id", cols=_ONEHOT).fit(df.where("fold <> 0"))
    return model.transform(df.where("fold = 0"))


@query(
    "dummies",
    f"WITH {LISTINGS} SELECT listing_id, " + ", ".join(
        f"coalesce((building_material = '{m}')::INTEGER::DOUBLE, 0.0::DOUBLE) AS \"building_material_{m}\""
        for m in ("кирпичный", "монолитный", "панельный")
    ) + " FROM l",
)
def dummies(spark, d):
    df = clean_listings(spark, d).select("listing_id", "building_material")
    return encode.dummies(df, "building_material").drop("building_material")


_OOF = """sums AS (SELECT event_type, fold, sum(value) AS s, count(value) AS n FROM e GROUP BY 1, 2),
p AS (SELECT event_type, fold, (sum(s) OVER (PARTITION BY event_type) - s)
        / nullif(sum(n) OVER (PARTITION BY event_type) - n, 0) AS m FROM sums)"""


@query(
    "oof_target_mean",
    f"WITH e AS (SELECT event_id, event_type, value, {fold_sql('event_id')} AS fold FROM events), {_OOF}"
    f" SELECT event_id, fold, {r('m')} AS type_mean FROM e JOIN p USING (event_type, fold)",
)
def oof_target_mean(spark, d):
    events = with_fold(read_table(spark, d, "events").select("event_id", "event_type", "value"), "event_id")
    found = encode.oof_target_mean(events, ["event_type"], "value", "fold", "type_mean")
    return rounded(found.select("event_id", "fold", "type_mean"))


@query(
    "oof_group_mean",
    f"WITH e AS (SELECT event_id, event_type, value, {fold_sql('user_id')} AS fold FROM events), {_OOF}"
    f" SELECT fold, count(*) AS n, {r('sqrt(avg(pow(value - m, 2)))')} AS rmse FROM e JOIN p USING (event_type, fold)"
    " GROUP BY 1",
)
def oof_group_mean(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    folded = with_fold(events, "event_id", group="user_id")
    found = encode.oof_target_mean(folded, ["event_type"], "value", "fold", "prediction")
    error = F.col("value") - F.col("prediction")
    return rounded(found.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse")))


@query(
    "ordered_target_stat",
    """WITH e AS (SELECT event_id, event_type, value, ('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT AS h FROM events),
w AS (SELECT *, coalesce(sum(value) OVER o, 0) AS s, count(value) OVER o AS n FROM e
 WINDOW o AS (PARTITION BY event_type ORDER BY h, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
    f"SELECT event_id, {r('(s + 7.3::DOUBLE * (SELECT avg(value) FROM events)) / (n + 7.3::DOUBLE)', 9)} AS stat FROM w",
)
def ordered_target_stat(spark, d):
    events = read_table(spark, d, "events").select("event_id", "event_type", "value")
    stat = encode.ordered_target_stat(events, "event_type", "value", "event_id", 7.3, "stat")
    return rounded(stat.select("event_id", "stat"), 9)


_ORDERED = "e AS (SELECT event_id, event_type, value, {fold} AS fold, ('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT AS h FROM events)"
_BEFORE = "OVER (PARTITION BY event_type ORDER BY h, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _fold_stat_sql(f: int) -> str:
    """The statistic of the model that leaves fold ``f`` out: before the row if it trains, else over all that train."""
    train = f"FILTER (WHERE fold <> {f})"
    mean = f"(SELECT avg(value) FROM e WHERE fold <> {f})"
    parts = [
        f"(coalesce(sum(value) {train} {over}, 0) + 7.3::DOUBLE * {mean}) / (count(value) {train} {over} + 7.3::DOUBLE)"
        for over in (_BEFORE, "OVER (PARTITION BY event_type)")
    ]
    return f"{r(f'CASE WHEN fold <> {f} THEN {parts[0]} ELSE {parts[1]} END', 8)} AS stat_{f}"


@query(
    "ordered_fold_stats",
    f"WITH {_ORDERED.format(fold=fold_sql('event_id'))} SELECT event_id, fold, {', '.join(_fold_stat_sql(f) for f in range(5))} FROM e",
)
def ordered_fold_stats(spark, d):
    events = with_fold(read_table(spark, d, "events").select("event_id", "event_type", "value"), "event_id")
    stats = encode.ordered_fold_stats(events, "event_type", "value", "event_id", 7.3, "stat", "fold", 5)
    return rounded(stats.drop("event_type", "value"), 8)


@query(
    "ordered_target_stage",
    f"WITH {_ORDERED.format(fold=fold_sql('event_id'))} SELECT event_id, fold <> 0 AS training, "
    f"{_fold_stat_sql(0)[: -len('stat_0')]}stat FROM e",
)
def ordered_target_stage(spark, d):
    """The stage fitted on four folds: running means for them, means of their levels for the fifth."""
    events = with_fold(read_table(spark, d, "events").select("event_id", "event_type", "value"), "event_id")
    events = events.withColumn("training", F.col("fold") != 0)
    stage = encode.OrderedTarget(col="event_type", y="value", key="event_id", prior_weight=7.3, out="stat")
    return rounded(stage.fit(events).transform(events).select("event_id", "training", "stat"), 8)
