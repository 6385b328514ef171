"""Queries on profiling: medians, quantiles, summaries, moments, correlation, variance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.operators import groupings, profile
from quartier.operators.quantiles import median, quantiles
from quartier.plans.catalog.registry import (
    LISTINGS, UNITS, query, r, rounded, unit_lines, unit_listings,
)
from quartier.session import checkpointed
from quartier.sources.listings import clean_listings
from quartier.sources.tables import read_table

CATS = ["offer_type", "series", "building_material", "condition"]
NUMBERS = ["build_year", "floor", "total_floors", "rooms", "area_total", "lat", "lon"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("global_median", "SELECT median(l_extendedprice) AS median FROM lineitem")
def global_median(spark, d):
    return median(read_table(spark, d, "lineitem"), "l_extendedprice")


@query(
    "median_by_group",
    f"SELECT l_returnflag, l_linestatus, {r('median(l_extendedprice / nullif(l_quantity, 0))')} AS median"
    " FROM lineitem GROUP BY 1, 2",
)
def median_by_group(spark, d):
    return rounded(median(unit_lines(spark, d), "unit", ["l_returnflag", "l_linestatus"]))


@query(
    "quantiles",
    "SELECT " + ", ".join(
        f"{r(f'quantile_cont(l_extendedprice, {p})')} AS q{i}" for i, p in enumerate((0.01, 0.05, 0.5, 0.95, 0.99))
    ) + " FROM lineitem",
)
def quantile_row(spark, d):
    q = quantiles(read_table(spark, d, "lineitem"), "l_extendedprice", [0.01, 0.05, 0.5, 0.95, 0.99])
    return rounded(q.select(*[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(5)]))


def _level_medians_sql(cols: list[str], table: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::VARCHAR AS level, median({value}) AS m FROM {table}"
        f" WHERE {c} IS NOT NULL GROUP BY 2" for c in cols
    )


@query(
    "median_spread_argmax",
    f"WITH {UNITS}, m AS ({_level_medians_sql(CATS, 'l', 'unit')}),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY m DESC, level) AS hi,"
    " row_number() OVER (PARTITION BY feature ORDER BY m, level) AS lo FROM m)"
    f" SELECT feature, {r('min(m)')} AS median_min, {r('max(m)')} AS median_max, {r('max(m) - min(m)')} AS spread,"
    " max(CASE WHEN hi = 1 THEN level END) AS top, max(CASE WHEN lo = 1 THEN level END) AS bottom FROM k GROUP BY 1",
)
def median_spread_argmax(spark, d):
    return rounded(groupings.median_spread(unit_listings(spark, d), CATS, "unit"))


@query(
    "median_spread_trimmed",
    f"WITH {UNITS}, q AS (SELECT quantile_cont(unit, 0.99) AS hi FROM l),"
    f" t AS (SELECT * REPLACE ({', '.join(f"coalesce({c}::VARCHAR, 'missing') AS {c}" for c in CATS)})"
    f" FROM l CROSS JOIN q WHERE unit < hi), m AS ({_level_medians_sql(CATS, 't', 'unit')}),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY m DESC, level) AS hi,"
    " row_number() OVER (PARTITION BY feature ORDER BY m, level) AS lo FROM m)"
    f" SELECT feature, {r('min(m)')} AS median_min, {r('max(m)')} AS median_max, {r('max(m) - min(m)')} AS spread,"
    " max(CASE WHEN hi = 1 THEN level END) AS top, max(CASE WHEN lo = 1 THEN level END) AS bottom FROM k GROUP BY 1",
)
def median_spread_trimmed(spark, d):
    """Missing values as a level of their own, rows from the 0.99 quantile on left out."""
    return rounded(groupings.median_spread(unit_listings(spark, d), CATS, "unit", "missing", 0.99))


@query(
    "category_order",
    f"WITH {UNITS}, m AS (SELECT series, median(unit) AS m FROM l WHERE series IS NOT NULL GROUP BY 1)"
    f" SELECT series, {r('m')} AS median, rank() OVER (ORDER BY m) AS position FROM m",
)
def category_order(spark, d):
    return rounded(groupings.category_order(unit_listings(spark, d), "series", "unit"))


@query(
    "grouped_summary_sets",
    f"WITH {UNITS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce({c}, 'MISSING') AS value, count(unit) AS count,"
        f" {r('median(unit)', 4)} AS median, {r('avg(unit)', 4)} AS mean, {r('stddev_samp(unit)', 4)} AS std"
        f" FROM l WHERE unit IS NOT NULL GROUP BY 2" for c in CATS
    ),
)
def grouped_summary_sets(spark, d):
    return rounded(profile.grouped_summary(unit_listings(spark, d), CATS, "unit", digits=None), 4)


def _imbalance_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, count(*) AS n_categories,
 arg_min(v, row(-n, v)) AS top_value, round_even(max(n) / sum(n), 3) AS top_share, min(n) AS min_count,
 round_even((SELECT count(*) FROM l WHERE {c} IS NULL) * 100 / sum(n), 1) AS missing_pct
 FROM (SELECT coalesce({c}, 'MISSING') AS v, count(*) AS n FROM l GROUP BY 1)"""


@query("category_imbalance", f"WITH {LISTINGS} " + " UNION ALL ".join(_imbalance_sql(c) for c in CATS))
def category_imbalance(spark, d):
    return profile.category_imbalance(clean_listings(spark, d), CATS)


@query("value_counts", f"WITH {LISTINGS} SELECT coalesce(condition, 'MISSING') AS condition, count(*) AS count"
       " FROM l GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(clean_listings(spark, d), "condition")


def _moments_sql(c: str, table: str) -> str:
    return f"""SELECT '{c}' AS feature,
 {r(f"avg(pow({c} - mu, 3)) / nullif(pow(avg(pow({c} - mu, 2)), 1.5), 0)", 5)} AS skew,
 {r(f"avg(pow({c} - mu, 4)) / nullif(pow(avg(pow({c} - mu, 2)), 2), 0) - 3", 5)} AS kurt,
 count(*) - count({c}) AS n_missing
 FROM {table} CROSS JOIN (SELECT avg({c}) AS mu FROM {table})"""


@query("moments_profile", f"WITH {LISTINGS} " + " UNION ALL ".join(
    _moments_sql(c, "l") for c in ("build_year", "floor", "area_total", "area_living", "usd_price")))
def moments_profile(spark, d):
    cols = ["build_year", "floor", "area_total", "area_living", "usd_price"]
    return rounded(profile.moments(clean_listings(spark, d), cols), 5)


@query("pearson_target", f"WITH {LISTINGS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'corr({c}, ln(1 + usd_price_syn))')} AS pearson FROM l" for c in NUMBERS))
def pearson_target(spark, d):
    df = clean_listings(spark, d).withColumn("log_price", F.log1p("usd_price_syn"))
    return rounded(profile.pearson(df, NUMBERS, "log_price"))


def _spearman_sql(c: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    both = f"WHERE {c} IS NOT NULL AND y IS NOT NULL"
    return (
        f"SELECT '{c}' AS feature, corr({c}, y) AS pearson, corr(rx::DOUBLE, ry::DOUBLE) AS spearman FROM"
        f" (SELECT {c}, y, {rank.format(c)} AS rx, {rank.format('y')} AS ry FROM t {both})"
    )


@query(
    "spearman_gap",
    f"WITH {LISTINGS}, t AS (SELECT *, ln(1 + usd_price_syn) AS y FROM l),"
    f" s AS ({' UNION ALL '.join(_spearman_sql(c) for c in NUMBERS)})"
    f" SELECT feature, {r('pearson')} AS pearson, {r('spearman')} AS spearman,"
    f" {r('abs(spearman) - abs(pearson)')} AS gap FROM s",
)
def spearman_gap(spark, d):
    df = clean_listings(spark, d).select(*NUMBERS, F.log1p("usd_price_syn").alias("log_price"))
    return rounded(profile.linearity(checkpointed(df), NUMBERS, "log_price"))  # parsed once for all passes


@query("corr_matrix_long", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr FROM lineitem"
    for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i:]))
def corr_matrix_long(spark, d):
    return rounded(profile.corr_matrix(read_table(spark, d, "lineitem"), LINE_NUMBERS))


@query(
    "vif",
    f"""WITH {LISTINGS}, c AS (SELECT corr(floor, total_floors) AS ab, corr(floor, area_total) AS ac,
 corr(total_floors, area_total) AS bc FROM l WHERE floor IS NOT NULL AND total_floors IS NOT NULL
 AND area_total IS NOT NULL), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM c)
SELECT 'floor' AS feature, {r('(1 - bc * bc) / det')} AS vif FROM d
UNION ALL SELECT 'total_floors', {r('(1 - ac * ac) / det')} FROM d
UNION ALL SELECT 'area_total', {r('(1 - ab * ab) / det')} FROM d""",
)
def vif(spark, d):
    return rounded(profile.vif(clean_listings(spark, d), ["floor", "total_floors", "area_total"]))


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within,
 {r('(ssb / (k - 1)) / (ssw / (n - k))')} AS f FROM (
 SELECT count(*) AS k, sum(g.n)::BIGINT AS n, sum(g.n * pow(g.m - (SELECT avg(y) FROM t WHERE {c} IS NOT NULL), 2)) AS ssb,
 sum(g.n * g.v) AS ssw FROM (SELECT {c}, count(y) AS n, avg(y) AS m, var_pop(y) AS v FROM t
 WHERE {c} IS NOT NULL GROUP BY 1) g)"""


@query("anova_f", f"WITH {LISTINGS}, t AS (SELECT *, ln(1 + usd_price_syn) AS y FROM l) "
       + " UNION ALL ".join(_anova_sql(c) for c in CATS))
def anova_f(spark, d):
    df = clean_listings(spark, d).withColumn("y", F.log1p("usd_price_syn"))
    return rounded(profile.anova(df, CATS, "y").drop("p"))


@query(
    "anova_p_three_levels",
    f"WITH {LISTINGS}, t AS (SELECT *, ln(1 + usd_price_syn) AS y FROM l), a AS ({_anova_sql('building_material')})"
    " SELECT feature, floor(pow(1 + 2 * f / df_within, -df_within / 2.0) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS p FROM a WHERE df_between = 2",
)
def anova_p_three_levels(spark, d):
    """With two degrees of freedom between groups the tail has a closed form."""
    df = clean_listings(spark, d).withColumn("y", F.log1p("usd_price_syn"))
    return rounded(profile.anova(df, ["building_material"], "y").where("df_between = 2").select("feature", "p"))


@query("anova_p")
def anova_p(spark, d):
    df = clean_listings(spark, d).withColumn("y", F.log1p("usd_price_syn"))
    return profile.anova(df, CATS, "y")
