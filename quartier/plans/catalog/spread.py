"""The same results by the plans for large inputs: sketched buckets and prefix sums from 1,000 rows on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.operators import chartdata, groupings, profile
from quartier.operators.quantiles import median, quantiles
from quartier.plans.catalog.profiling import NUMBERS
from quartier.plans.catalog.registry import ORACLE, query, rounded, unit_lines, unit_listings
from quartier.sources.listings import clean_listings
from quartier.sources.tables import read_table

ROWS = 1_000


@query("quantiles_spread", ORACLE["quantiles"])
def quantiles_spread(spark, d):
    q = quantiles(read_table(spark, d, "lineitem"), "l_extendedprice", [0.01, 0.05, 0.5, 0.95, 0.99], exact_rows=ROWS)
    return rounded(q.select(*[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(5)]))


@query("median_by_group_spread", ORACLE["median_by_group"])
def median_by_group_spread(spark, d):
    return rounded(median(unit_lines(spark, d), "unit", ["l_returnflag", "l_linestatus"], exact_rows=ROWS))


@query("box_stats_by_group_spread", ORACLE["box_stats_by_group"])
def box_stats_by_group_spread(spark, d):
    return rounded(chartdata.box_stats(unit_lines(spark, d), "unit", ["l_returnflag"], exact_rows=ROWS))


@query("spearman_gap_spread", ORACLE["spearman_gap"])
def spearman_gap_spread(spark, d):
    df = clean_listings(spark, d).withColumn("log_price", F.log1p("usd_price_syn"))
    return rounded(profile.linearity(df, NUMBERS, "log_price", exact_rows=ROWS))


@query("category_order_spread", ORACLE["category_order"])
def category_order_spread(spark, d):
    return rounded(groupings.category_order(unit_listings(spark, d), "series", "unit", exact_rows=ROWS))
