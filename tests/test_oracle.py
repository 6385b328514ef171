"""Every query with a SQL twin agrees with DuckDB, also on the paths for large inputs."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLE = queries(), oracle_sql()

# Queries whose operators switch to another plan beyond a size.
SPREAD = [
    "quantiles", "global_median", "median_by_group", "box_stats_by_group", "qq_points", "trim_quantile",
    "zone_summary", "grouped_summary_sets", "tercile_groups", "category_order", "spearman_gap",
    "impute_apply", "apply_groups", "oof_target_mean", "tfidf_vocab", "onehot_long", "rare_level_merge",
    "density_by_group", "reg_metrics",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLE[name], con) is None


@pytest.mark.parametrize("name", SPREAD)
def test_matches_sql_on_spread_path(spark, sf_dir, con, name, spread_path):
    assert compare(QUERIES[name](spark, sf_dir), ORACLE[name], con) is None


def test_entry(spark):
    rows = {r["group"]: r["count"] for r in entry(spark).collect()}
    assert set(rows) == {"low", "mid", "high"} and sum(rows.values()) > 0
