"""Statistics evaluate their input once, whatever joins stand behind it, and n-grams are cut from counted words."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quartier.functions.text import char_wb
from quartier.operators.evaluate import grid_search
from quartier.operators.groupings import category_order
from quartier.operators.impute import GroupMedianImputer
from quartier.operators.models import Ridge
from quartier.operators.quantiles import quantiles
from quartier.operators.textfeatures import char_counts

ROWS = [(f"g{i % 4}" if i % 7 else None, float(i * 37 % 101) if i % 5 else None, f"m{i % 3}") for i in range(200)]
TEXTS = [(1, "Aa bcd bcd"), (1, "Aa bcd bcd"), (2, None), (None, "bcd İx  e"), (3, ""), (4, "  aa\tlongerword aa")]


@pytest.fixture
def watched(spark):
    """A table, and the number of times that its rows were evaluated."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(ROWS, "g string, v double, m string")
    return df.mapInArrow(count, df.schema), seen


def test_imputer_fit_reads_its_input_once(watched, spread_path):
    df, seen = watched
    model = GroupMedianImputer(col="v", by="g", mode_cols=["m"]).fit(df)
    assert seen.value == len(ROWS)
    assert model.state["global"] == pytest.approx(np.median([v for _, v, _ in ROWS if v is not None]))


def test_category_order_reads_its_input_once(watched, spread_path):
    df, seen = watched
    got = {r["g"]: (r["median"], r["position"]) for r in category_order(df, "g", "v", exact_rows=0).collect()}
    assert seen.value == len(ROWS)
    medians = {g: np.median([v for k, v, _ in ROWS if k == g and v is not None]) for g in ("g0", "g1", "g2", "g3")}
    assert got == {g: (m, 1 + sum(o < m for o in medians.values())) for g, m in medians.items()}


def test_quantiles_by_rank_store_values_and_send_no_cuts_along(watched, spread_path):
    df, seen = watched
    q = quantiles(df, "v", [0.1, 0.5], ["g"], exact_rows=0)
    got = {r["g"]: r["q"] for r in q.collect()}
    assert seen.value == 3 * len(ROWS)  # the count, the stored values, the groups
    assert "NestedLoop" not in q._jdf.queryExecution().executedPlan().toString()
    for g, found in got.items():
        assert found == pytest.approx(np.quantile([v for k, v, _ in ROWS if k == g and v is not None], [0.1, 0.5]).tolist())


def test_char_counts_cut_each_distinct_word_once(spark):
    df = spark.createDataFrame(TEXTS, "k int, t string")
    counted = char_counts(df, "t", 3, 5)
    plain = df.select(F.explode(char_wb(F.col("t"), 3, 5)).alias("gram")).groupBy("gram").agg(F.count("*").alias("tf"))
    assert sorted(counted.collect()) == sorted(plain.collect())
    assert char_counts(df.where("k = 3"), "t", 3, 5).count() == 0


def test_grid_search_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(float(i), 2.0 * i + i % 3, i % 2) for i in range(40)], "x double, label double, fold int")
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.mapInArrow(count, rows.schema))
    ridge = Ridge()
    table, model = grid_search(points, ridge, [{ridge.alpha: a} for a in (0.5, 500.0)], "label", k=2)
    assert seen.value == 40
    assert table.count() == 2 and model.coefficients[0] == pytest.approx(2.0, abs=0.1)
