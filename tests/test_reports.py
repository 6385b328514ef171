import json

import pytest
from pyspark.sql import functions as F

from quartier.functions.exprs import ratio, shortened
from quartier.operators import chartdata, metrics
from quartier.operators.textfeatures import hashed_ngrams
from quartier.plans.profile import profile_reports
from quartier.session import scratch_path
from quartier.sources import tables
from quartier.sources.listings import clean_listings


def test_metric_records_are_stored_and_compared(spark):
    path = scratch_path(spark, "metrics")
    tables.write_json_record(spark, {"log_r2": 0.8666, "log_rmse": 0.1869}, path)
    stored = tables.read_metrics_json(spark, path, ["log_r2", "log_rmse"])
    new = spark.createDataFrame([("log_r2", 0.8711), ("log_rmse", 0.1837)], "metric string, value double")
    got = {r["metric"]: r["delta"] for r in metrics.compare_metrics(new, stored).collect()}
    assert got == pytest.approx({"log_r2": 0.0045, "log_rmse": -0.0032})


def test_published_variant_deltas(spark):
    # Published log R2 of two variants and their published difference to the baseline.
    df = spark.createDataFrame([("none", 0.8666), ("tree_num_kmeans", 0.8711)], "variant string, log_r2 double")
    delta = metrics.variant_delta(df, "variant", "none", ["log_r2"])
    got = {r["variant"]: r["delta"] for r in delta.collect()}
    assert got == pytest.approx({"none": 0.0, "tree_num_kmeans": 0.0045})
    text = tables.metrics_json(df, "variant", ["log_r2"]).first()["json"]
    assert json.loads(text) == {"none": {"log_r2": 0.8666}, "tree_num_kmeans": {"log_r2": 0.8711}}


def test_state_roundtrip(spark):
    state = spark.createDataFrame([({"a": 1.5}, ["x"], None)], "m map<string,double>, l array<string>, q double")
    assert tables.stored_state(state, "state").collect() == state.collect()


def test_profile_reports_all_run(spark, sf_dir):
    df = clean_listings(spark, sf_dir).withColumn("unit", ratio(F.col("usd_price"), F.col("area_total"))).persist()
    reports = profile_reports(
        df, ["floor", "area_total"], ["series", "condition"], "usd_price", "unit", "lat", "lon", clusters=3
    )
    sizes = {name: build().count() for name, build in reports.items()}
    df.unpersist()
    assert sizes["price_histogram"] == 80 and sizes["price_qq"] == 99 and sizes["geo_spread"] == 1
    assert all(n > 0 for n in sizes.values())


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    counts = [r["count"] for r in chartdata.histogram(df, "v", 4).orderBy("bin").collect()]
    assert sum(counts) == 2 and counts[2] == 2
    assert chartdata.histogram(df.limit(0), "v", 4).agg(F.sum("count")).first()[0] == 0


def test_box_of_one_row_and_short_text(spark):
    row = chartdata.box_stats(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert (row["q1"], row["whisker_low"], row["whisker_high"], row["outliers"]) == (2.0, 2.0, 2.0, 0)
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string")
    assert [r["s"] for r in df.select(shortened(F.col("t"), 3).alias("s")).collect()] == ["abc…", "abc", None]


def test_hashing_shuffles_the_text_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = hashed_ngrams(docs, "doc_id", "text", 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
