import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quartier.operators import filters, groupings, profile
from quartier.operators.folds import with_fold
from quartier.operators.impute import GroupMedianImputer, missing_report, mode_smallest
from quartier.plans.prepare import fit_preparation
from quartier.session import scratch_path
from quartier.sources import tables
from quartier.sources.listings import clean_listings


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_imputer_learns_from_all_rows_and_applies_unchanged(spark):
    schema = "m string, y double, c string, f double"
    train = spark.createDataFrame(
        [("a", 10.0, "p", 1.0), ("a", 20.0, "q", None), ("b", None, "q", 1.0), (None, 99.0, "p", 1.0)], schema
    )
    model = GroupMedianImputer(
        col="y", by="m", mode_cols=["c"], drop_na=["f"], flag=("old", 50)
    ).fit(train)
    other = spark.createDataFrame(
        [("a", None, None, 1.0), ("b", None, "z", 1.0), ("new", None, None, 1.0), ("a", 1.0, "z", None)], schema
    )
    assert rows(model.transform(other)) == rows(
        spark.createDataFrame(
            [("a", 15.0, "p", 1.0, 1), ("b", 20.0, "z", 1.0, 1), ("new", 20.0, "p", 1.0, 1)], f"{schema}, old int"
        )
    )


def test_mode_prefers_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert mode_smallest(df, ["c"]).first()["mode"] == "a"


def test_missing_report_marks_columns(spark):
    before = spark.createDataFrame([(1, None, 2)], "a int, gone int, full int")
    after = spark.createDataFrame([(None, 2, 3)], "a int, full int, fresh int")
    got = {r["column"]: (r["before"], r["after"], r["status"]) for r in missing_report(before, after).collect()}
    assert got == {"a": (0, 1, "kept"), "gone": (1, None, "dropped"), "fresh": (None, 0, "added")}


def test_tercile_groups_of_published_medians(spark):
    # Rounded series medians that lie clear of the cuts, with their published groups.
    published = {
        "107": (1090, "low"), "106u": (1301, "low"), "105u": (1346, "low"), "108": (1400, "low"), "elite": (1404, "low"),
        "small": (1438, "mid"), "own": (1450, "mid"), "stalin": (1515, "mid"), "104u": (1528, "mid"),
        "106": (1538.5, "high"), "pent": (1546, "high"), "khr": (1567, "high"), "105": (1583, "high"), "104": (1585, "high"),
    }
    df = spark.createDataFrame([(k, float(v)) for k, (v, _) in published.items()], "s string, v double")
    model = groupings.TercileGrouper(category="s", value="v").fit(df)
    assert {r["s"]: r["group"] for r in model.levels(df).collect()} == {k: g for k, (_, g) in published.items()}
    unseen = spark.createDataFrame([("new",), (None,), ("107",)], "s string")
    assert sorted(r["s_group"] for r in model.transform(unseen).collect()) == ["low", "mid", "mid"]


def test_group_table_keeps_empty_groups(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0)], "s string, v double")
    table = groupings.TercileGrouper(category="s", value="v").fit(df).group_table(df)
    assert {r["group"]: (r["count"], r["median"]) for r in table.collect()} == {
        "low": (2, 2.0), "mid": (0, None), "high": (0, None)
    }


def test_delimited_missing_tokens_and_bad_numbers(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("n,s",), ("1.5,x",), ("NA,N/A",), ("nan,\"a,b\"",), (",",)], "v string").coalesce(1).write.text(path)
    df = tables.read_delimited(spark, path, spark.createDataFrame([], "n double, s string").schema)
    assert rows(df) == rows(spark.createDataFrame([(1.5, "x"), (None, None), (None, "a,b"), (None, None)], df.schema))
    bad = scratch_path(spark, "csv")
    spark.createDataFrame([("n",), ("12x",)], "v string").coalesce(1).write.text(bad)
    with pytest.raises(Exception):
        tables.read_delimited(spark, bad, spark.createDataFrame([], "n double").schema).collect()


def test_trim_is_pushed_to_the_scan(spark, sf_dir):
    df = tables.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    plan = filters.trim_quantile(df, "l_extendedprice")._jdf.queryExecution().executedPlan().toString()
    assert all(f"{op}ThanOrEqual(l_ext" in plan for op in ("Greater", "Less"))


def test_aligned_merge_refuses_mismatches(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, p double")
    b = spark.createDataFrame([(1, 5.0, "x"), (2, 7.0, "y")], "k int, p double, c string")
    with pytest.raises(ValueError):
        filters.aligned_merge(a, b, "k", "p", ["c"])
    with pytest.raises(ValueError):
        filters.aligned_merge(a, b.where("k = 1"), "k", "p", ["c"])


def test_aligned_merge_refuses_repeated_and_null_keys(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k int, p double")
    b = spark.createDataFrame([(1, 5.0, "x"), (1, 5.0, "y")], "k int, p double, c string")
    for left, right in ((a, b), (a.limit(1), b), (a, b.limit(1)), (a.withColumn("k", F.lit(None).cast("int")), b)):
        with pytest.raises(ValueError):
            filters.aligned_merge(left, right, "k", "p", ["c"])
    assert filters.aligned_merge(a.limit(1), b.limit(1), "k", "p", ["c"]).columns == ["k", "p", "c"]


def test_mode_compares_numbers_as_numbers(spark):
    df = spark.createDataFrame([(9, "9"), (10, "10")], "n int, s string")
    assert {r["feature"]: r["mode"] for r in mode_smallest(df, ["n", "s"]).collect()} == {"n": "9", "s": "10"}


def test_delimited_keeps_line_breaks_and_backslashes(spark):
    df = spark.createDataFrame([(1, 'a\nb\r\n"c", d'), (2, "\\n \\s\\"), (3, " "), (4, None)], "k int, s string")
    path = scratch_path(spark, "csv")
    tables.write_delimited(df, path)
    assert rows(tables.read_delimited(spark, path, df.schema, escaped=True)) == rows(df)
    foreign = scratch_path(spark, "csv")
    spark.createDataFrame([('k,s\n1,"a\nb"\n2,c\\n',)], "v string").coalesce(1).write.text(foreign)
    got = tables.read_delimited(spark, foreign, df.schema, multi_line=True)
    assert rows(got) == [(1, "a\nb"), (2, "c\\n")]


def test_saved_step_holds_its_tables(spark, monkeypatch):
    """A state above the inline limit is loaded after its scratch folder is gone."""
    from quartier.operators import lookup

    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame([(f"g{k % 9}", float(k)) for k in range(90)], "g string, v double")
    model = GroupMedianImputer(col="v", by="g").fit(df)
    scratch = model.state["groups"]["path"]
    path = scratch_path(spark, "imputer")
    model.write().overwrite().save(path)
    want = rows(model.transform(df.withColumn("v", F.lit(None).cast("double"))))
    spark.read.parquet(scratch).limit(0).write.mode("overwrite").parquet(scratch)
    loaded = type(model).load(path)
    assert loaded.state["groups"]["path"] != scratch
    assert rows(loaded.transform(df.withColumn("v", F.lit(None).cast("double")))) == want


def test_screen_keeps_its_medians(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 50.0), (None, 90.0)], "c string, unit double")
    assert groupings.weak_features(df, ["c", "absent"], "unit", 30).first()["medians"] == {"a": 2.0, "b": 50.0}
    spread = groupings.median_spread(df, ["c"], "unit", "missing").first()
    assert (spread["top"], spread["bottom"], spread["spread"]) == ("missing", "a", 88.0)


def test_folds_cover_every_row_once_and_keep_groups(spark, sf_dir):
    events = with_fold(tables.read_table(spark, sf_dir, "events"), "event_id", 5, group="user_id")
    assert events.groupBy("user_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r["fold"] for r in events.select("fold").distinct().collect()} <= set(range(5))


def test_preparation_saves_loads_and_screens(spark, sf_dir):
    df = clean_listings(spark, sf_dir)
    model = fit_preparation(df, price="usd_price_syn", keep_rich=False)
    path = scratch_path(spark, "preparation")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert rows(loaded.transform(df)) == rows(model.transform(df))
    assert "series" not in loaded.transform(df).columns and "series_group" in loaded.transform(df).columns


def test_constant_single_and_empty_inputs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    summary = {r["value"]: r for r in profile.grouped_summary(df, ["g"], "v").collect()}
    assert summary["b"]["std"] is None and summary["a"]["std"] == 0
    moments = profile.moments(df, ["v"]).first()
    assert moments["skew"] is None and moments["kurt"] is None
    flat = df.withColumn("w", F.monotonically_increasing_id().cast("double"))
    lines = profile.linearity(flat, ["v"], "w").first()
    assert lines["pearson"] is None and lines["spearman"] is None
    assert profile.vif(flat, ["v", "w"]).where("vif is not null").count() == 0
    assert filters.ZScore(cols=["v"]).fit(df).transform(df).agg(F.max(F.abs("v_z"))).first()[0] == 0
    assert filters.trim_quantile(df.limit(0), "v").count() == 0


def test_f_tail():
    # Upper tails of the F distribution with closed forms for d1 = 2.
    for f, d2 in ((4.0, 10), (0.5, 7), (300.0, 2000)):
        exact = (1 + 2 * f / d2) ** (-d2 / 2)
        assert profile.f_upper_tail(f, 2, d2) == pytest.approx(exact, rel=1e-10)
    assert 0 < profile.f_upper_tail(136.8, 4, 6500) < 1e-100
