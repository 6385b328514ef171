"""Dimensions are computed once, and their size is proven without gathering them in one task."""

from pyspark.sql import functions as F

from quartier.operators import lookup as L


def test_a_large_table_is_refused_without_a_shuffle_into_one_task(spark):
    df = spark.range(0, 400_000, numPartitions=20).withColumn("v", F.col("id") * 2)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bounded", "bounded")
    assert L.bounded(df, 1_000) is None
    spark.sparkContext.setJobGroup("other", "other")
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("bounded") for s in tracker.getJobInfo(j).stageIds]
    assert stages and all(s.numTasks == 1 and s.name.startswith("collect") for s in stages if s)


def test_the_dimension_runs_once(spark, monkeypatch):
    for limit in (10, 50_000):
        monkeypatch.setattr(L, "BROADCAST_ROWS", limit)
        runs = spark.sparkContext.accumulator(0)

        def count(rows):
            for batch in rows:
                runs.add(batch.num_rows)
                yield batch

        dim = spark.range(0, 300, numPartitions=4).withColumn("w", F.col("id") + 1).mapInArrow(count, "id long, w long")
        got = L.lookup(spark.range(0, 600), dim, ["id"])
        assert got.where("w = id + 1").count() == 300 and got.where("w is null").count() == 300
        assert runs.value == 300


def test_bounded_keeps_small_tables(spark):
    df = spark.createDataFrame([(1, "x", [1.5]), (None, None, None)], "a int, b string, c array<double>")
    assert sorted(map(str, L.bounded(df, 2).collect())) == sorted(map(str, df.collect()))
    assert L.bounded(df, 1) is None and L.bounded(df.limit(0), 0).count() == 0
