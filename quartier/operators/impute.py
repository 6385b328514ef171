"""Fit/apply imputation: group medians, global median, smallest mode, threshold flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions.exprs import flag
from quartier.operators.quantiles import median, scalar_quantiles, value_count
from quartier.operators.state import FitStep, FittedStep, keep_table, kept_table, lookup_kept
from quartier.sources.tables import union_all


def mode_smallest(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mode as text, count) per column; among equally frequent values the smallest of its own type wins.

    Columns of one type are counted together, so values are compared as what they are: 9 before 10.
    """
    kinds: dict[str, list[str]] = {}
    for c in cols:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)

    def of(same: list[str]) -> DataFrame:
        long = df.select(*same).unpivot([], same, "feature", "value").dropna(subset=["value"])
        counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
        return counts.groupBy("feature").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).cast("string").alias("mode"),
            F.max("n").alias("count"),
        )

    return union_all([of(same) for same in kinds.values()])


class GroupMedianImputer(FitStep):
    """Learn fills on one table and apply the very same ones to any other.

    ``col`` is filled by its median within ``by``, then by its global median; ``mode_cols`` by
    their smallest mode; ``drop_cols`` go away, rows missing any of ``drop_na`` are dropped and
    ``flag=(name, threshold)`` adds ``col < threshold`` as 0/1. Statistics use all rows.
    """

    DEFAULTS = {"mode_cols": [], "drop_cols": [], "drop_na": [], "flag": None}

    def _fit(self, df: DataFrame) -> GroupMedianImputerModel:
        c = self.conf
        df = df.select(*dict.fromkeys([c["col"], c["by"], *c["mode_cols"]])).persist()  # one scan for all statistics
        try:
            rows = value_count(df, c["col"])
            groups = median(df.dropna(subset=[c["col"]]), c["col"], [c["by"]], "_fill", counted=rows)
            (overall,) = scalar_quantiles(df, c["col"], [0.5], counted=rows)
            modes = mode_smallest(df, c["mode_cols"]).collect() if c["mode_cols"] else []
            state = {
                "groups": keep_table(groups, "group-medians"),
                "global": overall,
                "modes": {r["feature"]: r["mode"] for r in modes},  # one row per column
            }
        finally:
            df.unpersist()
        return GroupMedianImputerModel(state, **c)


class GroupMedianImputerModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        c, state = self.conf, self.state
        kept = df.drop(*c["drop_cols"])
        kept = kept.dropna(subset=c["drop_na"]) if c["drop_na"] else kept
        order = kept.columns
        filled = lookup_kept(kept, state["groups"], [c["by"]]).withColumn(
            c["col"], F.coalesce(c["col"], "_fill", F.lit(state["global"]).cast("double"))
        )
        out = filled.select(*order)
        if c["flag"]:
            name, threshold = c["flag"]
            out = out.withColumn(name, flag(F.col(c["col"]) < threshold))
        return out.fillna({k: v for k, v in state["modes"].items() if v is not None})

    def table(self, df: DataFrame) -> DataFrame:
        """The fitted state as a long table (kind, key, number, label)."""
        spark, c = df.sparkSession, self.conf
        groups = kept_table(spark, self.state["groups"]).select(
            F.lit("group_median").alias("kind"),
            F.col(c["by"]).alias("key"),
            F.col("_fill").alias("number"),
            F.lit(None).cast("string").alias("label"),
        )
        rest = [("global_median", None, self.state["global"], None)]
        rest += [("mode", k, None, v) for k, v in sorted(self.state["modes"].items())]
        return groups.union(spark.createDataFrame(rest, groups.schema))


def missing_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing counts per column of two tables; columns complete in both are left out.

    A column absent before or after has NULL there and is marked ``added`` or ``dropped``.
    """

    def profile(df: DataFrame, out: str) -> DataFrame:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        return counts.unpivot([], df.columns, "column", out)

    joined = profile(before, "before").join(profile(after, "after"), "column", "full_outer")
    status = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "dropped").otherwise("kept")
    )
    return joined.withColumn("status", status).where(
        ~F.coalesce((F.col("before") == 0) & (F.col("after") == 0), F.lit(False))
    )


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count and column types in one row."""
    types = ", ".join(f"{n}: {t}" for n, t in df.dtypes)
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(types).alias("types")
    )


def fill_label(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Missing values of each named text column become its label."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.coalesce(F.col(kv[0]), F.lit(kv[1]))), labels.items(), df)
