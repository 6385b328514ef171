"""Category grouping by terciles of category medians, and the weak-feature screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.functions.exprs import flag
from quartier.operators.filters import trim_upper
from quartier.operators.lookup import lookup, stored
from quartier.operators.quantiles import median, scalar_quantiles
from quartier.operators.ranks import values_below
from quartier.operators.state import FitStep, FittedStep, keep_table, kept_table, lookup_kept

GROUPS = ["low", "mid", "high"]


def threshold_group(value: Column, low: float | None, high: float | None) -> Column:
    """``low`` up to and including the first cut, ``mid`` up to the second, else ``high``."""
    return (
        F.when(value <= F.lit(low), GROUPS[0]).when(value <= F.lit(high), GROUPS[1]).otherwise(GROUPS[2])
    )


def unpivot_levels(df: DataFrame, cols: list[str], keep: list[str] = (), label: str | None = None) -> DataFrame:
    """Long (keep..., feature, level): every named column as text, missing ones labelled."""
    text = [
        (F.coalesce(F.col(c).cast("string"), F.lit(label)) if label else F.col(c).cast("string")).alias(c)
        for c in cols
    ]
    return df.select(*keep, *text).unpivot(list(keep), cols, "feature", "level")


class TercileGrouper(FitStep):
    """Map each level of ``category`` to low/mid/high by terciles of the level medians of ``value``.

    Terciles are over levels, not rows. Unknown levels get ``default`` at apply time.
    """

    DEFAULTS = {"default": "mid", "out": None}

    def _fit(self, df: DataFrame) -> TercileGrouperModel:
        c = self.conf
        stats = median(df, c["value"], [c["category"]], "_median", [F.count(c["value"]).alias("_count")])
        stats = stats.persist()  # read for the cuts and for the map
        try:
            low, high = scalar_quantiles(stats, "_median", [1 / 3, 2 / 3])
            mapped = stats.withColumn("_group", threshold_group(F.col("_median"), low, high))
            state = {"low": low, "high": high, "levels": keep_table(mapped, "tercile-groups")}
        finally:
            stats.unpersist()
        return TercileGrouperModel(state, **c)


class TercileGrouperModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.conf
        out = c["out"] or f"{c['category']}_group"
        order = [*df.columns, out]
        found = lookup_kept(df, self.state["levels"], [c["category"]])
        return found.withColumn(out, F.coalesce("_group", F.lit(c["default"]))).select(*order)

    def levels(self, df: DataFrame) -> DataFrame:
        """(category, median, count, group) as fitted."""
        table = kept_table(df.sparkSession, self.state["levels"])
        return table.select(
            self.conf["category"],
            F.col("_median").alias("median"),
            F.col("_count").alias("count"),
            F.col("_group").alias("group"),
        )

    def cuts(self, df: DataFrame) -> DataFrame:
        pair = [(self.state["low"], self.state["high"])]
        return df.sparkSession.createDataFrame(pair, "q_low double, q_high double")

    def group_table(self, df: DataFrame) -> DataFrame:
        """Rows and median of ``value`` per group; groups without rows are kept, with a NULL median."""
        c = self.conf
        levels = self.levels(df)
        counts = levels.groupBy("group").agg(F.sum("count").alias("count"))
        inside = lookup(df.dropna(subset=[c["category"]]), levels.select(c["category"], "group"), [c["category"]])
        medians = median(inside, c["value"], ["group"], "median")
        groups = df.sparkSession.createDataFrame([(g,) for g in GROUPS], "group string")
        return (
            groups.join(counts, "group", "left")
            .join(medians, "group", "left")
            .select("group", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "median")
        )


def add_membership_flag(df: DataFrame, col: str, values: list[str], out: str) -> DataFrame:
    return df.withColumn(out, flag(F.col(col).isin(values)))


def level_medians(df: DataFrame, cols: list[str], value: str, label: str | None = None) -> DataFrame:
    """(feature, level, median) for every level of every named column; missing levels become ``label`` or are dropped."""
    return median(unpivot_levels(df, cols, [value], label), value, ["feature", "level"], "median")


def weak_features(df: DataFrame, candidates: list[str], value: str, threshold: float) -> DataFrame:
    """(feature, spread, weak, medians): spread of level medians, and the medians by level.

    Columns the table lacks are skipped.
    """
    present = [c for c in candidates if c in df.columns]
    spread = F.max("median") - F.min("median")
    levels = F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "median"))))  # as many as the column has levels
    return (
        level_medians(df, present, value)
        .groupBy("feature")
        .agg(spread.alias("spread"), levels.alias("medians"))
        .withColumn("weak", flag(F.col("spread") < threshold))
        .select("feature", "spread", "weak", "medians")
    )


def median_spread(
    df: DataFrame, cols: list[str], value: str, label: str | None = None, trim: float | None = None
) -> DataFrame:
    """Lowest and highest level median per column and the level reaching it (ties: smallest level).

    Missing values are a level of their own named ``label``, or left out; with ``trim`` only rows whose value lies
    strictly below that quantile count.
    """
    m = F.col("median")
    df = trim_upper(df, value, trim) if trim is not None else df
    return (
        level_medians(df, cols, value, label)
        .where(m.isNotNull())
        .groupBy("feature")
        .agg(
            F.min(m).alias("median_min"),
            F.max(m).alias("median_max"),
            (F.max(m) - F.min(m)).alias("spread"),
            F.min_by("level", F.struct(-m, F.col("level"))).alias("top"),
            F.min_by("level", F.struct(m, F.col("level"))).alias("bottom"),
        )
    )


def category_order(df: DataFrame, col: str, value: str, exact_rows: int | None = None) -> DataFrame:
    """Levels with their median of ``value`` and its rank (1 + levels with a smaller median)."""
    narrow, _, _ = stored(df.select(col, value), "levels")  # every scan of ``df`` would repeat the joins behind it
    levels = median(narrow, value, [col], "median", exact_rows=exact_rows).dropna(subset=["median"])
    levels, _, _ = stored(levels, "medians")
    counts = levels.groupBy("median").agg(F.count("*").alias("_n"))
    ranked = values_below(counts, [], "median", "_n", "_below", exact_rows)
    position = lookup(levels, ranked.select("median", "_below"), ["median"])
    return position.select(col, "median", (F.col("_below") + 1).alias("position"))
