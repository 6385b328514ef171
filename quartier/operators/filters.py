"""Row filters, quantile trims, clips, sentinel replacement and level merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartier.functions.exprs import clip, zscore
from quartier.operators.lookup import lookup
from quartier.operators.quantiles import scalar_quantiles
from quartier.operators.state import FitStep, FittedStep
from quartier.session import checkpointed


def range_filter(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows strictly inside (low, high); missing values drop."""
    return df.where((F.col(col) > low) & (F.col(col) < high))


def trim_quantile(
    df: DataFrame, col: str, low: float = 0.01, high: float = 0.99, inclusive: bool = True, **kw
) -> DataFrame:
    """Rows between two quantiles. The bounds become literals, so the scan can prune on them."""
    lo, hi = scalar_quantiles(df, col, [low, high], **kw)
    c = F.col(col)
    if inclusive:
        return df.where((c >= F.lit(lo)) & (c <= F.lit(hi)))
    return df.where((c > F.lit(lo)) & (c < F.lit(hi)))


def trim_upper(df: DataFrame, col: str, high: float = 0.99, **kw) -> DataFrame:
    """Rows strictly below a quantile."""
    (hi,) = scalar_quantiles(df, col, [high], **kw)
    return df.where(F.col(col) < F.lit(hi))


def winsorize(
    df: DataFrame, col: str, low: float = 0.01, high: float = 0.99, out: str | None = None, **kw
) -> DataFrame:
    """Limit ``col`` to its own quantiles on both sides."""
    lo, hi = scalar_quantiles(df, col, [low, high], **kw)
    return df.withColumn(out or col, clip(F.col(col), F.lit(lo), F.lit(hi)))


def clip_upper(df: DataFrame, col: str, high: float = 0.99, out: str | None = None, **kw) -> DataFrame:
    (hi,) = scalar_quantiles(df, col, [high], **kw)
    return df.withColumn(out or col, clip(F.col(col), high=F.lit(hi)))


def living_not_above_total(df: DataFrame, living: str, total: str) -> DataFrame:
    """Drop rows whose living area exceeds the total area."""
    return df.where(~F.coalesce(F.col(living) > F.col(total), F.lit(False)))


class SentinelMedian(FitStep):
    """Replace a sentinel by the median of the other values: ``SentinelMedian(col=, value=)``."""

    def _fit(self, df: DataFrame) -> SentinelMedianModel:
        c = self.conf
        valid = df.where(F.col(c["col"]) != F.lit(c["value"]))
        (middle,) = scalar_quantiles(valid, c["col"], [0.5])
        return SentinelMedianModel({"median": middle}, **c)


class SentinelMedianModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.conf["col"])
        fill = F.lit(self.state["median"]).cast("double")
        return df.withColumn(
            self.conf["col"], F.when(c == F.lit(self.conf["value"]), fill).otherwise(c.cast("double"))
        )


class ZScore(FitStep):
    """Population z-scores of several columns: ``ZScore(cols=[...])``; outputs ``<col>_z``."""

    def _fit(self, df: DataFrame) -> ZScoreModel:
        cols = self.conf["cols"]
        stats = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
        ).first()
        state = {c: [stats[f"m_{c}"], stats[f"s_{c}"]] for c in cols}
        return ZScoreModel(state, **self.conf)


class ZScoreModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {
            f"{c}_z": zscore(F.col(c), F.lit(m).cast("double"), F.lit(s).cast("double"))
            for c, (m, s) in self.state.items()
        }
        return df.withColumns(scaled)


def merge_rare_levels(df: DataFrame, col: str, min_count: int, other: str, out: str) -> DataFrame:
    """Levels with fewer than ``min_count`` rows become ``other``; NULL stays NULL."""
    kept = df.dropna(subset=[col]).groupBy(col).agg(F.count("*").alias("_n"))
    kept = kept.where(F.col("_n") >= min_count).select(col, F.lit(1).alias("_kept"))
    merged: Column = F.when(F.col("_kept").isNotNull() | F.col(col).isNull(), F.col(col))
    return lookup(df, kept, [col]).withColumn(out, merged.otherwise(F.lit(other))).drop("_kept")


def aligned_merge(left: DataFrame, right: DataFrame, key: str, check: str, take: list[str]) -> DataFrame:
    """One-to-one merge on a row key, refused unless both sides agree in rows and in ``check``.

    A key that is NULL or repeated on either side is refused too. One join: its stored result is checked and returned.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.count("*").over(Window.partitionBy(key)))

    r = right.select(key, F.col(check).alias("_check"), *take)
    both = checkpointed(counted(left, "_n").join(counted(r, "_m"), key, "full_outer"))
    good = (F.col("_n") == 1) & (F.col("_m") == 1) & F.col(key).isNotNull() & (F.col(check) == F.col("_check"))
    wrong = both.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("bad")).first()["bad"]
    if wrong:
        raise ValueError(f"{wrong} rows of the two tables do not match one to one on {key} and {check}")
    return both.drop("_check", "_n", "_m")
