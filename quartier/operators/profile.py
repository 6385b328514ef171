"""Table profiling: imbalance, summaries, moments, correlation, collinearity, variance tests."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.functions.exprs import correlation, nan_to_null, round_half_even
from quartier.operators.groupings import unpivot_levels
from quartier.operators.lookup import bounded
from quartier.operators.quantiles import quantiles
from quartier.operators.ranks import spearman

MISSING = "MISSING"


def value_counts(df: DataFrame, col: str, label: str = MISSING) -> DataFrame:
    level = F.coalesce(F.col(col).cast("string"), F.lit(label)).alias(col)
    return df.groupBy(level).agg(F.count("*").alias("count"))


def category_imbalance(df: DataFrame, cols: list[str], label: str = MISSING) -> DataFrame:
    """Per column: levels, most frequent level and its share, rarest count, missing percent."""
    counts = unpivot_levels(df, cols).groupBy("feature", "level").agg(F.count("*").alias("n"))
    named = F.coalesce(F.col("level"), F.lit(label))
    merged = counts.groupBy("feature", named.alias("value")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("gone")
    )
    n = F.col("n")
    return merged.groupBy("feature").agg(
        F.count("*").alias("n_categories"),
        F.min_by("value", F.struct(-n, F.col("value"))).alias("top_value"),
        round_half_even(F.max(n) / F.sum(n), 3).alias("top_share"),
        F.min(n).alias("min_count"),
        round_half_even(F.sum("gone") * 100 / F.sum(n), 1).alias("missing_pct"),
    )


def grouped_summary(
    df: DataFrame, cols: list[str], value: str, digits: int | None = 0, label: str = MISSING, **kw
) -> DataFrame:
    """Count, median, mean and sample std of ``value`` per level of every column, in one table."""
    long = unpivot_levels(df.dropna(subset=[value]), cols, [value], label)
    stats = quantiles(
        long, value, [0.5], ["feature", "level"], "_q",
        [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")],
        **kw,
    )

    def shown(c):
        return round_half_even(c, digits) if digits is not None else c

    return stats.select(
        "feature",
        F.col("level").alias("value"),
        "count",
        shown(F.get("_q", F.lit(0))).alias("median"),
        shown(F.col("mean")).alias("mean"),
        shown(F.col("std")).alias("std"),
    )


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, skew, kurt, n_missing): population skewness and excess kurtosis, one pass."""
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            nan_to_null(F.skewness(c)).alias("skew"),
            nan_to_null(F.kurtosis(c)).alias("kurt"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
        )
        for c in cols
    ]
    return df.agg(F.array(*aggs).alias("_all")).select(F.inline("_all"))


def pearson(df: DataFrame, cols: list[str], target: str, out: str = "pearson") -> DataFrame:
    """(feature, out): correlation with ``target`` on pairwise complete rows, one pass."""
    aggs = [
        F.struct(
            F.lit(c).alias("feature"),
            correlation(F.col(c), F.col(target)).alias(out),
        )
        for c in cols
    ]
    return df.agg(F.array(*aggs).alias("_all")).select(F.inline("_all"))


def linearity(df: DataFrame, cols: list[str], target: str, **kw) -> DataFrame:
    """(feature, pearson, spearman, gap) with gap = abs(spearman) - abs(pearson)."""
    both = pearson(df, cols, target).join(spearman(df, cols, target, **kw), "feature", "left")
    return both.withColumn("gap", F.abs("spearman") - F.abs("pearson"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long (a, b, corr) upper triangle over rows complete in all ``cols``, one pass."""
    aggs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("corr"))
        for a, b in combinations_with_replacement(cols, 2)
    ]
    return df.dropna(subset=cols).agg(F.array(*aggs).alias("_all")).select(F.inline("_all"))


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix (p x p)."""
    matrix = np.eye(len(cols))
    for row in corr_matrix(df, cols).collect():  # one row per pair of columns
        i, j = cols.index(row["a"]), cols.index(row["b"])
        matrix[i, j] = matrix[j, i] = np.nan if row["corr"] is None else row["corr"]
    if np.isnan(matrix).any():
        factors = [None] * len(cols)
    else:
        factors = [float(v) for v in np.diag(np.linalg.pinv(matrix))]
    return df.sparkSession.createDataFrame(list(zip(cols, factors)), "feature string, vif double")


def anova(df: DataFrame, cats: list[str], value: str) -> DataFrame:
    """One-way analysis of variance of ``value`` per column: degrees of freedom, F and p.

    Missing levels and values are dropped. Sums come from per-level mean and variance, so
    large offsets do not cancel.
    """
    long = unpivot_levels(df.dropna(subset=[value]), cats, [value]).dropna(subset=["level"])
    levels = long.groupBy("feature", "level").agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    n, m = F.col("n"), F.col("m")
    grand = levels.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("k"),
        F.sum(n * F.col("v")).alias("within"),
        F.sum(n * m).alias("sum"),
    )
    grand = bounded(grand, len(cats))
    between = (
        levels.join(F.broadcast(grand), "feature")
        .groupBy("feature", "rows", "k", "within")
        .agg(F.sum(n * F.pow(m - F.col("sum") / F.col("rows"), 2)).alias("between"))
    )
    df1, df2 = F.col("k") - 1, F.col("rows") - F.col("k")
    table = between.select(
        "feature",
        df1.alias("df_between"),
        df2.alias("df_within"),
        F.try_divide(F.try_divide("between", df1), F.try_divide("within", df2)).alias("f"),
    )
    rows = [(*r, f_upper_tail(r["f"], r["df_between"], r["df_within"])) for r in table.collect()]
    return df.sparkSession.createDataFrame(
        rows, "feature string, df_between long, df_within long, f double, p double"
    )


def f_upper_tail(f: float | None, d1: int, d2: int) -> float | None:
    """P(F > f), summed in the upper tail itself so that tiny values stay exact."""
    if f is None or d1 <= 0 or d2 <= 0:
        return None
    return _beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    fraction = d
    for m in range(1, 2000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            fraction *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(log_front) * fraction / a
