"""Regression metrics, fold scores, variant deltas and partition agreement, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.functions.exprs import absolute_pct_error, nan_to_null
from quartier.operators.lookup import bounded
from quartier.operators.quantiles import quantiles

METRICS = [
    "log_r2", "log_rmse", "log_mae", "usd_r2", "usd_rmse", "usd_mae", "mape_pct", "median_ape_pct",
]


def r_squared(actual: Column, predicted: Column) -> Column:
    """Aggregate: 1 - residual sum of squares / total sum of squares."""
    residual = actual - predicted
    known = F.when(residual.isNotNull(), actual)
    return 1 - F.try_divide(F.sum(residual * residual), F.var_pop(known) * F.count(residual))


def reg_metrics(
    df: DataFrame, actual: str, predicted: str, by: list[str] = (), log: bool = True,
    min_usd: float | None = None, **kw,
) -> DataFrame:
    """The metric block, per group if ``by``: log and price R2, RMSE, MAE and percent errors.

    With ``log`` the two columns are ``log1p(price)``, else prices; ``min_usd`` limits predicted
    prices from below before anything is measured.
    """
    y, p = F.col(actual), F.col(predicted)
    usd_y, usd_p = (F.expm1(y), F.expm1(p)) if log else (y, p)
    if min_usd is not None:
        usd_p = F.greatest(usd_p, F.lit(min_usd))
    log_y = y if log else F.log1p(usd_y)
    log_p = p if log and min_usd is None else F.log1p(usd_p)
    columns = {
        "_ly": log_y, "_lp": log_p, "_uy": usd_y, "_up": usd_p, "_ape": absolute_pct_error(usd_y, usd_p),
    }
    rows = df.select(*by, *[c.alias(n) for n, c in columns.items()])
    log_residual, usd_residual = F.col("_ly") - F.col("_lp"), F.col("_uy") - F.col("_up")
    aggs = [
        F.count(log_residual).alias("n"),
        r_squared(F.col("_ly"), F.col("_lp")).alias("log_r2"),
        F.sqrt(F.avg(log_residual * log_residual)).alias("log_rmse"),
        F.avg(F.abs(log_residual)).alias("log_mae"),
        r_squared(F.col("_uy"), F.col("_up")).alias("usd_r2"),
        F.sqrt(F.avg(usd_residual * usd_residual)).alias("usd_rmse"),
        F.avg(F.abs(usd_residual)).alias("usd_mae"),
        F.avg("_ape").alias("mape_pct"),
    ]
    q = quantiles(rows, "_ape", [0.5], list(by), "_q", aggs, **kw)
    return q.withColumn("median_ape_pct", F.get("_q", F.lit(0))).drop("_q")


def residual_diagnostics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Skewness, population std and excess kurtosis of the residuals."""
    r = F.col(actual) - F.col(predicted)
    return df.agg(
        F.count(r).alias("n"), nan_to_null(F.skewness(r)).alias("skew"),
        F.stddev_pop(r).alias("std"), nan_to_null(F.kurtosis(r)).alias("kurt"),
    )


def r2_pooled(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One R2 over the held-out predictions of all folds."""
    return df.agg(r_squared(F.col(actual), F.col(predicted)).alias("r2"))


def r2_per_fold(df: DataFrame, actual: str, predicted: str, fold: str, by: list[str] = ()) -> DataFrame:
    """Mean and population std of the R2 of each fold."""
    scores = df.groupBy(*by, fold).agg(r_squared(F.col(actual), F.col(predicted)).alias("r2"))
    return scores.groupBy(*by).agg(
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.count("*").alias("folds")
    )


def variant_delta(metrics: DataFrame, key: str, baseline: str, names: list[str]) -> DataFrame:
    """Long (variant, metric, value, delta): difference of each metric to the baseline variant."""
    long = metrics.select(key, *names).unpivot([key], names, "metric", "value")
    base = bounded(long.where(F.col(key) == baseline).select("metric", F.col("value").alias("_base")), len(names))
    return long.join(F.broadcast(base), "metric").select(
        key, "metric", "value", (F.col("value") - F.col("_base")).alias("delta")
    )


def compare_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two long (metric, value) tables side by side with their difference."""
    r = right.select("metric", F.col("value").alias("other"))
    return left.join(r, "metric").select("metric", "value", "other", (F.col("value") - F.col("other")).alias("delta"))


def top_configs(metrics: DataFrame, score: str, k: int, ties: list[str], descending: bool = True) -> DataFrame:
    """Best ``k`` rows by ``score`` with an explicit tie order."""
    first = F.desc(score) if descending else F.asc(score)
    return metrics.orderBy(first, *ties).limit(k)


def best_config(metrics: DataFrame, score: str, ties: list[str], descending: bool = False) -> DataFrame:
    """The single best row; the first in tie order wins."""
    return top_configs(metrics, score, 1, ties, descending)


def overfit_gap(scores: DataFrame, train: str, held_out: str) -> DataFrame:
    return scores.withColumn("overfit_gap", F.col(train) - F.col(held_out))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over rows labelled by both partitions."""
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two partitions, from their contingency counts; 1 if both are trivial."""

    def pairs(c: Column) -> Column:
        return c * (c - 1) / 2

    cells = contingency(df, a, b)
    n = F.col("n").cast("double")
    joint = cells.agg(F.sum(pairs(n)).alias("_ij"), F.sum(n).alias("_n"))
    rows = cells.groupBy(a).agg(F.sum(n).alias("n")).agg(F.sum(pairs(F.col("n"))).alias("_i"))
    cols = cells.groupBy(b).agg(F.sum(n).alias("n")).agg(F.sum(pairs(F.col("n"))).alias("_j"))
    expected = F.try_divide(F.col("_i") * F.col("_j"), pairs(F.col("_n")))
    most = (F.col("_i") + F.col("_j")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("_ij") - expected) / (most - expected))
    return joint.crossJoin(rows).crossJoin(cols).select(ari.alias("ari"))  # one row each
