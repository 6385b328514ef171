"""The profiling fan-out over one cached table: every report as its own small DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.operators import chartdata, groupings, profile
from quartier.operators.geo import GeoKMeans


def profile_reports(
    df: DataFrame, numbers: list[str], cats: list[str], price: str, unit: str, x: str, y: str, clusters: int = 8
) -> dict[str, Callable[[], DataFrame]]:
    """Named reports, each built when called. Persist ``df`` first: all of them read it."""
    target = "_log_price"
    logged = df.withColumn(target, F.log1p(price))

    def placed() -> DataFrame:
        found = GeoKMeans(cols=[x, y], k=clusters, out="_geo").fit(df).transform(df)
        return found.withColumn("geo_cluster", F.col("_geo_cluster").cast("string"))

    return {
        "moments": lambda: profile.moments(df, [*numbers, price]),
        "price_histogram": lambda: chartdata.histogram(df, price, 80),
        "log_price_histogram": lambda: chartdata.histogram(logged, target, 80),
        "price_qq": lambda: chartdata.qq_points(df, price),
        "log_price_qq": lambda: chartdata.qq_points(logged, target),
        "category_imbalance": lambda: profile.category_imbalance(df, cats),
        "linearity": lambda: profile.linearity(logged, numbers, target),
        "anova": lambda: profile.anova(logged, cats, target),
        "unit_summary": lambda: profile.grouped_summary(df, cats, unit),
        "unit_spread": lambda: groupings.median_spread(df, cats, unit, "missing", 0.99),
        "correlation": lambda: profile.corr_matrix(df, numbers),
        "vif": lambda: profile.vif(df.dropna(subset=numbers), numbers),
        "geo_spread": lambda: groupings.median_spread(placed(), ["geo_cluster"], price),
    }
