"""Row expressions: ratios, logs, flags, sentinels, clips and residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Unit price; NULL where the denominator is 0 or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def log_of(c: Column) -> Column:
    """Natural log, NULL outside its domain."""
    return F.when(c > 0, F.log(c))


def log1p_of(c: Column) -> Column:
    return F.when(c > -1, F.log1p(c))


def unit_price_from_log(log_price: Column, area: Column) -> Column:
    """Unit price back from ``log1p(price)``."""
    return ratio(F.expm1(log_price), area)


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def sentinel_to_null(c: Column, value) -> Column:
    return F.nullif(c, F.lit(value))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Limit ``c`` on either side; a missing value stays missing."""
    out = c
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(c.isNotNull(), out)


def zscore(c: Column, mean: Column, std: Column) -> Column:
    """Standard score; a constant column (std 0) maps to 0."""
    return (c - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation over complete pairs, NULL if a side is constant.

    Spark's own ``corr`` divides by zero there, which is an error in ANSI mode.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def absolute_pct_error(actual: Column, predicted: Column) -> Column:
    return F.abs(F.try_divide(actual - predicted, actual)) * 100


def shortened(text: Column, length: int = 46) -> Column:
    """At most ``length`` characters, an ellipsis marking what was cut."""
    cut = F.concat(F.substring(text, 1, length), F.lit("…"))
    return F.when(F.length(text) > length, cut).otherwise(text)


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def derived_listing_columns(
    df: DataFrame,
    floor: str,
    total_floors: str,
    area: str,
    rooms: str,
    build_year: str,
    current_year: int,
) -> DataFrame:
    """Building age, off-plan flag, floor ratio, first/last floor flags and area per room."""
    return df.withColumns(
        {
            "building_age": F.lit(float(current_year)) - F.col(build_year),
            "is_offplan": flag(F.col(build_year) > current_year),
            "floor_ratio": ratio(F.col(floor), F.col(total_floors)),
            "is_first_floor": flag(F.col(floor) == 1),
            "is_last_floor": flag(F.col(floor) == F.col(total_floors)),
            "area_per_room": ratio(F.col(area), F.col(rooms)),
        }
    )
