"""The aggregates behind charts: histograms, boxes, normal QQ points, densities, 2-D bins."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.operators.lookup import lookup
from quartier.operators.quantiles import quantiles


def _bounds(df: DataFrame, col: str, by: list[str] = (), low: str = "_lo", high: str = "_hi") -> DataFrame:
    """Value range per group; a constant column is widened by one half on both sides."""
    same = F.min(col) == F.max(col)
    return df.groupBy(*by).agg(
        F.when(same, F.min(col) - 0.5).otherwise(F.min(col)).cast("double").alias(low),
        F.when(same, F.max(col) + 0.5).otherwise(F.max(col)).cast("double").alias(high),
    )


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin index; the last bin includes its upper edge."""
    return F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, low, high, count) for all ``bins`` equal-width bins, empty ones included."""
    df = df.select(col).dropna()
    bounds = _bounds(df, col)
    counts = (
        df.crossJoin(F.broadcast(bounds))  # one row
        .groupBy(_bin(F.col(col), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(counts, "bin", "left")
        .crossJoin(F.broadcast(bounds))
        .select(
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("low"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"),
            F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        )
    )


def box_stats(df: DataFrame, col: str, by: list[str] = (), **kw) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR (furthest value inside the fence) and outlier count."""
    by = list(by)
    df = df.select(*by, col).dropna()
    q = quantiles(df, col, [0.25, 0.5, 0.75], by, "_q", [F.count(col).alias("n")], **kw)
    stats = q.select(*by, "n", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(["q1", "median", "q3"])])
    if by:
        joined = lookup(df, stats, by)
    else:
        joined = df.crossJoin(F.broadcast(stats))  # one row
    reach = (F.col("q3") - F.col("q1")) * 1.5
    c = F.col(col)
    inside = (c >= F.col("q1") - reach) & (c <= F.col("q3") + reach)
    return joined.groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, c)).alias("whisker_low"),
        F.max(F.when(inside, c)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def filliben_positions(n: int) -> list[float]:
    """Filliben's plotting positions for ``n`` points."""
    ends = 0.5 ** (1 / n)
    inner = [(i - 0.3175) / (n + 0.365) for i in range(2, n)]
    return [1 - ends, *inner, ends]


def qq_points(df: DataFrame, col: str, n: int = 99, **kw) -> DataFrame:
    """(i, prob, theoretical, sample): normal quantiles against sample quantiles on a fixed grid."""
    probs = filliben_positions(n)
    normal = NormalDist()
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(p).alias("prob"), F.lit(normal.inv_cdf(p)).alias("theoretical"))
            for i, p in enumerate(probs)
        ]
    )
    q = quantiles(df.dropna(subset=[col]), col, probs, **kw).where(F.col("q").isNotNull())
    return q.select(F.inline(F.arrays_zip(grid.alias("g"), F.col("q").alias("sample")))).select(
        "g.*", "sample"
    )


def density_by_group(df: DataFrame, col: str, by: str, bins: int) -> DataFrame:
    """(group, bin, count, density) over each group's own range (nothing beyond its data)."""
    df = df.select(by, col).dropna()
    bounds = _bounds(df, col, [by]).join(df.groupBy(by).agg(F.count("*").alias("_n")), by)
    placed = lookup(df, bounds, [by])
    lo, hi = F.col("_lo"), F.col("_hi")
    counts = placed.groupBy(by, "_lo", "_hi", "_n", _bin(F.col(col), lo, hi, bins).alias("bin")).agg(
        F.count("*").alias("count")
    )
    density = F.col("count") / (F.col("_n") * ((hi - lo) / bins))
    return counts.select(by, "bin", "count", density.alias("density"))


def colour_limits(df: DataFrame, value: str, cap: float, **kw) -> DataFrame:
    """One shared colour scale for several maps: the 5 % quantile, at most ``cap``, to the 95 % quantile."""
    q = quantiles(df, value, [0.05, 0.95], **kw)
    return q.select(F.least(F.get("q", F.lit(0)), F.lit(float(cap))).alias("low"), F.get("q", F.lit(1)).alias("high"))


def scatter_bins(df: DataFrame, x: str, y: str, nx: int, ny: int, by: list[str] = ()) -> DataFrame:
    """(by..., bin_x, bin_y, count): a scatter plot as occupied 2-D cells over the common range."""
    df = df.select(*by, x, y).dropna(subset=[x, y])
    both = _bounds(df, x).crossJoin(_bounds(df, y, low="_lo2", high="_hi2"))
    return (
        df.crossJoin(F.broadcast(both))  # one row
        .groupBy(
            *by,
            _bin(F.col(x), F.col("_lo"), F.col("_hi"), nx).alias("bin_x"),
            _bin(F.col(y), F.col("_lo2"), F.col("_hi2"), ny).alias("bin_y"),
        )
        .agg(F.count("*").alias("count"))
    )
