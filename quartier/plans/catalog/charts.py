"""Queries on chart data: histograms, boxes, QQ points, densities, 2-D bins."""

from __future__ import annotations

from quartier.operators import chartdata
from quartier.plans.catalog.registry import UNITS, query, r, rounded, unit_lines, unit_listings
from quartier.sources.tables import read_table

_BINS = 50


@query(
    "histogram_bins",
    f"""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
n AS (SELECT least(floor((l_extendedprice - lo) / (hi - lo) * {_BINS}), {_BINS - 1})::INTEGER AS bin, count(*) AS count
      FROM lineitem CROSS JOIN b GROUP BY 1)
SELECT i::INTEGER AS bin, {r(f'lo + i * ((hi - lo) / {_BINS})')} AS low,
 {r(f'lo + (i + 1) * ((hi - lo) / {_BINS})')} AS high, coalesce(count, 0) AS count
FROM range({_BINS}) t(i) CROSS JOIN b LEFT JOIN n ON n.bin = i""",
)
def histogram_bins(spark, d):
    return rounded(chartdata.histogram(read_table(spark, d, "lineitem"), "l_extendedprice", _BINS))


@query(
    "box_stats_by_group",
    f"""WITH u AS (SELECT l_returnflag, l_extendedprice / nullif(l_quantity, 0) AS unit FROM lineitem),
q AS (SELECT l_returnflag, count(unit) AS n, quantile_cont(unit, 0.25) AS q1, median(unit) AS median,
      quantile_cont(unit, 0.75) AS q3 FROM u WHERE unit IS NOT NULL GROUP BY 1),
j AS (SELECT u.unit, q.*, unit >= q1 - (q3 - q1) * 1.5 AND unit <= q3 + (q3 - q1) * 1.5 AS inside
      FROM u JOIN q USING (l_returnflag))
SELECT l_returnflag, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
 {r('min(unit) FILTER (inside)')} AS whisker_low, {r('max(unit) FILTER (inside)')} AS whisker_high,
 count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY l_returnflag, n, q1, median, q3""",
)
def box_stats_by_group(spark, d):
    return rounded(chartdata.box_stats(unit_lines(spark, d), "unit", ["l_returnflag"]))


@query(
    "box_stats_overall",
    f"""WITH q AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median,
 quantile_cont(value, 0.75) AS q3 FROM events), j AS (SELECT e.value, q.*,
 value >= q1 - (q3 - q1) * 1.5 AND value <= q3 + (q3 - q1) * 1.5 AS inside FROM events e CROSS JOIN q)
SELECT n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
 {r('min(value) FILTER (inside)')} AS whisker_low, {r('max(value) FILTER (inside)')} AS whisker_high,
 count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY n, q1, median, q3""",
)
def box_stats_overall(spark, d):
    return rounded(chartdata.box_stats(read_table(spark, d, "events"), "value"))


_PROBS = chartdata.filliben_positions(99)


@query(
    "qq_points",
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(_PROBS))
    + ") v(i, prob)), q AS (SELECT quantile_cont(l_extendedprice, ["
    + ", ".join(f"{p!r}::DOUBLE" for p in _PROBS)
    + f"]) AS q FROM lineitem) SELECT i, {r('prob', 9)} AS prob, {r('q[i + 1]', 4)} AS sample FROM p CROSS JOIN q",
)
def qq_points(spark, d):
    points = chartdata.qq_points(read_table(spark, d, "lineitem"), "l_extendedprice", 99)
    return rounded(points.drop("theoretical"), {"prob": 9, "sample": 4})


@query(
    "density_by_group",
    f"""WITH {UNITS}, b AS (SELECT series, min(unit) AS lo, max(unit) AS hi, count(*) AS n FROM l
 WHERE series IS NOT NULL AND unit IS NOT NULL GROUP BY 1)
SELECT series, least(floor((unit - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS count,
 {r('count(*) / (n * ((hi - lo) / 20))', 9)} AS density
FROM l JOIN b USING (series) WHERE unit IS NOT NULL GROUP BY series, lo, hi, n, 2""",
)
def density_by_group(spark, d):
    return rounded(chartdata.density_by_group(unit_listings(spark, d), "unit", "series", 20), 9)


@query(
    "colour_limits",
    f"WITH {UNITS} SELECT {r('least(quantile_cont(unit, 0.05), 1000.0::DOUBLE)')} AS low,"
    f" {r('quantile_cont(unit, 0.95)')} AS high FROM l",
)
def colour_limits(spark, d):
    return rounded(chartdata.colour_limits(unit_listings(spark, d), "unit", 1000))


@query(
    "scatter_bins_2d",
    """WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
 max(l_extendedprice) AS y1 FROM lineitem)
SELECT least(floor((l_quantity - x0) / (x1 - x0) * 40), 39)::INTEGER AS bin_x,
 least(floor((l_extendedprice - y0) / (y1 - y0) * 40), 39)::INTEGER AS bin_y, count(*) AS count
FROM lineitem CROSS JOIN b GROUP BY 1, 2""",
)
def scatter_bins_2d(spark, d):
    return chartdata.scatter_bins(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 40, 40)
