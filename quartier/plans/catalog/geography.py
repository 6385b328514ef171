"""Queries on rasters, centroids, zones and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.operators import encode, geo, splits
from quartier.operators.filters import range_filter
from quartier.operators.folds import with_fold
from quartier.plans.catalog.registry import LISTINGS, UNITS, fold_sql, query, r, rounded, unit_listings
from quartier.sources.listings import clean_listings
from quartier.sources.tables import nested_json

# Eight boxes (lo, hi] that cover the plane, and eight centroids inside the data.
BIG = 1e9
ZONES = [
    (1, -BIG, 42.83, -BIG, 74.55), (2, -BIG, 42.83, 74.55, 74.62), (3, -BIG, 42.83, 74.62, BIG),
    (4, 42.83, 42.87, -BIG, 74.6), (5, 42.83, 42.87, 74.6, BIG), (6, 42.87, BIG, -BIG, 74.53),
    (7, 42.87, BIG, 74.53, 74.65), (8, 42.87, BIG, 74.65, BIG),
]
CENTROIDS = [
    (0, 42.80713, 74.51371), (1, 42.81817, 74.58237), (2, 42.82639, 74.66191), (3, 42.84211, 74.53617),
    (4, 42.85319, 74.61429), (5, 42.86521, 74.68713), (6, 42.88237, 74.55129), (7, 42.89411, 74.64817),
]
ZONES_SQL = "z AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for i, a, b, c, e in ZONES
) + ") v(leaf, lat_lo, lat_hi, lon_lo, lon_hi))"
IN_ZONE = "lat > lat_lo AND lat <= lat_hi AND lon > lon_lo AND lon <= lon_hi"
CENTROIDS_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, a, b in CENTROIDS
) + ") v(cluster, clat, clon))"
NEAREST_SQL = (
    "near AS (SELECT listing_id, arg_min(cluster, row(pow(lat - clat, 2) + pow(lon - clon, 2), cluster)) AS cluster"
    " FROM l CROSS JOIN c GROUP BY 1)"
)


def zones(spark):
    return spark.createDataFrame(ZONES, "leaf int, lat_lo double, lat_hi double, lon_lo double, lon_hi double")


def centroids(spark):
    return spark.createDataFrame(CENTROIDS, "cluster int, lat double, lon double")


def zoned(spark, d, *cols):
    df = unit_listings(spark, d).select("listing_id", "lat", "lon", "unit", *cols)
    return geo.assign_zone(range_filter(df, "lon", 70, 80), zones(spark), "lat", "lon", ["leaf"])


ZONED = f"{UNITS}, {ZONES_SQL}, p AS (SELECT l.*, leaf FROM l JOIN z ON {IN_ZONE} WHERE lon > 70 AND lon < 80)"


@query("zone_assign", f"WITH {ZONED} SELECT listing_id, leaf FROM p")
def zone_assign(spark, d):
    return zoned(spark, d).select("listing_id", "leaf")


@query("nearest_centroid", f"WITH {LISTINGS}, {CENTROIDS_SQL}, {NEAREST_SQL} SELECT * FROM near")
def nearest_centroid(spark, d):
    df = clean_listings(spark, d).select("listing_id", "lat", "lon")
    return geo.assign_nearest(df, centroids(spark), ["lat", "lon"]).select("listing_id", "cluster")


_STATS = (
    f"count(*) AS n, {r('median(unit)', 4)} AS median, {r('avg(unit)', 4)} AS mean,"
    f" {r('stddev_samp(unit)', 4)} AS std"
)


@query(
    "zone_summary",
    f"WITH {ZONED} SELECT leaf, {_STATS}, {r('avg(lat)')} AS lat_mean, {r('avg(lon)')} AS lon_mean FROM p GROUP BY 1",
)
def zone_summary(spark, d):
    stats = geo.zone_summary(zoned(spark, d), "leaf", "unit", "lat", "lon")
    return rounded(stats, {"median": 4, "mean": 4, "std": 4})


@query("leaf_stats_json", f"WITH {ZONED} SELECT leaf, {_STATS} FROM p GROUP BY 1")
def leaf_stats_json(spark, d):
    stats = rounded(geo.zone_summary(zoned(spark, d), "leaf", "unit", "lat", "lon"), 4)
    text = nested_json(stats, "leaf", ["n", "median", "mean", "std"])
    record = T.StructType(
        [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("median", "mean", "std")]
    )
    parsed = F.from_json("json", T.MapType(T.StringType(), record))
    entry = F.element_at(parsed, F.col("leaf").cast("string")).alias("_e")
    return text.select("leaf", entry).select("leaf", "_e.*")


def _raster_sql(n: int) -> str:
    def at(index: str, c: str) -> str:
        span = f"(max_{c} - min_{c})"
        return f"min_{c} - {span} * 0.03::DOUBLE + {index} * (({span} + 2 * ({span} * 0.03::DOUBLE)) / {n - 1})"

    return (
        "b AS (SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM l"
        f" WHERE lon > 70 AND lon < 80), g AS (SELECT (id // {n})::INTEGER AS i, (id % {n})::INTEGER AS j,"
        f" {at(f'(id // {n})', 'lat')} AS lat, {at(f'(id % {n})', 'lon')} AS lon FROM range({n * n}) t(id) CROSS JOIN b)"
    )


@query(
    "raster_grid",
    f"WITH {LISTINGS}, {_raster_sql(400)} SELECT i, j, {r('lat', 9)} AS lat, {r('lon', 9)} AS lon FROM g",
)
def raster_grid(spark, d):
    df = range_filter(clean_listings(spark, d), "lon", 70, 80)
    return rounded(geo.raster_grid(df, "lat", "lon", 400), 9)


@query(
    "raster_predict",
    f"WITH {ZONED}, {_raster_sql(350)}, m AS (SELECT leaf, avg(unit) AS value FROM p GROUP BY 1)"
    f" SELECT i, j, leaf, {r('value', 4)} AS value FROM g JOIN z ON {IN_ZONE} LEFT JOIN m USING (leaf)",
)
def raster_predict(spark, d):
    points = zoned(spark, d)
    means = points.groupBy("leaf").agg(F.avg("unit").alias("value"))
    valued = zones(spark).join(means, "leaf", "left")
    grid = geo.raster_grid(points, "lat", "lon", 350)
    return rounded(geo.assign_zone(grid, valued, "lat", "lon", ["leaf", "value"]).drop("lat", "lon"), 4)


@query(
    "best_split",
    f"""WITH {LISTINGS}, t AS (SELECT lat, usd_price_syn / area_total AS y FROM l),
b AS (SELECT min(lat) AS lo, max(lat) AS hi, count(*) AS n, sum(y) AS s FROM t),
h AS (SELECT least(floor((lat - lo) / (hi - lo) * 256), 255)::INTEGER AS bin, count(*) AS n, sum(y) AS s FROM t CROSS JOIN b GROUP BY 1),
c AS (SELECT bin, (sum(n) OVER (ORDER BY bin))::BIGINT AS n_left, sum(s) OVER (ORDER BY bin) AS sl FROM h),
g AS (SELECT bin, lo + (bin + 1) * (hi - lo) / 256 AS threshold, n_left, n - n_left AS n_right,
 sl * sl / n_left + (s - sl) * (s - sl) / nullif(n - n_left, 0) - s * s / n AS gain FROM c CROSS JOIN b)
SELECT bin, {r('threshold')} AS threshold, n_left, n_right, {r('gain', 0)} AS gain FROM g
WHERE n_left >= 30 AND n_right >= 30 ORDER BY g.gain DESC, bin LIMIT 1""",
)
def best_split(spark, d):
    df = clean_listings(spark, d).select("lat", (F.col("usd_price_syn") / F.col("area_total")).alias("y"))
    return rounded(geo.best_split(df, "lat", "y", 256, 30), {"gain": 0})


@query(
    "zone_target_encode",
    f"""WITH {ZONED}, f AS (SELECT *, {fold_sql('listing_id')} AS fold FROM p),
s AS (SELECT leaf, fold, sum(unit) AS s, count(unit) AS n FROM f GROUP BY 1, 2),
m AS (SELECT leaf, fold, (sum(s) OVER (PARTITION BY leaf) - s) / nullif(sum(n) OVER (PARTITION BY leaf) - n, 0) AS m FROM s)
SELECT listing_id, leaf, fold, {r('m', 4)} AS zone_mean FROM f JOIN m USING (leaf, fold)""",
)
def zone_target_encode(spark, d):
    df = with_fold(zoned(spark, d), "listing_id")
    found = encode.oof_target_mean(df, ["leaf"], "unit", "fold", "zone_mean")
    return rounded(found.select("listing_id", "leaf", "fold", "zone_mean"), 4)


_SPLIT_COLS = ["lat", "lon", "area_total", "build_year"]
_CUTS = """v AS (SELECT {by}feature, x, count(*) AS n, sum(y) AS s FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(n) OVER al AS nt, sum(s) OVER al AS st, lead(x) OVER up AS nx FROM v
 WINDOW up AS (PARTITION BY {by}feature ORDER BY x), al AS (PARTITION BY {by}feature)),
g AS (SELECT {by}feature, x, x + (nx - x) / 2 AS threshold, nl::BIGINT AS n_left, (nt - nl)::BIGINT AS n_right,
 pow(sl / nl - (st - sl) / nullif(nt - nl, 0), 2) * nl * (nt - nl) / nt AS gain FROM w),
c AS (SELECT *, row_number() OVER (PARTITION BY {by}feature ORDER BY gain DESC, x) AS k FROM g WHERE n_left >= 30 AND n_right >= 30)"""


def _unpivoted(keys: str = "") -> str:
    return "u AS (" + " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS feature, {c}::DOUBLE AS x, y FROM t" for c in _SPLIT_COLS
    ) + ")"


def _split_table(spark, d):
    # Whole prices: their sums are exact, whatever the order.
    return clean_listings(spark, d).select("listing_id", "series", *_SPLIT_COLS, F.floor("usd_price_syn").cast("double").alias("y"))


_SPLIT_TABLE = f"{LISTINGS}, t AS (SELECT *, floor(usd_price_syn)::DOUBLE AS y FROM l)"


@query(
    "exact_splits",
    f"WITH {_SPLIT_TABLE}, {_unpivoted()}, {_CUTS.format(by='')}"
    f" SELECT feature, {r('threshold')} AS threshold, n_left, n_right, {r('gain', 0)} AS gain FROM c WHERE k = 1",
)
def exact_splits(spark, d):
    return rounded(splits.exact_splits(_split_table(spark, d), _SPLIT_COLS, "y", 30), {"gain": 0})


@query(
    "exact_splits_by_group",
    f"WITH {_SPLIT_TABLE}, {_unpivoted('series, ')}, {_CUTS.format(by='series, ')}"
    f" SELECT series, feature, {r('threshold')} AS threshold, n_left, n_right, {r('gain', 0)} AS gain FROM c WHERE k = 1",
)
def exact_splits_by_group(spark, d):
    """One search for all groups, by the plan for many values: balanced ranges with carried totals."""
    found = splits.exact_splits(_split_table(spark, d), _SPLIT_COLS, "y", 30, ["series"], exact_rows=1_000)
    return rounded(found, {"gain": 0})


@query(
    "exact_zones",
    f"WITH {_SPLIT_TABLE}, u AS (SELECT 'lat' AS feature, lat AS x, y FROM t WHERE lon IS NOT NULL UNION ALL"
    f" SELECT 'lon', lon, y FROM t WHERE lat IS NOT NULL), {_CUTS.format(by='')},"
    " one AS (SELECT feature, threshold FROM c WHERE k = 1 ORDER BY gain DESC, feature LIMIT 1),"
    " p AS (SELECT t.*, CASE WHEN CASE feature WHEN 'lat' THEN lat ELSE lon END <= threshold THEN 2 ELSE 3 END AS zone FROM t"
    " CROSS JOIN one WHERE lat IS NOT NULL AND lon IS NOT NULL AND y IS NOT NULL)"
    f" SELECT zone, count(*) AS n, {r('avg(y)', 4)} AS mean FROM p GROUP BY 1",
)
def exact_zones(spark, d):
    """The first level of a tree on unbinned places."""
    placed = splits.exact_zones(_split_table(spark, d), ["lat", "lon"], "y", 1, 30).dropna(subset=["zone"])
    return rounded(placed.groupBy("zone").agg(F.count("*").alias("n"), F.avg("y").alias("mean")), 4)
