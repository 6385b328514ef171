"""Queries on segmentation: agreement, profiles, Ward merges and their cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartier.operators import filters, geo, metrics, segment
from quartier.plans.catalog.geography import CENTROIDS_SQL, NEAREST_SQL, centroids
from quartier.plans.catalog.registry import UNITS, query, r, rounded, unit_listings
from quartier.sources.tables import read_table


@query("contingency", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def contingency(spark, d):
    return metrics.contingency(read_table(spark, d, "labels"), "quality", "toxic")


def _ari_sql(cells: str) -> str:
    return f"""x AS ({cells}), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM x),
a AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM x GROUP BY a)),
b AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM x GROUP BY b))
SELECT {r('(ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2))')} AS ari FROM s, a, b"""


@query(
    "adjusted_rand",
    "WITH " + _ari_sql(
        "SELECT lang AS a, quality AS b, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"
    ),
)
def adjusted_rand(spark, d):
    both = read_table(spark, d, "documents").select("doc_id", "lang").join(read_table(spark, d, "labels"), "doc_id")
    return rounded(metrics.adjusted_rand(both, "lang", "quality"))


@query(
    "cluster_profile",
    f"""WITH {UNITS}, {CENTROIDS_SQL}, {NEAREST_SQL}, j AS (SELECT l.*, cluster FROM l JOIN near USING (listing_id)),
o AS (SELECT cluster, string_agg(address, ' | ' ORDER BY listing_id) AS sample FROM
 (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY listing_id) AS i FROM j) WHERE i <= 3 GROUP BY 1)
SELECT cluster, {r('median(unit)', 4)} AS unit_median, count(*) AS size, {r('avg(lat)')} AS lat_mean,
 {r('avg(lon)')} AS lon_mean, {r('median(usd_price)', 4)} AS price_median, any_value(sample) AS sample
FROM j JOIN o USING (cluster) GROUP BY 1""",
)
def cluster_profile(spark, d):
    df = geo.assign_nearest(unit_listings(spark, d), centroids(spark), ["lat", "lon"])
    profile = segment.cluster_profile(df, "cluster", "unit", "usd_price", "lat", "lon", "address", "listing_id")
    joined = profile.withColumn("sample", F.array_join("sample", " | "))
    return rounded(joined, {"unit_median": 4, "price_median": 4})


# Series as weighted points: mean z-scores of coordinates and winsorised log unit price.
MICRO_SQL = f"""{UNITS}, u AS (SELECT *, ln(1 + unit) AS v FROM l WHERE lon > 70 AND lon < 80 AND unit IS NOT NULL),
q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM u),
w AS (SELECT series, lat, lon, least(greatest(v, lo), hi) AS v FROM u CROSS JOIN q),
z AS (SELECT avg(lat) AS ma, stddev_pop(lat) AS sa, avg(lon) AS mb, stddev_pop(lon) AS sb, avg(v) AS mc,
      stddev_pop(v) AS sc FROM w),
micro AS (SELECT (row_number() OVER (ORDER BY series) - 1)::INTEGER AS id, series, count(*)::DOUBLE AS n,
      avg((lat - ma) / sa) AS a, avg((lon - mb) / sb) AS b, avg((v - mc) / sc) AS c
      FROM w CROSS JOIN z WHERE series IS NOT NULL GROUP BY series),
tot AS (SELECT count(*)::INTEGER AS m FROM micro),
ward(step, l_id, r_id, height, size, cs) AS (
 SELECT -1, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE,
  list(struct_pack(id := id, n := n, a := a, b := b, c := c, m := [id]) ORDER BY id) FROM micro
 UNION ALL
 SELECT step + 1, best.i, best.j, sqrt(2 * best.cost), best.n,
  list_append(list_filter(cs, lambda x: x.id <> best.i AND x.id <> best.j),
   struct_pack(id := tot.m + step + 1, n := best.n, a := best.a, b := best.b, c := best.c, m := best.m))
 FROM (SELECT step, cs, list_sort(flatten(list_transform(cs, lambda p: list_transform(
   list_filter(cs, lambda q: q.id > p.id), lambda q: struct_pack(
    cost := p.n * q.n / (p.n + q.n) * (pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2)),
    i := p.id, j := q.id, n := p.n + q.n, a := (p.n * p.a + q.n * q.a) / (p.n + q.n),
    b := (p.n * p.b + q.n * q.b) / (p.n + q.n), c := (p.n * p.c + q.n * q.c) / (p.n + q.n),
    m := list_concat(p.m, q.m))))))[1] AS best FROM ward WHERE len(cs) > 1) pick CROSS JOIN tot)"""

_GAP_SQL = """h AS (SELECT step, height, row_number() OVER (ORDER BY step DESC) AS k FROM ward WHERE step >= 0),
gap AS (SELECT k::INTEGER AS k, (height + coalesce(lag(height) OVER (ORDER BY k), height)) / 2 AS threshold,
        coalesce(lag(height) OVER (ORDER BY k), height) - height AS gap FROM h),
best AS (SELECT * FROM gap WHERE k BETWEEN 3 AND 12 ORDER BY gap DESC, k LIMIT 1)"""


def _series_points(spark, d):
    df = filters.range_filter(unit_listings(spark, d), "lon", 70, 80).dropna(subset=["unit"])
    df = filters.winsorize(df.withColumn("v", F.log1p("unit")), "v").select("series", "lat", "lon", "v")
    scaled = filters.ZScore(cols=["lat", "lon", "v"]).fit(df).transform(df).dropna(subset=["series"])
    return scaled.groupBy("series").agg(
        F.count("*").alias("size"), F.avg("lat_z").alias("a"), F.avg("lon_z").alias("b"), F.avg("v_z").alias("c")
    )


def _series_merges(spark, d):
    return segment.ward_merges(_series_points(spark, d), "series", "size", ["a", "b", "c"])


@query(
    "ward_merges",
    f'WITH RECURSIVE {MICRO_SQL} SELECT step, l_id AS "left", r_id AS "right", {r("height")} AS height,'
    " size::BIGINT AS size FROM ward WHERE step >= 0",
)
def ward_merges(spark, d):
    return rounded(_series_merges(spark, d))


@query(
    "largest_gap_cut",
    f"WITH RECURSIVE {MICRO_SQL}, {_GAP_SQL} SELECT k, {r('threshold')} AS threshold, {r('gap')} AS gap FROM best",
)
def largest_gap_cut(spark, d):
    return rounded(segment.largest_gap_cut(_series_merges(spark, d), 3, 12))


@query(
    "cut_labels",
    f"""WITH RECURSIVE {MICRO_SQL}, {_GAP_SQL},
state AS (SELECT cs FROM ward CROSS JOIN best WHERE len(cs) = k),
member AS (SELECT list_min(c.m) AS first, unnest(c.m) AS id FROM (SELECT unnest(cs) AS c FROM state))
SELECT id AS point, series, (dense_rank() OVER (ORDER BY first))::INTEGER AS label FROM member JOIN micro USING (id)""",
)
def cut_labels(spark, d):
    points = _series_points(spark, d)
    merges = segment.ward_merges(points, "series", "size", ["a", "b", "c"])
    threshold = segment.largest_gap_cut(merges, 3, 12).first()["threshold"]
    names = sorted(row["series"] for row in points.select("series").collect())  # as many as the merge allows
    numbered = spark.createDataFrame(list(enumerate(names)), "point int, series string")
    return segment.cut_labels(merges, len(names), threshold).join(numbered, "point")
