"""Queries on scanning, parsing, row expressions, filters, imputation and grouping."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quartier.functions import exprs, parse
from quartier.operators import filters, groupings
from quartier.operators.folds import with_fold
from quartier.operators.impute import GroupMedianImputer, GroupMedianImputerModel, fill_label, mode_smallest, shape
from quartier.operators.impute import missing_report as missing_table
from quartier.plans.catalog.registry import (
    LINE_KEY, LINE_KEY_SQL, LISTINGS, UNITS, fold_sql, query, r, rounded, unit_lines, unit_listings,
)
from quartier.plans.prepare import UNFINISHED, fit_preparation, listing_imputer
from quartier.session import scratch_path
from quartier.sources import tables
from quartier.sources.listings import CLEAN_SQL, clean_listings, raw_listings


@query("scan_csv_roundtrip", CLEAN_SQL)
def scan_csv_roundtrip(spark, d):
    df = clean_listings(spark, d)
    path = scratch_path(spark, "listings-csv")
    tables.write_delimited(df, path)
    return tables.read_delimited(spark, path, df.schema, escaped=True)


@query("scan_csv_texts", "SELECT doc_id, text, lang FROM documents")
def scan_csv_texts(spark, d):
    """Texts with line breaks, quotes and backslashes come back as they were."""
    df = tables.read_table(spark, d, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "texts-csv")
    tables.write_delimited(df, path)
    return tables.read_delimited(spark, path, df.schema, escaped=True)


_NUMBERS = ["l_quantity", "l_linenumber"]


@query(
    "mode_numbers",
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::VARCHAR AS mode, count(*) AS n, {c}::DOUBLE AS v FROM lineitem"
        f" WHERE {c} IS NOT NULL GROUP BY {c}" for c in _NUMBERS
    ) + ") SELECT feature, arg_min(mode, (-n, v)) AS mode, max(n) AS count FROM c GROUP BY 1",
)
def mode_numbers(spark, d):
    return mode_smallest(tables.read_table(spark, d, "lineitem"), _NUMBERS)


@query("clean_listings", CLEAN_SQL)
def clean(spark, d):
    return clean_listings(spark, d)


@query("table_shape", f"SELECT count(*) AS rows, 16 AS columns FROM ({CLEAN_SQL}) c")
def table_shape(spark, d):
    return shape(clean_listings(spark, d)).drop("types")


@query(
    "short_addresses",
    f"WITH {LISTINGS} SELECT listing_id, CASE WHEN len(address) > 30 THEN substr(address, 1, 30) || '…'"
    " ELSE address END AS address FROM l",
)
def short_addresses(spark, d):
    return clean_listings(spark, d).select("listing_id", exprs.shortened(F.col("address"), 30).alias("address"))


@query("parse_rooms", f"SELECT listing_id, rooms FROM ({CLEAN_SQL}) c")
def parse_rooms(spark, d):
    return raw_listings(spark, d).select("listing_id", parse.rooms(F.col("main")).alias("rooms"))


@query("parse_floor", f"SELECT listing_id, floor, total_floors FROM ({CLEAN_SQL}) c")
def parse_floor(spark, d):
    pair = parse.floor_pair(F.col("floor_text")).alias("_p")
    return raw_listings(spark, d).select("listing_id", pair).select("listing_id", "_p.*")


@query("parse_area", f"SELECT listing_id, area_total, area_living FROM ({CLEAN_SQL}) c")
def parse_area(spark, d):
    pair = parse.area_pair(F.col("area_text")).alias("_p")
    return raw_listings(spark, d).select("listing_id", pair).select("listing_id", "_p.*")


@query("parse_house", f"SELECT listing_id, building_material, build_year FROM ({CLEAN_SQL}) c")
def parse_house(spark, d):
    pair = parse.house_pair(F.col("house")).alias("_p")
    return raw_listings(spark, d).select("listing_id", pair).select("listing_id", "_p.*")


@query(
    "price_per_unit",
    f"SELECT {LINE_KEY_SQL}, {r('l_extendedprice / nullif(l_quantity, 0)', 9)} AS unit FROM lineitem",
)
def price_per_unit(spark, d):
    return rounded(unit_lines(spark, d).select(*LINE_KEY, "unit"), 9)


@query(
    "log_target",
    f"WITH {UNITS} SELECT listing_id, {r('ln(1 + usd_price)')} AS log_price,"
    f" {r('CASE WHEN unit > 0 THEN ln(unit) END')} AS log_unit, {r('ln(1 + area_total)')} AS log_area,"
    f" {r('exp(ln(1 + usd_price)) - 1', 2)} AS price_back FROM l",
)
def log_target(spark, d):
    df = unit_listings(spark, d).select(
        "listing_id",
        exprs.log1p_of(F.col("usd_price")).alias("log_price"),
        exprs.log_of(F.col("unit")).alias("log_unit"),
        exprs.log1p_of(F.col("area_total")).alias("log_area"),
        F.expm1(F.log1p("usd_price")).alias("price_back"),
    )
    return rounded(df, {"price_back": 2})


@query("quad_feature", f"WITH {LISTINGS} SELECT listing_id, {r('area_total * area_total')} AS area_total_sq FROM l")
def quad_feature(spark, d):
    return rounded(clean_listings(spark, d).select("listing_id", F.pow("area_total", F.lit(2)).alias("area_total_sq")))


@query(
    "flags",
    f"WITH {LISTINGS} SELECT listing_id, coalesce((build_year < 2000)::INTEGER, 0) AS is_old,"
    " coalesce((rooms = 1000)::INTEGER, 0) AS is_free_layout,"
    " coalesce((condition IN ('1-URGENT', '2-HIGH'))::INTEGER, 0) AS condition_unfinished FROM l",
)
def flags(spark, d):
    df = clean_listings(spark, d).select(
        "listing_id",
        exprs.flag(F.col("build_year") < 2000).alias("is_old"),
        exprs.flag(F.col("rooms") == parse.ROOMS_UNDEFINED).alias("is_free_layout"),
        "condition",
    )
    return groupings.add_membership_flag(df, "condition", UNFINISHED, "condition_unfinished").drop("condition")


@query("sentinel_to_null", f"WITH {LISTINGS} SELECT listing_id, nullif(rooms, 1000) AS rooms FROM l")
def sentinel_to_null(spark, d):
    rooms = exprs.sentinel_to_null(F.col("rooms"), parse.ROOMS_UNDEFINED)
    return clean_listings(spark, d).select("listing_id", rooms.alias("rooms"))


@query(
    "sentinel_to_median",
    f"WITH {LISTINGS} SELECT listing_id, CASE WHEN rooms = 1000 THEN (SELECT median(rooms) FROM l"
    " WHERE rooms <> 1000) ELSE rooms::DOUBLE END AS rooms FROM l",
)
def sentinel_to_median(spark, d):
    df = clean_listings(spark, d).select("listing_id", "rooms")
    return filters.SentinelMedian(col="rooms", value=parse.ROOMS_UNDEFINED).fit(df).transform(df)


_LINE_UNITS = f"u AS (SELECT {LINE_KEY_SQL}, l_extendedprice / nullif(l_quantity, 0) AS unit FROM lineitem)"


@query(
    "clip_upper_q",
    f"WITH {_LINE_UNITS} SELECT {LINE_KEY_SQL}, {r('least(unit, (SELECT quantile_cont(unit, 0.99) FROM u))', 9)}"
    " AS unit FROM u",
)
def clip_upper_q(spark, d):
    return rounded(filters.clip_upper(unit_lines(spark, d).select(*LINE_KEY, "unit"), "unit"), 9)


_CLIPPED = (
    "least(greatest(ln(1 + unit), (SELECT quantile_cont(ln(1 + unit), 0.01) FROM l)),"
    " (SELECT quantile_cont(ln(1 + unit), 0.99) FROM l))"
)


@query("winsorize", f"WITH {UNITS} SELECT listing_id, {r(_CLIPPED)} AS log_unit FROM l")
def winsorize(spark, d):
    df = unit_listings(spark, d).select("listing_id", F.log1p("unit").alias("log_unit"))
    return rounded(filters.winsorize(df, "log_unit"))


@query(
    "fill_missing_label",
    f"WITH {LISTINGS} SELECT listing_id, coalesce(series, 'MISSING') AS series,"
    " coalesce(condition, 'unknown') AS condition FROM l",
)
def fill_missing_label(spark, d):
    df = clean_listings(spark, d).select("listing_id", "series", "condition")
    return fill_label(df, {"series": "MISSING", "condition": "unknown"})


@query(
    "zscore",
    "SELECT " + LINE_KEY_SQL + ", "
    + ", ".join(
        r(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)") + f" AS {c}_z"
        for c in ("l_quantity", "l_extendedprice")
    )
    + " FROM lineitem",
)
def zscore(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    df = tables.read_table(spark, d, "lineitem").select(*LINE_KEY, *cols)
    return rounded(filters.ZScore(cols=cols).fit(df).transform(df).drop(*cols))


@query(
    "unit_price_from_log",
    f"WITH {LISTINGS} SELECT listing_id, {r('(exp(0.9::DOUBLE * ln(1 + usd_price)) - 1) / nullif(area_total, 0)')} AS unit FROM l",
)
def unit_price_from_log(spark, d):
    unit = exprs.unit_price_from_log(0.9 * F.log1p("usd_price"), F.col("area_total"))
    return rounded(clean_listings(spark, d).select("listing_id", unit.alias("unit")))


@query(
    "derived_ratios",
    f"WITH {LISTINGS} SELECT listing_id, 2026 - build_year AS building_age,"
    " coalesce((build_year > 2026)::INTEGER, 0) AS is_offplan,"
    f" {r('floor / nullif(total_floors, 0)')} AS floor_ratio,"
    " coalesce((floor = 1)::INTEGER, 0) AS is_first_floor,"
    " coalesce((floor = total_floors)::INTEGER, 0) AS is_last_floor,"
    f" {r('area_total / nullif(rooms, 0)')} AS area_per_room FROM l",
)
def derived_ratios(spark, d):
    df = clean_listings(spark, d).select("listing_id", "floor", "total_floors", "area_total", "rooms", "build_year")
    wide = exprs.derived_listing_columns(df, "floor", "total_floors", "area_total", "rooms", "build_year", 2026)
    return rounded(wide.drop("floor", "total_floors", "area_total", "rooms", "build_year"))


@query(
    "rare_level_merge",
    f"WITH {LISTINGS}, n AS (SELECT series, count(*) AS n FROM l GROUP BY series),"
    " m AS (SELECT avg(n) AS m FROM n WHERE series IS NOT NULL)"
    " SELECT listing_id, CASE WHEN l.series IS NULL OR n >= ceil(m) THEN l.series ELSE 'series_other' END"
    " AS series FROM l LEFT JOIN n ON n.series = l.series CROSS JOIN m",
)
def rare_level_merge(spark, d):
    df = clean_listings(spark, d).select("listing_id", "series")
    known = df.dropna(subset=["series"])
    mean = known.groupBy("series").count().agg(F.ceil(F.avg("count"))).first()[0]
    return filters.merge_rare_levels(df, "series", mean, "series_other", "series")


@query("geo_range_filter", f"WITH {LISTINGS} SELECT listing_id, lat, lon FROM l WHERE lon > 70 AND lon < 80")
def geo_range_filter(spark, d):
    return filters.range_filter(clean_listings(spark, d).select("listing_id", "lat", "lon"), "lon", 70, 80)


@query(
    "trim_quantile",
    f"WITH {_LINE_UNITS}, p AS (SELECT * FROM u WHERE unit > 0) SELECT {LINE_KEY_SQL}, {r('unit', 9)} AS unit FROM p"
    " WHERE unit >= (SELECT quantile_cont(unit, 0.01) FROM p) AND unit <= (SELECT quantile_cont(unit, 0.99) FROM p)",
)
def trim_quantile(spark, d):
    positive = unit_lines(spark, d).select(*LINE_KEY, "unit").where(F.col("unit") > 0)
    return rounded(filters.trim_quantile(positive, "unit"), 9)


@query(
    "trim_upper_strict",
    f"WITH {_LINE_UNITS} SELECT {LINE_KEY_SQL}, {r('unit', 9)} AS unit FROM u"
    " WHERE unit < (SELECT quantile_cont(unit, 0.99) FROM u)",
)
def trim_upper_strict(spark, d):
    return rounded(filters.trim_upper(unit_lines(spark, d).select(*LINE_KEY, "unit"), "unit"), 9)


@query(
    "living_area_filter",
    f"WITH {LISTINGS} SELECT listing_id, area_total, area_living FROM l"
    " WHERE NOT coalesce(area_living > area_total, false)",
)
def living_area_filter(spark, d):
    df = clean_listings(spark, d).select("listing_id", "area_total", "area_living")
    return filters.living_not_above_total(df, "area_living", "area_total")


@query(
    "drop_na_subset",
    f"WITH {LISTINGS} SELECT * FROM l WHERE floor IS NOT NULL AND total_floors IS NOT NULL AND series IS NOT NULL",
)
def drop_na_subset(spark, d):
    return clean_listings(spark, d).dropna(subset=["floor", "total_floors", "series"])


@query(
    "aligned_merge",
    f"WITH {LISTINGS} SELECT listing_id, lat, lon, usd_price, offer_type, series, condition FROM l",
)
def aligned_merge(spark, d):
    df = clean_listings(spark, d)
    left = df.select("listing_id", "lat", "lon", "usd_price")
    right = df.select("listing_id", "usd_price", "offer_type", "series", "condition")
    return filters.aligned_merge(left, right, "listing_id", "usd_price", ["offer_type", "series", "condition"])


def impute_sql(train: str, rows: str) -> str:
    """Fill ``rows`` by the statistics of ``train`` (both WITH-list names)."""
    return f"""
g AS (SELECT building_material AS bm, median(build_year) AS fill FROM {train}
      WHERE build_year IS NOT NULL AND building_material IS NOT NULL GROUP BY 1),
o AS (SELECT median(build_year) AS fill FROM {train}),
m AS (SELECT condition AS mode FROM (SELECT condition, count(*) AS n FROM {train}
      WHERE condition IS NOT NULL GROUP BY 1) ORDER BY n DESC, condition LIMIT 1),
f AS (SELECT x.* EXCLUDE (area_living, build_year, condition),
        coalesce(x.build_year, g.fill, o.fill) AS build_year, coalesce(x.condition, m.mode) AS condition
      FROM {rows} x LEFT JOIN g ON g.bm = x.building_material CROSS JOIN o CROSS JOIN m
      WHERE x.floor IS NOT NULL AND x.total_floors IS NOT NULL AND x.series IS NOT NULL)"""


_FILLED = "SELECT *, (build_year < 2000)::INTEGER AS is_old FROM f"
_IMPUTED = f"WITH {LISTINGS}, {impute_sql('l', 'l')} {_FILLED}"
_SPLIT = (
    f"train AS (SELECT * FROM l WHERE {fold_sql('listing_id')} <> 0),"
    f" test AS (SELECT * FROM l WHERE {fold_sql('listing_id')} = 0)"
)


@query(
    "impute_fit",
    f"WITH {LISTINGS}, {impute_sql('l', 'l')}"
    " SELECT 'group_median' AS kind, bm AS key, fill AS number, NULL::VARCHAR AS label FROM g"
    " UNION ALL SELECT 'global_median', NULL, fill, NULL FROM o"
    " UNION ALL SELECT 'mode', 'condition', NULL, mode FROM m",
)
def impute_fit(spark, d):
    df = clean_listings(spark, d)
    return listing_imputer().fit(df).table(df)


@query("impute_apply", _IMPUTED)
def impute_apply(spark, d):
    df = clean_listings(spark, d)
    return listing_imputer().fit(df).transform(df)


@query("impute_apply_heldout", f"WITH {LISTINGS}, {_SPLIT}, {impute_sql('train', 'test')} {_FILLED}")
def impute_apply_heldout(spark, d):
    df = with_fold(clean_listings(spark, d), "listing_id")
    model = listing_imputer().fit(df.where("fold <> 0"))
    return model.transform(df.where("fold = 0").drop("fold"))


@query("fit_apply_roundtrip", _IMPUTED)
def fit_apply_roundtrip(spark, d):
    df = clean_listings(spark, d)
    path = scratch_path(spark, "imputer")
    listing_imputer().fit(df).write().overwrite().save(path)
    return GroupMedianImputerModel.load(path).transform(df)


@query(
    "missing_report",
    f"WITH {LISTINGS}, {impute_sql('l', 'l')}, a AS ({_FILLED}),"
    " b1 AS (UNPIVOT (SELECT COLUMNS(*) IS NULL FROM l) ON COLUMNS(*) INTO NAME col VALUE gone),"
    " a1 AS (UNPIVOT (SELECT COLUMNS(*) IS NULL FROM a) ON COLUMNS(*) INTO NAME col VALUE gone),"
    " b AS (SELECT col, count_if(gone) AS before FROM b1 GROUP BY 1),"
    " aa AS (SELECT col, count_if(gone) AS after FROM a1 GROUP BY 1)"
    ' SELECT coalesce(b.col, aa.col) AS "column", before::BIGINT AS before, after::BIGINT AS after,'
    " CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'dropped' ELSE 'kept' END AS status"
    " FROM b FULL JOIN aa ON b.col = aa.col WHERE NOT coalesce(before = 0 AND after = 0, false)",
)
def missing_report(spark, d):
    df = clean_listings(spark, d)
    return missing_table(df, listing_imputer().fit(df).transform(df))


@query(
    "mode_smallest",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS feature, {c} AS mode, count(*) AS count FROM lineitem"
        f" GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def mode(spark, d):
    return mode_smallest(tables.read_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


_TERCILES = f"""WITH {UNITS},
s AS (SELECT series, median(unit) AS median, count(unit) AS count FROM l WHERE series IS NOT NULL GROUP BY 1),
q AS (SELECT quantile_cont(median, 1/3::DOUBLE) AS q_low, quantile_cont(median, 2/3::DOUBLE) AS q_high FROM s),
t AS (SELECT s.*, CASE WHEN median <= q_low THEN 'low' WHEN median <= q_high THEN 'mid' ELSE 'high' END AS "group"
      FROM s CROSS JOIN q)"""


def _grouper(df):
    return groupings.TercileGrouper(category="series", value="unit", out="series_group").fit(df)


@query("tercile_groups", f'{_TERCILES} SELECT series, {r("median")} AS median, count, "group" FROM t')
def tercile_groups(spark, d):
    df = unit_listings(spark, d).select("series", "unit")
    return rounded(_grouper(df).levels(df))


@query("tercile_cuts", f"{_TERCILES} SELECT {r('q_low')} AS q_low, {r('q_high')} AS q_high FROM q")
def tercile_cuts(spark, d):
    df = unit_listings(spark, d).select("series", "unit")
    return rounded(_grouper(df).cuts(df))


@query(
    "group_counts_medians",
    f"""{_TERCILES}, n AS (SELECT "group", sum(count)::BIGINT AS count FROM t GROUP BY 1),
m AS (SELECT "group", median(unit) AS median FROM l JOIN t USING (series) GROUP BY 1)
SELECT g."group", coalesce(count, 0) AS count, {r('median')} AS median
FROM (VALUES ('low'), ('mid'), ('high')) g("group") LEFT JOIN n USING ("group") LEFT JOIN m USING ("group")""",
)
def group_counts_medians(spark, d):
    df = unit_listings(spark, d).select("series", "unit")
    return rounded(_grouper(df).group_table(df))


@query(
    "apply_groups",
    f"""WITH {UNITS}, {_SPLIT},
s AS (SELECT series, median(unit) AS median FROM train WHERE series IS NOT NULL GROUP BY 1),
q AS (SELECT quantile_cont(median, 1/3::DOUBLE) AS q_low, quantile_cont(median, 2/3::DOUBLE) AS q_high FROM s),
t AS (SELECT series, CASE WHEN median <= q_low THEN 'low' WHEN median <= q_high THEN 'mid' ELSE 'high' END AS g
      FROM s CROSS JOIN q)
SELECT listing_id, test.series, coalesce(g, 'mid') AS series_group FROM test LEFT JOIN t ON t.series = test.series""",
)
def apply_groups(spark, d):
    df = with_fold(unit_listings(spark, d).select("listing_id", "series", "unit"), "listing_id")
    model = _grouper(df.where("fold <> 0"))
    return model.transform(df.where("fold = 0").drop("fold", "unit"))


@query(
    "impute_by_group",
    f"WITH {LISTINGS}, g AS (SELECT building_material, median(build_year) AS fill FROM l GROUP BY 1),"
    " a AS (SELECT median(build_year) AS fill FROM l)"
    " SELECT listing_id, coalesce(build_year, g.fill, a.fill)::DOUBLE AS build_year FROM l"
    " LEFT JOIN g ON g.building_material = l.building_material CROSS JOIN a",
)
def impute_by_group(spark, d):
    """Look-up of a fitted median by group, then the overall one."""
    df = clean_listings(spark, d).select("listing_id", "building_material", F.col("build_year").cast("double").alias("build_year"))
    model = GroupMedianImputer(col="build_year", by="building_material").fit(df)
    return model.transform(df).select("listing_id", "build_year")


@query(
    "feature_table",
    f"""WITH {LISTINGS}, {_SPLIT},
ft AS (WITH {impute_sql('train', 'train')} {_FILLED}), fe AS (WITH {impute_sql('train', 'test')} {_FILLED}),
s AS (SELECT series, median(usd_price / nullif(area_total, 0)) AS median FROM ft WHERE series IS NOT NULL GROUP BY 1),
q AS (SELECT quantile_cont(median, 1/3::DOUBLE) AS q_low, quantile_cont(median, 2/3::DOUBLE) AS q_high FROM s),
t AS (SELECT series, CASE WHEN median <= q_low THEN 'low' WHEN median <= q_high THEN 'mid' ELSE 'high' END AS g
      FROM s CROSS JOIN q)
SELECT fe.*, coalesce((condition IN ('1-URGENT', '2-HIGH'))::INTEGER, 0) AS condition_unfinished,
       coalesce(g, 'mid') AS series_group FROM fe LEFT JOIN t ON t.series = fe.series""",
)
def feature_table(spark, d):
    """The whole preparation: fitted on training rows, saved, loaded and applied to the others."""
    df = with_fold(clean_listings(spark, d), "listing_id")
    path = scratch_path(spark, "preparation")
    fit_preparation(df.where("fold <> 0").drop("fold")).write().save(path)
    return PipelineModel.load(path).transform(df.where("fold = 0").drop("fold"))


_SCREEN = ["offer_type", "building_material", "is_old"]


@query(
    "weak_feature_screen",
    f"WITH {UNITS}, w AS (SELECT *, coalesce((build_year < 2000)::INTEGER, 0)::VARCHAR AS is_old FROM l), m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, median(unit) AS m FROM w WHERE {c} IS NOT NULL GROUP BY {c}" for c in _SCREEN
    )
    + f") SELECT feature, {r('max(m) - min(m)')} AS spread, (max(m) - min(m) < 30)::INTEGER AS weak"
    " FROM m GROUP BY 1",
)
def weak_feature_screen(spark, d):
    df = unit_listings(spark, d).withColumn("is_old", exprs.flag(F.col("build_year") < 2000))
    return rounded(groupings.weak_features(df, [*_SCREEN, "not_there"], "unit", 30).drop("medians"))


@query(
    "weak_feature_medians",
    f"WITH {UNITS}, w AS (SELECT *, coalesce((build_year < 2000)::INTEGER, 0)::VARCHAR AS is_old FROM l), m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS level, median(unit) AS m FROM w WHERE {c} IS NOT NULL GROUP BY {c}" for c in _SCREEN
    )
    + f") SELECT feature, level, {r('m')} AS median FROM m",
)
def weak_feature_medians(spark, d):
    df = unit_listings(spark, d).withColumn("is_old", exprs.flag(F.col("build_year") < 2000))
    screen = groupings.weak_features(df, _SCREEN, "unit", 30)
    return rounded(screen.select("feature", F.explode("medians").alias("level", "median")))
