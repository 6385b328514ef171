"""A listing table derived from the test tables ``orders`` and ``part``.

The driver's tables hold no listings, so this view packs their columns into the strings,
coordinates and prices that the listing operators read (FIXTURES.md, section 2). The select
list is plain SQL so that the SQL oracle can state the very same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.functions.parse import parse_listing
from quartier.session import spread
from quartier.sources.tables import read_table

_COLUMNS = {
    "listing_id": "o_orderkey",
    "main": (
        "CASE WHEN o_orderkey % 97 = 0 THEN 'свободная планировка'"
        " WHEN o_orderkey % 53 = 0 THEN '6 и более комнат'"
        " ELSE concat(cast(p_size % 5 + 1 AS varchar(9)), '-комн. кв., ',"
        " cast(20 + p_size AS varchar(9)), ' м2') END"
    ),
    "address": (
        "concat('Бишкек, ', p_name, ', ', lower(p_type), ' ', cast(o_custkey % 40 AS varchar(9)))"
    ),
    "lat": "cast(42.80 + (o_custkey % 100) * 0.001 + (p_size % 7) * 0.0001 AS double)",
    "lon": (
        "cast(CASE WHEN o_orderkey % 1000 = 7 THEN 42.87"
        " ELSE 74.50 + ((o_custkey * 7) % 200) * 0.001 END AS double)"
    ),
    "offer_type": (
        "CASE WHEN o_orderkey % 7 = 0 THEN 'от собственника' ELSE 'от агента' END"
    ),
    "series": "CASE WHEN o_orderkey % 501 = 0 THEN NULL ELSE p_brand END",
    "house": (
        "concat(CASE o_custkey % 3 WHEN 0 THEN 'кирпичный' WHEN 1 THEN 'монолитный'"
        " ELSE 'панельный' END, CASE WHEN o_orderkey % 4 <> 0 THEN concat(', ',"
        " cast(1960 + (o_custkey * 13) % 66 AS varchar(9)), ' г.') ELSE '' END)"
    ),
    "floor_text": (
        "CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE concat(cast(p_size % 12 + 1 AS varchar(9)),"
        " ' этаж из ', cast(p_size % 12 + 1 + o_custkey % 5 AS varchar(9))) END"
    ),
    "area_text": (
        "concat(cast(20 + p_size * 3 AS varchar(9)), ' м2', CASE WHEN o_orderkey % 5 = 0 THEN"
        " concat(', жилая: ', cast(10 + p_size * 2 AS varchar(9)), '.5 м2') ELSE '' END)"
    ),
    "condition": "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_orderpriority END",
    "usd_price": "o_totalprice",
    "usd_price_syn": (
        "round(cast((20 + p_size * 3) * (900 + 6 * (o_custkey % 100) + 100 * (p_size % 3))"
        " * (1 + ((o_orderkey * 7919) % 100 - 50) / 500.0) AS double), 2)"
    ),
}
_SELECT = ", ".join(f"{expr} AS {name}" for name, expr in _COLUMNS.items())

RAW_SQL = (
    f"SELECT {_SELECT} FROM orders JOIN part"
    " ON p_partkey = o_orderkey % (SELECT count(*) FROM part)"
)

# The same typed table in the oracle's SQL: the parsers restated with its own functions.
SP = r"[\s\p{Z}\x{85}]"
CLEAN_SQL = rf"""
SELECT listing_id, address, lat, lon, offer_type, series,
  regexp_replace(string_split(house, ',')[1], '^{SP}+|{SP}+$', '', 'g') AS building_material,
  TRY_CAST(nullif(regexp_extract(list_filter(string_split(house, ',')[2:],
    lambda p: regexp_matches(p, '\d{{4}}{SP}*г'))[1], '(\d{{4}}){SP}*г', 1), '') AS DOUBLE) AS build_year,
  TRY_CAST(nullif(regexp_extract(floor_text, '^{SP}*(\d+){SP}*этаж{SP}*из{SP}*(\d+)', 1), '') AS DOUBLE) AS floor,
  TRY_CAST(nullif(regexp_extract(floor_text, '^{SP}*(\d+){SP}*этаж{SP}*из{SP}*(\d+)', 2), '') AS DOUBLE) AS total_floors,
  coalesce(TRY_CAST(nullif(regexp_extract(main, '^{SP}*(\d+){SP}*-комн', 1), '') AS INTEGER),
    CASE WHEN contains(main, '6 и более') THEN 6 END, 1000) AS rooms,
  TRY_CAST(nullif(regexp_extract(area_text, '^{SP}*([\d.]+){SP}*м2', 1), '') AS DOUBLE) AS area_total,
  TRY_CAST(nullif(regexp_extract(area_text, 'жилая:{SP}*([\d.]+){SP}*м2', 1), '') AS DOUBLE) AS area_living,
  condition, usd_price, usd_price_syn
FROM ({RAW_SQL}) raw_listings
"""

# The canonical column order of the typed table.
CLEAN_COLUMNS = [
    "listing_id", "address", "lat", "lon", "offer_type", "series", "building_material",
    "build_year", "floor", "total_floors", "rooms", "area_total", "area_living", "condition",
    "usd_price", "usd_price_syn",
]


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed listing strings, one row per order."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    part_rows = read_table(spark, sf_dir, "part").agg(F.count("*").alias("part_rows"))
    # Parsing costs far more than reading, so a small file must not hold it to one task.
    orders = (
        spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"))
        .crossJoin(F.broadcast(part_rows))  # one row
    )
    joined = orders.join(part, F.expr("p_partkey = o_orderkey % part_rows"))
    return joined.selectExpr([f"{expr} AS {name}" for name, expr in _COLUMNS.items()])


def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed listings in canonical column order."""
    raw = raw_listings(spark, sf_dir)
    return parse_listing(raw, "main", "floor_text", "area_text", "house").select(*CLEAN_COLUMNS)
