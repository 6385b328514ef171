"""Registration of queries and the pieces their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.functions.exprs import ratio
from quartier.sources.listings import CLEAN_SQL, clean_listings
from quartier.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = ", ".join(LINE_KEY)

# WITH-list entries for the SQL twins.
LISTINGS = f"l AS MATERIALIZED ({CLEAN_SQL})"
UNITS = f"l AS MATERIALIZED (SELECT *, usd_price / nullif(area_total, 0) AS unit FROM ({CLEAN_SQL}) clean)"


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and its SQL twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round the double columns, so that summation order does not show.

    Halves go up by the same arithmetic in both engines, whose own ``round`` differ on ties.
    """
    places = digits if isinstance(digits, dict) else {}
    default = 6 if isinstance(digits, dict) else digits

    def scale(name: str):
        return F.lit(10.0 ** places.get(name, default))

    return df.select(
        [
            (F.floor(F.col(f"`{f.name}`") * scale(f.name) + 0.5) / scale(f.name)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in the SQL twin."""
    scale = f"1e{digits}::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def unit_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed listings with their unit price."""
    listings = clean_listings(spark, sf_dir)
    return listings.withColumn("unit", ratio(F.col("usd_price"), F.col("area_total")))


def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with price per piece."""
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.withColumn("unit", ratio(F.col("l_extendedprice"), F.col("l_quantity")))


def fold_sql(key: str, k: int = 5, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {k})::INTEGER"
