"""Parsers for the packed listing strings, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinel for an unknown room count, the wording and units of the
# listing site, and the whitespace class (ASCII blanks, line separators, Unicode spaces).
ROOMS_UNDEFINED = 1000
SIX_OR_MORE = "6 и более"
SPACE = r"[\s\p{Z}\x{85}]"
ROOMS_PATTERN = rf"^{SPACE}*(\d+){SPACE}*-комн"
FLOOR_PATTERN = rf"^{SPACE}*(\d+){SPACE}*этаж{SPACE}*из{SPACE}*(\d+)"
AREA_PATTERN = rf"^{SPACE}*([\d.]+){SPACE}*м2"
LIVING_PATTERN = rf"жилая:{SPACE}*([\d.]+){SPACE}*м2"
LATER_YEAR_PATTERN = rf",[^,]*?(\d{{4}}){SPACE}*г"
EDGE_SPACE_PATTERN = rf"^{SPACE}+|{SPACE}+$"


def _group(text: Column, pattern: str, index: int, to: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit("")).try_cast(to)


def rooms(title: Column) -> Column:
    """Room count; six for "six or more", the sentinel for anything else or NULL."""
    return F.coalesce(
        _group(title, ROOMS_PATTERN, 1, "int"),
        F.when(title.contains(SIX_OR_MORE), F.lit(6)),
        F.lit(ROOMS_UNDEFINED),
    )


def floor_pair(text: Column) -> Column:
    """Struct(floor, total_floors); both NULL unless both are stated."""
    return F.struct(
        _group(text, FLOOR_PATTERN, 1, "double").alias("floor"),
        _group(text, FLOOR_PATTERN, 2, "double").alias("total_floors"),
    )


def area_pair(text: Column) -> Column:
    """Struct(area_total, area_living), each independent of the other."""
    return F.struct(
        _group(text, AREA_PATTERN, 1, "double").alias("area_total"),
        _group(text, LIVING_PATTERN, 1, "double").alias("area_living"),
    )


def house_pair(text: Column) -> Column:
    """Struct(building_material, build_year): first part, and first later part with a year."""
    return F.struct(
        F.regexp_replace(F.substring_index(text, ",", 1), EDGE_SPACE_PATTERN, "").alias("building_material"),
        _group(text, LATER_YEAR_PATTERN, 1, "double").alias("build_year"),
    )


def parse_listing(df: DataFrame, title: str, floor: str, area: str, house: str) -> DataFrame:
    """Replace the four packed columns of ``df`` by the seven typed ones."""
    return (
        df.withColumns(
            {
                "rooms": rooms(F.col(title)),
                "_floor": floor_pair(F.col(floor)),
                "_area": area_pair(F.col(area)),
                "_house": house_pair(F.col(house)),
            }
        )
        .select("*", "_floor.*", "_area.*", "_house.*")
        .drop("_floor", "_area", "_house", title, floor, area, house)
    )
