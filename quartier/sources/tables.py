"""Table scans and sinks: parquet, delimited text with missing markers, stored state, JSON."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.functions.exprs import nan_to_null
from quartier.session import scratch_path

# The cell texts a delimited scan reads as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def nan_as_null(df: DataFrame) -> DataFrame:
    """One missing marker: every floating NaN becomes NULL."""
    floating = {
        f.name: nan_to_null(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


# A line break would end a row for a reader that splits files, so the writer marks it; in this order, undone likewise.
_MARKS = [("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r")]


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, escaped: bool = False, multi_line: bool = False
) -> DataFrame:
    """Scan delimited text with a header; missing-value tokens become NULL in every column.

    Cells are read as text and cast, so that a token such as ``N/A`` in a number column is a
    missing value and any other unreadable number is an error, not a silent NULL.
    ``escaped`` undoes what ``write_delimited`` did to line breaks; ``multi_line`` reads quoted line breaks
    of other writers, at the price of one task a file.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )

    def typed(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        text = F.when(~c.isin(NA_TOKENS), c)
        for plain, mark in reversed(_MARKS) if escaped else []:
            text = F.replace(text, F.lit(mark), F.lit(plain))
        return text.cast(field.dataType).alias(field.name)

    return nan_as_null(raw.select([typed(f) for f in schema.fields]))


def write_delimited(df: DataFrame, path: str) -> None:
    """Delimited text with a header, one line a row: read it with ``escaped=True``."""
    for field in df.schema:
        if isinstance(field.dataType, T.StringType):
            text = F.col(f"`{field.name}`")
            for plain, mark in _MARKS:
                text = F.replace(text, F.lit(plain), F.lit(mark))
            df = df.withColumn(field.name, text)
    plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **plain).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    """Store a one-row fitted state as JSON."""
    state.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stored_state(state: DataFrame, name: str) -> DataFrame:
    """Write a fitted state to the shared folder and read it back."""
    path = scratch_path(state.sparkSession, name)
    write_state(state, path)
    return read_state(state.sparkSession, path, state.schema)


def nested_json(df: DataFrame, key: str, values: list[str], out: str = "json") -> DataFrame:
    """One JSON object per row: ``{key: {values...}}``."""
    entry = F.create_map(F.col(key).cast("string"), F.struct(*values))
    return df.select(key, F.to_json(entry).alias(out))


def metrics_json(metrics: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A whole result table (one row per variant) as a single JSON object."""
    entries = F.collect_list(F.struct(F.col(key), F.struct(*values)))
    return metrics.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def read_metrics_json(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Long (metric, value) table from one stored metric record."""
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in fields])
    record = spark.read.schema(schema).option("multiLine", True).json(path)
    return record.unpivot([], fields, "metric", "value")


def write_json_record(spark: SparkSession, record: dict, path: str) -> None:
    """Store one small metric record as JSON text."""
    spark.createDataFrame([(json.dumps(record),)], "value string").write.mode("overwrite").text(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
