"""Apply mode on a stream: stored statistics only, nothing is learnt from arriving rows."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def arriving_files(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """Parquet files below ``directory`` as a stream."""
    return spark.readStream.schema(schema).parquet(directory)


def score_stream(model: Model, stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Transform all files present, write parquet with exactly-once bookkeeping, then stop.

    ``checkpoint`` remembers the files done, so the next run takes up the new ones only.
    """
    return (
        model.transform(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
