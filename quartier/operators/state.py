"""Fit/apply building blocks: JSON-configured estimators and stored lookup tables."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartier.operators.lookup import lookup, stored


class Configured(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Settings held as one JSON param, so that Spark's own writer stores them."""

    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)
    DEFAULTS: dict = {}

    def __init__(self, **settings):
        super().__init__()
        self._set(settings=json.dumps({**self.DEFAULTS, **settings}))

    @property
    def conf(self) -> dict:
        return json.loads(self.getOrDefault(self.settings))


class FitStep(Configured, Estimator):
    """An estimator configured by keyword arguments."""


class FittedStep(Configured, Model):
    """A fitted model: the estimator's settings plus a small ``state``."""

    state_json = Param(Params._dummy(), "state_json", "fitted state as JSON", TypeConverters.toString)

    def __init__(self, state: dict | None = None, **settings):
        super().__init__(**settings)
        self._set(state_json=json.dumps(state or {}))

    @property
    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.state_json))


    def write(self) -> MLWriter:
        return _StepWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StepReader(cls)


class _StepWriter(DefaultParamsWriter):
    """Settings and state, and beside them a copy of every table that the state only points to."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for key, kept in self.instance.state.items():
            if isinstance(kept, dict) and "path" in kept:
                kept_table(self.sparkSession, kept).write.parquet(f"{path}/tables/{key}")


class _StepReader(DefaultParamsReader):
    """The loaded step points to the copies in its own folder."""

    def load(self, path: str) -> FittedStep:
        step = super().load(path)
        state = step.state
        for key, kept in state.items():
            if isinstance(kept, dict) and "path" in kept:
                kept["path"] = f"{path}/tables/{key}"
        return step._set(state_json=json.dumps(state))


def keep_table(table: DataFrame, name: str) -> dict:
    """Hold a fitted table: inline if proven small, else as parquet in the shared folder until the step is saved."""
    copy, small, path = stored(table, name)
    kept = {"schema": table.schema.json()}
    return {**kept, "rows": [list(r) for r in copy.collect()]} if small else {**kept, "path": path}


def kept_table(spark: SparkSession, kept: dict) -> DataFrame:
    if "path" in kept:
        return spark.read.parquet(kept["path"])
    schema = T.StructType.fromJson(json.loads(kept["schema"]))
    return spark.createDataFrame([tuple(r) for r in kept["rows"]], schema)


def lookup_kept(df: DataFrame, kept: dict, on: list[str]) -> DataFrame:
    """Left join to a kept table; an inline one is small by construction."""
    table = kept_table(df.sparkSession, kept)
    if "rows" in kept:
        return df.join(F.broadcast(table), on, "left")
    return lookup(df, table, on)
