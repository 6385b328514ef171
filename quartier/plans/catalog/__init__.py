"""Registered queries, each with its SQL twin where SQL can state it."""

from quartier.plans.catalog import (  # noqa: F401  (importing registers the queries)
    charts, encodings, evaluation, geography, models, preparation, profiling, segments, spread, texts,
)
from quartier.plans.catalog.registry import ORACLE, QUERIES  # noqa: F401
