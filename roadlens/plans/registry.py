"""Registry of named queries: each key has a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the result is expressible in SQL, an independent DuckDB oracle text over the same tables."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed "now" for every rule that compares with the current time, so results are reproducible.
AS_OF = "2024-01-30 12:00:00"


@dataclass
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    check: str  # "O" oracle, "R" rows only


REGISTRY: dict[str, Entry] = {}

_MODULES = ["roadlens.plans.validation_reports", "roadlens.plans.feature_reports", "roadlens.plans.join_reports",
            "roadlens.plans.aggregate_reports", "roadlens.plans.window_reports", "roadlens.plans.survival_reports",
            "roadlens.plans.set_reports", "roadlens.plans.scalar_reports", "roadlens.plans.io_reports",
            "roadlens.plans.stream_reports", "roadlens.plans.model_reports"]


def register(key: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[key] = Entry(key, fn, sql, "O" if sql else "R")
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    for m in _MODULES:
        importlib.import_module(m)
    return REGISTRY


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column so engine-specific summation order does not show."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def joined(col, sep: str = "|"):
    """Array -> text, null stays null (as SQL array_to_string does)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.concat_ws(sep, c))
