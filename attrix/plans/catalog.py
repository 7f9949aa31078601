"""Registry of named queries: Spark plan + optional oracle SQL.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, sql or None)``.
Queries read the test tables (or views Spark derives from them), so their
work grows with the scale factor; none runs on fixed literal input alone.
Doubles are rounded to 6 places in both engines where summation order can
differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for a summation-order-free comparison)."""
    return df.select([F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                      for f in df.schema.fields])


def load_all() -> dict:
    """Import every query module (they register on import)."""
    from . import queries_agg, queries_ml, queries_prj, queries_rest  # noqa: F401
    return REGISTRY
