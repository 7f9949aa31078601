"""Joins (JN-1 … JN-4).

The original joins only small summaries and dictionaries.  A scalar
aggregate is one row, so broadcasting it is safe; every other join is left to
the optimizer, which broadcasts a side only below its size threshold (AQE
measures it at run time).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def dimension(spark: SparkSession, mapping: Mapping, key: str, value: str,
              value_type: str = "string") -> DataFrame:
    """A lookup dictionary as a table.  The optimizer knows its exact size."""
    return spark.createDataFrame([(k, v) for k, v in mapping.items()],
                                 f"`{key}` string, `{value}` {value_type}")


def lookup_join(df: DataFrame, dim: DataFrame, on: str | Sequence[str] | Column,
                how: str = "left") -> DataFrame:
    """JN-2: dictionary lookup (miss -> NULL).  No hint: the optimizer
    broadcasts a dimension below its size threshold and shuffles a larger one."""
    return df.join(dim, on, how)


def null_safe_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-1 general form: left join where a NULL key matches a NULL key."""
    r = right.withColumnRenamed(key, "__rk")
    return left.join(r, left[key].eqNullSafe(r["__rk"]), "left").drop("__rk")


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """JN-3: attach a one-row aggregate to every row (broadcast nested loop
    join over exactly one row).  Any other number of rows raises."""
    one = scalars.agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct("*")).alias("__s"))
    checked = one.select(F.when(F.col("__n") != 1, F.raise_error(F.concat(
        F.lit("attach_scalars needs exactly one row, got "), F.col("__n").cast("string")))).otherwise(F.col("__s")).alias("__s"))
    return df.crossJoin(F.broadcast(checked.select("__s.*")))
