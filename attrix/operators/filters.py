"""Filters and predicates (FLT-1 … FLT-10).

Plain ``where`` clauses: Catalyst pushes them into the Parquet scan
(``PushedFilters``) when they touch stored columns.  Two rules of the
original are kept: an empty selection list means "no filter" (N15), and a
missing column or the "all" choice returns the table unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims


def by_view(df: DataFrame, mode: str = "all", target: str = dims.TARGET) -> DataFrame:
    """FLT-1: all / churned / not churned."""
    if mode == "churned":
        return df.where(F.col(target) == 1)
    if mode == "not_churned":
        return df.where(F.col(target) == 0)
    return df


def by_values(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """FLT-2 / FLT-6 / FLT-7: membership; an empty or missing list keeps all rows."""
    if not values:
        return df
    return df.where(F.col(column).isin(list(values)))


def active_only(df: DataFrame, truth_col: str = "y_true") -> DataFrame:
    """FLT-3: customers still active (truth == 0), when the column exists."""
    if truth_col not in df.columns:
        return df
    return df.where(F.col(truth_col) == 0)


def by_risk_level(df: DataFrame, risk_level: str, risk_col: str = "risk_level") -> DataFrame:
    """FLT-4: one risk class; 'Todos' or a missing column keeps all rows."""
    if risk_level == dims.RISK_ALL or risk_col not in df.columns:
        return df
    return df.where(F.col(risk_col) == F.lit(risk_level))


def drop_null_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FLT-5."""
    return df.dropna(subset=list(columns))


def outside_range(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """FLT-9: rows with a value below ``lower`` or above ``upper``."""
    c = F.col(column)
    return df.where((c < F.lit(lower)) | (c > F.lit(upper)))


def row_for(df: DataFrame, key_col: str, key) -> DataFrame:
    """FLT-8: rows for one key (e.g. one model's metrics)."""
    return df.where(F.col(key_col) == F.lit(key))


def require_rows(df: DataFrame, message: str = "no rows left after filtering") -> DataFrame:
    """FLT-10: stop when a filter leaves nothing (one cheap ``isEmpty`` probe)."""
    if df.isEmpty():
        raise ValueError(message)
    return df
