"""Sorts, limits and top-k (SRT-1 … SRT-7).

Every order has a unique tie-breaker, so results are deterministic (the
original's unstable sort leaves ties open).  ``orderBy(...).limit(k)`` plans
as ``TakeOrderedAndProject``: each task keeps its own top k and only k rows
per task reach the final merge — the limit is the feature (a top-k report).
Sorting all rows is a range-partitioned sort, never a collect.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import classify_risk
from .filters import active_only, by_risk_level


def _riskiest_first(df: DataFrame, proba_col: str, id_col: str) -> DataFrame:
    """Descending probability, unscored rows last, ties by id."""
    return df.orderBy(F.desc_nulls_last(proba_col), F.asc(id_col)) if proba_col in df.columns else df


def risk_table(df: DataFrame, active: bool, risk_level: str | None, truth_col: str, risk_col: str,
               proba_col: str, id_col: str) -> DataFrame:
    """One select: derived risk class where a level is asked for and the table
    has none, one predicate from the wanted filters, riskiest first."""
    derive = risk_level is not None and risk_col not in df.columns and proba_col in df.columns
    rows = df.withColumn(risk_col, classify_risk(proba_col)) if derive else df
    keep = [f for wanted, f in ((active, lambda x: active_only(x, truth_col)),
                                (risk_level is not None, lambda x: by_risk_level(x, risk_level, risk_col))) if wanted]
    return _riskiest_first(reduce(lambda x, f: f(x), keep, rows), proba_col, id_col)


def top_risk_customers(df: DataFrame, top_n: int = 20, active: bool = False,
                       truth_col: str = "y_true", proba_col: str = "p_churn",
                       id_col: str = "customer_id") -> DataFrame:
    """SRT-1: the riskiest ``top_n`` rows, optionally active customers only."""
    return risk_table(df, active, None, truth_col, "risk_level", proba_col, id_col).limit(top_n)


def filter_risk_table(df: DataFrame, risk_level: str = dims.RISK_ALL, active: bool = True,
                      truth_col: str = "y_true", risk_col: str = "risk_level",
                      proba_col: str = "p_churn", id_col: str = "customer_id") -> DataFrame:
    """SRT-2: active filter, risk class derived when absent, risk filter,
    highest probability first."""
    return risk_table(df, active, risk_level, truth_col, risk_col, proba_col, id_col)


def extremes(df: DataFrame, value_col: str, k: int = 10, key_col: str = "feature") -> DataFrame:
    """SRT-3: the k largest positive and the k most negative values together."""
    pos = df.where(F.col(value_col) > 0).orderBy(F.col(value_col).desc(), key_col).limit(k)
    neg = df.where(F.col(value_col) < 0).orderBy(F.col(value_col).asc(), key_col).limit(k)
    return pos.unionByName(neg)


def top_n_ascending(df: DataFrame, value_col: str, n: int = 15, key_col: str = "feature") -> DataFrame:
    """SRT-4: the n largest values, returned in ascending order (bar charts)."""
    top = df.orderBy(F.col(value_col).desc(), key_col).limit(n)
    return top.orderBy(F.col(value_col).asc(), key_col)


def sort_rows(df: DataFrame, by: str, ascending: bool = True, id_col: str | None = None) -> DataFrame:
    """SRT-5: all rows, pandas null placement (nulls last both ways)."""
    c = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(c, *([F.col(id_col).asc()] if id_col else []))


def sort_by_order(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """SRT-6: sort by a declared category order (unknown values last)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(pos > 0, pos).asc_nulls_last(), *then)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """SRT-7: first n rows of an already ordered table."""
    return df.limit(n)
