"""Set and reshape operators (SET-1 … SET-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_batch(base: DataFrame, new: DataFrame) -> DataFrame:
    """SET-1: base + new batch in base column order.  An empty batch (no
    columns) gives the base; missing columns raise listing them; extra
    columns are ignored.  The column check is on the schema only."""
    if not new.columns:
        return base
    missing = [c for c in base.columns if c not in new.columns]
    if missing:
        raise ValueError(f"the new batch lacks required columns: {missing}")
    return base.unionByName(new.select(*[F.col(c).cast(base.schema[c].dataType) for c in base.columns]))


def append_records(log: DataFrame, records: DataFrame) -> DataFrame:
    """SET-2: append records whose columns may differ (missing -> NULL)."""
    return log.unionByName(records, allowMissingColumns=True)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-3: stack per-model result frames by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            variable: str = "metric", value: str = "score") -> DataFrame:
    """SET-4: wide metrics -> long (id…, metric, score)."""
    return df.unpivot(list(ids), list(values), variable, value)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """SET-5: sorted distinct non-null values (one shuffle; never collected)."""
    return df.select(column).dropna().distinct().orderBy(column)
