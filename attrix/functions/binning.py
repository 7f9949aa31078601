"""``cut``: interval binning as one generated ``CASE WHEN`` column.

Semantics follow ``pandas.cut``: ``right=True`` gives ``(a, b]`` intervals,
``right=False`` gives ``[a, b)``; ``include_lowest`` closes the first
interval on the left; values outside every interval and NULLs map to NULL.
``Bucketizer`` is not used because it closes the top edge, which changes
``weekly_hours = 50`` from NULL to the last bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col_of


def _edge_text(x: float) -> str:
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return repr(float(x))


def interval_labels(edges: Sequence[float], right: bool = True) -> list[str]:
    """Default labels when none are given: interval text."""
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        if right:
            out.append(f"({_edge_text(lo)}, {_edge_text(hi)}]")
        else:
            out.append(f"[{_edge_text(lo)}, {_edge_text(hi)})")
    return out


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None,
        right: bool = True, include_lowest: bool = False) -> Column:
    if len(edges) < 2:
        raise ValueError("cut needs at least two edges")
    if any(b <= a for a, b in zip(edges[:-1], edges[1:])):
        raise ValueError("bin edges must increase")
    labels = list(labels) if labels is not None else interval_labels(edges, right)
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    x = col_of(c)
    expr = None
    for i, (lo, hi, label) in enumerate(zip(edges[:-1], edges[1:], labels)):
        lo_l, hi_l = F.lit(float(lo)), F.lit(float(hi))
        if right:
            lower_ok = (x >= lo_l) if (i == 0 and include_lowest) else (x > lo_l)
            cond = lower_ok & (x <= hi_l)
        else:
            cond = (x >= lo_l) & (x < hi_l)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def label_table(spark, labels: Sequence[str], label_col: str = "bin",
                order_col: str = "bin_order"):
    """Small (label, ordinal) table: the declared category order, for dense
    bin results and ordered sorts.  Its size is the number of labels."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)],
                                 f"`{label_col}` string, `{order_col}` int")
