"""Attaching a per-group table (one row per group) to the rows of the groups.

With few groups a shuffle join on the group key is the hot-key case: every
row of a group lands in one task.  The per-group table is tiny in that case,
so it is broadcast — but only after its size is *checked*: it is cached
(a small result, recomputable from lineage) and counted; beyond
``MAX_BROADCAST_GROUPS`` rows the join stays a shuffle join, where many
groups spread the rows anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 200_000

# small tables cached for a size check; released by release_small_tables()
_SMALL_CACHED: list[DataFrame] = []


def cache_small(df: DataFrame) -> DataFrame:
    """Cache a small derived table (per-group or per-bucket) and remember it,
    so a long-running job (one retraining per micro-batch) can release it."""
    df = df.cache()
    _SMALL_CACHED.append(df)
    return df


def release_small_tables() -> None:
    """Unpersist every table cached by :func:`cache_small`.  Always safe: a
    later use of such a table recomputes it from lineage."""
    while _SMALL_CACHED:
        _SMALL_CACHED.pop().unpersist()


def attach_per_group(rows: DataFrame, per_group: DataFrame, keys: Sequence[str],
                     how: str = "inner") -> DataFrame:
    keys = list(keys)
    if not keys:
        return rows.crossJoin(F.broadcast(per_group))
    per_group = cache_small(per_group)
    side = F.broadcast(per_group) if per_group.count() <= MAX_BROADCAST_GROUPS else per_group
    # null-safe: a NULL key is a group like any other
    side = side.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__key_{k}`")) for k in keys]
    return rows.join(side, same, how).drop(*[f"__key_{k}" for k in keys])
