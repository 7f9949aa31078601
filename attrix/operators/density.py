"""Kernel density with a stated error (AGG-24).

The Gaussian kernel sum over all rows is too dear: rows x grid points.  Here every value
shares its weight between the two nodes of a fine grid next to it (linear binning), and the
kernel is summed over the nodes.  For a value this puts the straight line between the
kernel's values at the two nodes in place of the kernel, so with bandwidth ``h`` and nodes
``d`` apart the error of the density is at most

    d^2 / 8 * max|K''| / h^3  =  (d / h)^2 / 8 * peak,      peak = 1 / (h sqrt(2 pi)),

because the normal density's second derivative is largest at zero, where it is its peak.
Nodes further than ``r`` bandwidths from a grid point are left out, which changes at most
``exp(-r^2 / 2) * peak``.  Both parts get half of ``tolerance``; that fixes ``d`` and ``r``:
the number of nodes follows from the data, none is set by hand.

Two scans: one aggregate (n, deviation, ends per group), then one row per group and
occupied cell, aggregated before the shuffle.  Neither depends on the grid; a cell meets
only the grid points in its reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import attach_per_group, cache_small

#: Largest error of the density as a share of one kernel's peak.
TOLERANCE = 1e-6


def kde_by_group(df: DataFrame, value: str, group_col: str, grid_points: int = 200,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """AGG-24: Gaussian kernel density per group at ``grid_points`` points between the least and the
    largest value of all groups; bandwidth by Scott's factor as the plotting library uses it,
    ``std * n^(-1/5)``.  Rows (group, x, density, max_error): the density of all rows differs by at
    most ``max_error``.

    NULL, NaN and infinite values and rows without a group take no part; a group of one value or
    of equal values has no bandwidth and no rows."""
    if not 0 < tolerance < 1 or grid_points < 1:
        raise ValueError("tolerance must lie between 0 and 1, and there must be a grid point")
    g = "__group"
    base = (df.select(F.col(f"`{group_col}`").alias(g), F.col(f"`{value}`").cast("double").alias("v"))
              .where(F.col(f"`{g}`").isNotNull() & (F.abs("v") < float("inf"))))
    stats = cache_small(base.groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                                            F.min("v").alias("lo"), F.max("v").alias("hi")))
    low, high = stats.agg(F.min("lo"), F.max("hi")).first()
    low, high = (0.0, 1.0) if low is None else (low, high)
    apart = ((high - low) or 1.0) / max(1, grid_points - 1)
    reach = math.sqrt(-2 * math.log(tolerance / 2))

    peak = 1 / math.sqrt(2 * math.pi)
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    limits = (stats.withColumn("bw", bw).where(F.col("bw") > 0)
              .withColumn("cells", F.ceil((F.col("hi") - F.col("lo")) / (2 * math.sqrt(tolerance) * F.col("bw"))))
              .select(g, "n", "bw", "lo", "cells", ((F.col("hi") - F.col("lo")) / F.col("cells")).alias("step")))
    at = (F.col("v") - F.col("lo")) / F.col("step")
    cells = (attach_per_group(base, limits, [g])
             .select(g, at.alias("at"), F.least(F.floor(at), F.col("cells") - 1).alias("cell"))
             .groupBy(g, "cell").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("at") - F.col("cell")).alias("right")))

    def kernel(node: Column) -> Column:
        z = (F.lit(low) + F.col("gi") * apart - node) / F.col("bw")
        return F.exp(-0.5 * z * z)

    left = F.col("lo") + F.col("cell") * F.col("step")
    first = F.greatest(F.ceil((left - reach * F.col("bw") - low) / apart), F.lit(0))
    last = F.least(F.floor((left + F.col("step") + reach * F.col("bw") - low) / apart), F.lit(grid_points - 1))
    sums = (attach_per_group(cells, limits, [g]).where(first <= last)
            .select(g, "bw", "c", "right", left.alias("left"), (left + F.col("step")).alias("next"),
                    F.explode(F.sequence(first, last)).alias("gi"))
            .groupBy(g, "gi").agg(F.sum((F.col("c") - F.col("right")) * kernel(F.col("left"))
                                        + F.col("right") * kernel(F.col("next"))).alias("k")))
    points = limits.select(g, "n", "bw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid_points - 1).cast("long"))).alias("gi"))
    return (points.join(sums, [g, "gi"], "left")
            .select(F.col(g).alias(group_col), (F.lit(low) + F.col("gi") * apart).alias("x"),
                    (F.coalesce("k", F.lit(0.0)) * peak / (F.col("n") * F.col("bw"))).alias("density"),
                    (tolerance * peak / F.col("bw")).alias("max_error"))
            .orderBy(group_col, "x"))
