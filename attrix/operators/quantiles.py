"""Exact quantiles, medians and modes without one task per group.

``percentile`` / ``median`` / ``mode`` in Spark keep a value -> count map per
group and merge it in one task: a group holding a third of 100 TB would not
fit.  These operators give the same exact answers with bounded work per
task:

1. one partial-aggregated pass computes, per group, the row count and a
   Greenwald-Khanna sketch (``percentile_approx``, bounded memory).  The
   sketch's rank error is at most ``n / accuracy``, so the values at
   probabilities ``p -/+ margin`` bracket the exact order statistics (a
   group with fewer than ``accuracy`` rows is its own bracket);
2. a second pass counts, per group, the rows below each bracket (partial
   aggregation again) and keeps only the rows inside a bracket — about
   ``2 * margin * n`` rows, with duplicates collapsed by a group-by;
3. those few rows are ranked exactly (window per (group, probability)),
   and the two neighbouring order statistics are interpolated linearly —
   the rule of ``numpy.quantile``, Spark ``percentile`` and DuckDB
   ``quantile_cont``.

The band still grows with the group (``2 * margin * n`` rows).  When the
largest group's band would exceed ``band_rows_per_task`` rows (a group of
billions of rows), step 3 gets a second level: the band is cut into
equal-width sub-buckets, their counts are prefix-summed on a small table,
and only the one or two sub-buckets that hold a wanted rank are ranked,
each in its own window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import MAX_BROADCAST_GROUPS, cache_small

DEFAULT_ACCURACY = 10000
_MARGIN_FACTOR = 4.0
# above this many band rows in one (group, probability) window, rank inside
# sub-buckets of the band instead
BAND_ROWS_PER_TASK = 2_000_000
SUB_BUCKETS = 4096


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY,
                    names: Sequence[str] | None = None, extra_aggs: Sequence = (),
                    band_rows_per_task: int = BAND_ROWS_PER_TASK,
                    sub_buckets: int = SUB_BUCKETS, keep_empty: bool = False) -> DataFrame:
    """One row per group with a non-null value: group columns + one column per
    probability (``q0``, ``q1``… or ``names``), exact with linear interpolation.

    ``extra_aggs`` are aggregate expressions over the non-null values (column
    ``v``) computed in the first pass and returned alongside (e.g. count,
    mean, min, max), so a profile needs no extra scan.  ``keep_empty`` also
    returns the groups without any value (quantiles NULL)."""
    # group columns go by names that no column made below has
    g = [f"__g{i}" for i in range(len(group_cols))]
    named = [F.col(k).alias(c) for k, c in zip(g, group_cols, strict=True)]
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    margin = _MARGIN_FACTOR / accuracy
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(c).alias(k) for k, c in zip(g, group_cols, strict=True)], F.when(~F.isnan(v), v).alias("v"))
    data = rows.where(F.col("v").isNotNull())

    # pass 1: count + sketch per group -> bracket [lower_j, upper_j] per probability
    fracs = []
    for p in probs:
        fracs += [max(0.0, p - margin), min(1.0, p + margin)]
    sketch = [F.count("v").alias("n"),
              F.percentile_approx("v", fracs, accuracy).alias("__s"), *extra_aggs]
    stats = (rows if keep_empty else data).groupBy(*g).agg(*sketch)
    extras = [c for c in stats.columns if c not in (*g, "n", "__s")]
    # Rank guarantee: the sketch answer at q has rank within n/accuracy of
    # q*n, and the wanted 0-based positions floor/ceil((n-1)p) lie within two
    # elements of p*n; with margin 4/accuracy the bracket holds them once
    # n >= accuracy.  A smaller group takes its whole range as the band
    # (fewer than ``accuracy`` rows).
    small = F.col("n") < F.lit(accuracy)
    first_pass = cache_small(stats.select(*g, "n", *extras, *[
        F.when(F.lit(p - margin <= 0.0) | small, F.lit(float("-inf")))
         .otherwise(F.col("__s")[2 * j]).alias(f"lo{j}") for j, p in enumerate(probs)], *[
        F.when(F.lit(p + margin >= 1.0) | small, F.lit(float("inf")))
         .otherwise(F.col("__s")[2 * j + 1]).alias(f"hi{j}") for j, p in enumerate(probs)]))
    bounds = first_pass.where(F.col("n") > 0).drop(*extras)
    # one job on the small cached table: its size (broadcast check) and the
    # largest group (band size)
    n_groups, max_n = bounds.agg(F.count(F.lit(1)), F.max("n")).first()
    max_n = max_n or 0
    largest_band = min(max_n, 2 * margin * max_n + 4) if max_n >= accuracy else max_n

    # pass 2: each row falls below a bracket (counted in one sentinel row per
    # bracket, value -inf) or inside it; duplicates collapse map-side
    if not g:
        joined = data.crossJoin(F.broadcast(bounds))
    elif n_groups <= MAX_BROADCAST_GROUPS:
        joined = data.join(F.broadcast(bounds), g)
    else:
        joined = data.join(bounds, g)
    parts = []
    for j in range(len(probs)):
        lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
        parts.append(F.when(F.col("v") < lo, F.struct(F.lit(j).alias("j"), F.lit(float("-inf")).alias("k")))
                      .when(F.col("v") <= hi, F.struct(F.lit(j).alias("j"), F.col("v").alias("k"))))
    band = (joined.select(*g, "n", F.explode(F.array_compact(F.array(*parts))).alias("e"))
                  .select(*g, "n", "e.j", "e.k")
                  .groupBy(*g, "n", "j", "k").agg(F.count(F.lit(1)).alias("c")))
    out = _interpolated(band, g, probs, names, largest_band, band_rows_per_task, sub_buckets)
    if extras or keep_empty:
        kept = first_pass if keep_empty or not g else first_pass.where(F.col("n") > 0)
        kept = kept.select(*g, *extras)
        if not g:
            return kept.crossJoin(F.broadcast(out))
        out = out.withColumnsRenamed({k: f"__key_{k}" for k in g})
        same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in g]
        return kept.join(out, same, "left").select(*named, *names, *extras)
    return out.select(*named, *names)


def _interpolated(band: DataFrame, g: Sequence[str], probs: Sequence[float], names: Sequence[str],
                  largest_band: float, band_rows_per_task: int, sub_buckets: int) -> DataFrame:
    """The quantiles of each group from its band: rows (group columns, ``n`` rows of
    the group, ``j`` probability, ``k`` value or -inf for all below, ``c`` rows)."""
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    h = (F.col("n") - 1) * F.element_at(probs_arr, F.col("j") + 1)
    if largest_band > band_rows_per_task:
        ranked = _rank_in_sub_buckets(band, g, h, sub_buckets)
    else:
        # one small shuffle by group; the window and the pick below reuse it
        if g:
            band = band.repartition(*g)
        w_in = Window.partitionBy(*g, "j").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        ranked = band.withColumn("cum", F.sum("c").over(w_in))
    ranked = (ranked.withColumn("h", h)
                    .withColumn("lo", F.floor("h").cast("long"))
                    .withColumn("hi", F.ceil("h").cast("long"))
                    .withColumn("first_pos", F.col("cum") - F.col("c"))
                    .withColumn("last_pos", F.col("cum") - 1))
    aggs = []
    for j, name in enumerate(names):
        mine = F.col("j") == j
        at_lo = mine & (F.col("lo") >= F.col("first_pos")) & (F.col("lo") <= F.col("last_pos"))
        at_hi = mine & (F.col("hi") >= F.col("first_pos")) & (F.col("hi") <= F.col("last_pos"))
        aggs += [F.max(F.when(at_lo, F.col("k"))).alias(f"__xlo{j}"),
                 F.max(F.when(at_hi, F.col("k"))).alias(f"__xhi{j}"),
                 F.max(F.when(mine, F.col("h") - F.col("lo"))).alias(f"__t{j}")]
    picked = ranked.groupBy(*g).agg(*aggs) if g else ranked.agg(*aggs)
    # equal neighbours (also +/-inf) are the answer as they are
    out = picked.select(*g, *[
        F.when(F.col(f"__xlo{j}") == F.col(f"__xhi{j}"), F.col(f"__xlo{j}"))
         .otherwise(F.col(f"__xlo{j}") + F.col(f"__t{j}") * (F.col(f"__xhi{j}") - F.col(f"__xlo{j}")))
         .alias(name)
        for j, name in enumerate(names)])
    return out


def leave_one_out_medians(long: DataFrame, n_folds: int, accuracy: int = DEFAULT_ACCURACY,
                          band_rows_per_task: int = BAND_ROWS_PER_TASK) -> tuple[list, DataFrame]:
    """Exact medians of every column over all rows but those of one fold, for all
    folds and for the whole table, from one sketch and one band pass.

    ``long`` has rows (column, fold, value).  A sketch per column and fold brackets
    the fold's own median; the median of any union of folds lies between the least
    and the largest of them, so one band per column serves all unions.  The rows of
    the band and the number below it are counted per fold, and a union's counts are
    the sums of its folds'.  Returns the statistics per column and fold (rows n,
    mean, m2: one per column and fold) and the table (column, left_out, median);
    ``left_out`` -1 is the whole table."""
    data = long.select("column", "fold", F.col("value").cast("double").alias("v")) \
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    margin = _MARGIN_FACTOR / accuracy
    stats = data.groupBy("column", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count(F.lit(1))).alias("m2"),
        F.percentile_approx("v", [0.5 - margin, 0.5 + margin], accuracy).alias("s")).collect()
    names = sorted({r["column"] for r in stats})
    spark = long.sparkSession
    if not names:
        return stats, spark.createDataFrame([], "column string, left_out int, median double")
    low, high, size = {}, {}, {}
    for r in stats:
        small = r["n"] < accuracy
        c = r["column"]
        low[c] = min(low.get(c, float("inf")), float("-inf") if small else r["s"][0])
        high[c] = max(high.get(c, float("-inf")), float("inf") if small else r["s"][1])
        for k in range(-1, n_folds):
            if k != r["fold"]:
                size[c, k] = size.get((c, k), 0) + r["n"]
    bounds = spark.createDataFrame([(c, low[c], high[c]) for c in names], "column string, lo double, hi double")
    kept = data.join(F.broadcast(bounds), "column").where(F.col("v") <= F.col("hi"))      # a row per column
    band = (kept.select("column", "fold", F.when(F.col("v") < F.col("lo"), F.lit(float("-inf"))).otherwise(F.col("v")).alias("k"))
            .groupBy("column", "fold", "k").agg(F.count(F.lit(1)).alias("c")))
    unions = F.array(*[F.lit(k) for k in range(-1, n_folds)])
    band = (band.withColumn("left_out", F.explode(F.filter(unions, lambda u: u != F.col("fold"))))
            .groupBy("column", "left_out", "k").agg(F.sum("c").alias("c")))
    sizes = spark.createDataFrame([(c, k, n) for (c, k), n in size.items()], "column string, left_out int, n long")
    band = band.join(F.broadcast(sizes), ["column", "left_out"]).withColumn("j", F.lit(0))
    out = _interpolated(band, ["column", "left_out"], [0.5], ["median"], max(size.values()) if min(low.values()) == float("-inf")
                        else 2 * margin * max(size.values()) * n_folds, band_rows_per_task, SUB_BUCKETS)
    return stats, out


def _rank_in_sub_buckets(band: DataFrame, g: Sequence[str], h, sub_buckets: int) -> DataFrame:
    """Cumulative counts (``cum``) for the band rows that can hold a wanted
    rank, without one window over the whole band of a group.

    The band (one row per distinct value, with its count ``c``; the rows
    below the bracket are one ``-inf`` row) is written to the shared
    checkpoint folder, so the passes below read it, not the source, and
    survive a lost executor.  Finite values fall into ``sub_buckets``
    equal-width slices of the band's range (``-inf`` before, ``+inf``
    after); slice counts are prefix-summed per (group, probability) on a
    table of at most ``groups x probabilities x sub_buckets`` rows; only the
    slices holding position ``floor(h)`` or ``ceil(h)`` are kept and ranked,
    each slice in its own window partition."""
    from ..session import ensure_checkpoint_dir
    from .groups import attach_per_group
    keys = [*g, "j"]
    ensure_checkpoint_dir(band.sparkSession)
    band = band.checkpoint()
    k = F.col("k")
    finite = F.abs(k) < F.lit(float("inf"))
    rng = band.where(finite).groupBy(*keys).agg(F.min("k").alias("__kmin"), F.max("k").alias("__kmax"))
    span = F.col("__kmax") - F.col("__kmin")
    slice_no = (F.when(k == F.lit(float("-inf")), F.lit(-1))
                 .when(k == F.lit(float("inf")), F.lit(sub_buckets))
                 .when(span > 0, F.least(F.floor((k - F.col("__kmin")) / span * sub_buckets).cast("int"),
                                         F.lit(sub_buckets - 1)))
                 .otherwise(F.lit(0)))
    keyed = (attach_per_group(band, rng, keys, how="left")
             .withColumn("__sb", slice_no).drop("__kmin", "__kmax"))
    w_sub = Window.partitionBy(*keys).orderBy("__sb").rowsBetween(Window.unboundedPreceding, 0)
    slices = (keyed.groupBy(*keys, "n", "__sb").agg(F.sum("c").alias("__sc"))
                   .withColumn("__scum", F.sum("__sc").over(w_sub))
                   .withColumn("__first", F.col("__scum") - F.col("__sc")))
    lo, hi = F.floor(h), F.ceil(h)
    inside = lambda pos: (pos >= F.col("__first")) & (pos < F.col("__scum"))
    wanted = slices.where(inside(lo) | inside(hi)).select(*keys, "__sb", "__first")
    w_in = Window.partitionBy(*keys, "__sb").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (attach_per_group(keyed, wanted, [*keys, "__sb"])
            .withColumn("cum", F.col("__first") + F.sum("c").over(w_in))
            .drop("__sb", "__first"))


def exact_median(df: DataFrame, value: str, group_cols: Sequence[str] = (),
                 name: str = "median", accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    return exact_quantiles(df, value, [0.5], group_cols, accuracy, names=[name])


def modes(df: DataFrame, value: str, group_cols: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; ties -> the smallest value
    (pandas ``mode().iloc[0]``).  Two partial-aggregated group-bys, no
    per-group map in one task."""
    g = list(group_cols)
    counts = (df.select(*g, F.col(value).alias("v")).where(F.col("v").isNotNull())
                .groupBy(*g, "v").agg(F.count(F.lit(1)).alias("c")))
    pick = F.min_by("v", F.struct((-F.col("c")).alias("nc"), F.col("v").alias("vv"))).alias(name)
    return counts.groupBy(*g).agg(pick) if g else counts.agg(pick)
