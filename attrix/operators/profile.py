"""Aggregations and profiles (AGG-1 … AGG-29).

All of them are ``groupBy().agg()`` plans: partial aggregation on the map
side, one shuffle on the group keys, final aggregation — so a hot group
(one plan holding a third of the customers) collapses to one row per map
task before it moves.  Several statistics of one table are computed in one
``agg`` (one scan, one shuffle) rather than one grouping per statistic.
Quantiles and modes use :mod:`attrix.operators.quantiles` (exact, bounded
tasks).  Result tables are tiny (one row per segment) and stay DataFrames;
nothing is collected.

Null keys: pandas drops them by default, some functions keep them
(``dropna=False``), R keeps them — each operator takes ``keep_null_group``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..functions.binning import cut, label_table
from ..functions.columns import classify_risk, half_even
from .fences import fenced_quartiles
from .groups import attach_per_group
from .quantiles import exact_quantiles, modes


def _drop_null_keys(df: DataFrame, keys: Sequence[str], keep_null_group: bool) -> DataFrame:
    if keep_null_group:
        return df
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def _rate(target: str) -> Column:
    return F.avg(F.col(target).cast("double"))


# -- AGG-1/2: global churn ---------------------------------------------------------

def churn_rate(df: DataFrame, target: str = dims.TARGET) -> DataFrame:
    """AGG-1: overall churn rate in percent (one row)."""
    return df.agg((_rate(target) * 100.0).alias("churn_rate_pct"))


def global_churn_split(df: DataFrame, target: str = dims.TARGET) -> DataFrame:
    """AGG-2: two rows, 'No churn' and 'Churn' with their share in percent."""
    one = df.agg((_rate(target) * 100.0).alias("churn"))
    return one.select(F.explode(F.array(
        F.struct(F.lit(dims.TARGET_LABELS[0]).alias("status"),
                 (F.lit(100.0) - F.col("churn")).alias("percentage")),
        F.struct(F.lit(dims.TARGET_LABELS[1]).alias("status"),
                 F.col("churn").alias("percentage")))).alias("s")).select("s.*")


# -- AGG-3..5, 18: churn by category --------------------------------------------------

def churn_rate_by_segment(df: DataFrame, group_col: str, target: str = dims.TARGET,
                          digits: int = 3, keep_null_group: bool = True) -> DataFrame:
    """AGG-3 ``build_churn_rate_by_segment``: mean target per group, null group
    kept, rounded half-even, highest first."""
    out = (_drop_null_keys(df, [group_col], keep_null_group)
           .groupBy(group_col).agg(half_even(_rate(target), digits).alias("churn_rate")))
    return out.orderBy(F.col("churn_rate").desc_nulls_last(), F.col(group_col).asc_nulls_last())


def churn_pct_by_category(df: DataFrame, category_col: str, target: str = dims.TARGET,
                          sort_desc: bool = True, keep_null_group: bool = False) -> DataFrame:
    """AGG-4 / AGG-18: churn % per category; null group dropped by default."""
    out = (_drop_null_keys(df, [category_col], keep_null_group)
           .groupBy(category_col).agg((_rate(target) * 100.0).alias("churn_pct")))
    if sort_desc:
        return out.orderBy(F.col("churn_pct").desc_nulls_last(), F.col(category_col).asc_nulls_last())
    return out.orderBy(F.col(category_col).asc_nulls_last())


def churn_table_by_category(df: DataFrame, col: str, target: str = dims.TARGET,
                            count_name: str = "n_obs", keep_null_group: bool = False,
                            sort_by: str = "churn_rate") -> DataFrame:
    """AGG-5 / AGG-14 / AGG-15: non-null count and mean of the target per
    category, sorted by rate (or by count)."""
    out = (_drop_null_keys(df, [col], keep_null_group)
           .groupBy(col).agg(F.count(target).alias(count_name),
                             _rate(target).alias("churn_rate")))
    key = "churn_rate" if sort_by == "churn_rate" else count_name
    return out.orderBy(F.col(key).desc_nulls_last(), F.col(col).asc_nulls_last())


# -- AGG-6..8: dense bins ---------------------------------------------------------------

def _dense_bins(df: DataFrame, bin_col: str, labels: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate per bin and keep every declared bin (empty ones get NULL
    rates / zero counts), in declared order.  The label table has one row
    per label: a fixed, broadcast-size dimension."""
    spark = df.sparkSession
    labels_df = label_table(spark, labels, bin_col, "__order")
    agg = df.where(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(*aggs)
    return (F.broadcast(labels_df).join(agg, bin_col, "left")
            .orderBy("__order").drop("__order"))


def churn_by_numeric_bins(df: DataFrame, numeric_col: str, edges: Sequence[float],
                          labels: Sequence[str] | None = None, target: str = dims.TARGET,
                          bin_col: str | None = None, right: bool = True,
                          include_lowest: bool = True) -> DataFrame:
    """AGG-6 ``plot_churn_by_numeric_bins``: churn % per bin, empty bins shown."""
    from ..functions.binning import interval_labels
    bin_col = bin_col or f"{numeric_col}_bin"
    labels = list(labels) if labels is not None else interval_labels(edges, right)
    binned = df.select(cut(numeric_col, edges, labels, right, include_lowest).alias(bin_col),
                       F.col(target))
    out = _dense_bins(binned, bin_col, labels, [(_rate(target) * 100.0).alias("churn_pct")])
    return out


def churn_by_bin_column(df: DataFrame, bin_col: str, labels: Sequence[str],
                        target: str = dims.TARGET, as_pct: bool = False) -> DataFrame:
    """AGG-6 (age group) / AGG-7 / AGG-8: count + rate for an existing bin
    column, every declared bin present, in bin order."""
    if bin_col not in df.columns:
        raise ValueError(f"{bin_col} is not a column of the table")
    rate = _rate(target) * 100.0 if as_pct else _rate(target)
    out = _dense_bins(df.select(bin_col, target), bin_col, labels,
                      [F.count(target).alias("n_obs"), rate.alias("churn_rate")])
    return out.withColumn("n_obs", F.coalesce(F.col("n_obs"), F.lit(0)).cast("long"))


# -- AGG-9/10: segment summaries ---------------------------------------------------------

SEGMENT_METRICS = {
    "weekly_hours": "weekly_hours_media",
    "song_skip_rate": "skip_rate_media",
    "num_subscription_pauses": "pauses_media",
    "engagement_index": "engagement_media",
}


def segment_summary(df: DataFrame, group_col: str, target: str = dims.TARGET,
                    digits: int = 3) -> DataFrame:
    """AGG-9 ``build_segment_summary``: rows, churn rate and the means of the
    metrics that exist, per segment (null segment kept), rounded half-even,
    highest churn first.  One aggregate, one shuffle."""
    aggs = [F.count(F.lit(1)).alias("n_clientes"), half_even(_rate(target), digits).alias("churn_rate")]
    for src, name in SEGMENT_METRICS.items():
        if src in df.columns:
            aggs.append(half_even(F.avg(F.col(src).cast("double")), digits).alias(name))
    return (df.groupBy(F.col(group_col).alias("segmento")).agg(*aggs)
              .orderBy(F.col("churn_rate").desc_nulls_last(), F.col("segmento").asc_nulls_last()))


def two_key_summary(df: DataFrame, key1: str = "subscription_type",
                    key2: str = "customer_service_inquiries", target: str = dims.TARGET,
                    keep_null_group: bool = True) -> DataFrame:
    """AGG-10: plan x inquiries summary — churn rate, mean hours, mean skip
    rate, mean pauses (nulls ignored) and row count; highest churn first."""
    return (_drop_null_keys(df, [key1, key2], keep_null_group)
            .groupBy(key1, key2)
            .agg(_rate(target).alias("churn_rate"),
                 F.avg("weekly_hours").alias("avg_weekly_hours"),
                 F.avg("song_skip_rate").alias("avg_skip_rate"),
                 F.avg(F.col("num_subscription_pauses").cast("double")).alias("avg_pauses"),
                 F.count(F.lit(1)).alias("n_customers"))
            .orderBy(F.col("churn_rate").desc_nulls_last(), F.col(key1).asc_nulls_last(),
                     F.col(key2).asc_nulls_last()))


# -- AGG-11..15: geography ------------------------------------------------------------------

def customers_by_state(df: DataFrame, value: str = "count", target: str = dims.TARGET) -> DataFrame:
    """AGG-11 / AGG-12: customers (or churn rate) per (location, state code);
    rows without a state code are dropped first, as the map page does."""
    base = df.where(F.col("state_code").isNotNull())
    base = _drop_null_keys(base, ["location"], False)
    agg = F.count(F.lit(1)) if value == "count" else _rate(target)
    return base.groupBy("location", "state_code").agg(agg.alias("value"))


def region_map_table(df: DataFrame, value: str = "count", target: str = dims.TARGET) -> DataFrame:
    """AGG-13: customers (or churn rate) per region, with coordinates."""
    from .features import add_region_coords
    base = df.where(F.col("region").isNotNull())
    agg = F.count(F.lit(1)) if value == "count" else _rate(target)
    return base.groupBy("region").agg(agg.alias("value")).transform(add_region_coords)


# -- AGG-16: cross-tab ----------------------------------------------------------------------

def churn_crosstab(df: DataFrame, row_col: str, col_col: str, values: Sequence | None = None,
                   target: str = dims.TARGET, scale: float = 100.0) -> DataFrame:
    """AGG-16: churn rate (in %) for each (row, column) pair as a wide table.

    Pass ``values`` (the column categories) to avoid the extra distinct job;
    a missing combination is NULL.  Null keys are dropped (pandas pivot)."""
    base = _drop_null_keys(df, [row_col, col_col], False)
    val = F.col(target).cast("double") * F.lit(scale)
    if values is None:
        return base.groupBy(row_col).pivot(col_col).agg(F.avg(val)).orderBy(row_col)
    # known categories: one conditional aggregate, one shuffle (``pivot``
    # would aggregate twice)
    cells = [F.avg(F.when(F.col(col_col) == F.lit(v), val)).alias(str(v)) for v in values]
    return base.groupBy(row_col).agg(*cells).orderBy(row_col)


# -- AGG-17, 21, 22: distribution statistics ------------------------------------------------

def describe_by_group(df: DataFrame, value: str, group_col: str, digits: int | None = 3) -> DataFrame:
    """AGG-17: count, mean, median, sample std, min, max per group (null
    group dropped); rounded half-even like the page.  Count, mean, std, min
    and max ride along the quantile operator's first pass, which also has the
    groups whose values are all missing (count 0): two scans total."""
    base = df.where(F.col(group_col).isNotNull())
    v = F.col("v")
    out = exact_quantiles(base, value, [0.5], [group_col], names=["median"], keep_empty=True, extra_aggs=[
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max")])
    if digits is not None:
        out = out.select(group_col, "count",
                         *[half_even(c, digits).alias(c) for c in ["mean", "median", "std", "min", "max"]])
    return out.select(group_col, "count", "mean", "median", "std", "min", "max")


def outliers_iqr(df: DataFrame, numeric_cols: Sequence[str], iqr_factor: float = 1.5) -> DataFrame:
    """AGG-21 ``detect_outliers_iqr``: per column q1, q3, iqr, bounds, number
    and percent (of the values that are neither NULL nor NaN, rounded to 2) of values
    outside.  All columns in two scans of the wide rows (:mod:`.fences`)."""
    found = fenced_quartiles(df, numeric_cols, iqr_factor)
    return (found.withColumn("iqr", F.col("q3") - F.col("q1"))
                 .withColumn("pct_outliers", half_even(F.col("n_outliers") * 100.0 / F.col("n"), 2))
                 .select("column", "q1", "q3", "iqr", "lower_bound", "upper_bound", "n_outliers",
                         "pct_outliers")
                 .orderBy(F.col("pct_outliers").desc(), "column"))


def boxplot_long(df: DataFrame, metric_col: str, churn_col: str = dims.TARGET,
                 group_name: str = "grupo") -> DataFrame:
    """AGG-22 ``build_numeric_boxplot_df``: (metric, churn, group label)."""
    from ..functions.columns import target_label
    if metric_col not in df.columns or churn_col not in df.columns:
        return df.sparkSession.createDataFrame([], "x string").limit(0)
    return df.select(metric_col, churn_col, target_label(churn_col).alias(group_name))


def boxplot_stats(df: DataFrame, value: str, group_col: str, whisker: float = 1.5) -> DataFrame:
    """AGG-22: q1, median, q3, whiskers (most extreme values inside
    1.5 IQR) and number of outliers per group, in two scans (:mod:`.fences`)."""
    base = df.where(F.col(group_col).isNotNull())
    return (fenced_quartiles(base, [value], whisker, [group_col])
            .select(group_col, "n", "q1", "median", "q3", "lower_whisker", "upper_whisker", "n_outliers")
            .orderBy(group_col))


# -- AGG-19/20: missing values and overview ------------------------------------------------------

def _is_missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_values(df: DataFrame) -> DataFrame:
    """AGG-19 ``check_missing_values``: one pass counting nulls of every
    column (NaN counts as missing), unpivoted to (column, n, %)."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.sum(_is_missing(f).cast("long")).alias(f"m{i}")
                      for i, f in enumerate(df.schema.fields)])
    entries = [F.struct(F.lit(f.name).alias("column"), F.col(f"m{i}").alias("n_missing"))
               for i, f in enumerate(df.schema.fields)]
    return (counts.select("__rows", F.explode(F.array(*entries)).alias("e"))
            .select("e.column", F.coalesce("e.n_missing", F.lit(0)).cast("long").alias("n_missing"),
                    half_even(F.try_divide(F.col("e.n_missing") * 100.0, F.col("__rows")), 2)
                    .alias("pct_missing"))
            .orderBy(F.col("pct_missing").desc_nulls_last(), "column"))


def basic_overview(df: DataFrame, target: str = dims.TARGET) -> DataFrame:
    """AGG-20: one row: rows, columns, total nulls, churn rate (if the target
    exists) and the column types as text."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            sum((F.sum(_is_missing(f).cast("long")) for f in df.schema.fields),
                F.lit(0)).alias("n_nulls")]
    if target in df.columns:
        aggs.append(_rate(target).alias("churn_rate"))
    types = ", ".join(f"{n}:{t}" for n, t in df.dtypes)
    return df.agg(*aggs).select(F.col("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                                "n_nulls", *(["churn_rate"] if target in df.columns else []),
                                F.lit(types).alias("dtypes"))


# -- AGG-23/24: histograms and densities --------------------------------------------------------------

def histogram_by_group(df: DataFrame, value: str, group_col: str, nbins: int = 30,
                       density: bool = False) -> DataFrame:
    """AGG-23: equal-width bins over the global [min, max]; count (or density
    normalised per group) per (group, bin).  The maximum falls into bin
    ``nbins + 1`` of ``width_bucket`` and is clamped into the last bin."""
    base = df.where(F.col(value).isNotNull()).select(group_col, F.col(value).cast("double").alias("v"))
    rng = base.agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    width = (F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(F.lit(1.0))
             / F.lit(float(nbins)))
    b = F.least(F.floor((F.col("v") - F.col("__lo")) / F.col("__w")) + 1, F.lit(nbins))
    counts = (base.crossJoin(F.broadcast(rng.select("__lo", width.alias("__w"))))
              .groupBy(group_col, b.alias("bin"), "__lo", "__w")
              .agg(F.count(F.lit(1)).alias("count")))
    out = (counts.withColumn("bin_start", F.col("__lo") + (F.col("bin") - 1) * F.col("__w"))
                 .withColumn("bin_end", F.col("bin_start") + F.col("__w")))
    if density:
        totals = base.groupBy(group_col).agg(F.count(F.lit(1)).alias("__n"))
        out = (attach_per_group(out, totals, [group_col])
                  .withColumn("density", F.col("count") / (F.col("__n") * F.col("__w")))
                  .drop("__n"))
    return out.drop("__lo", "__w").orderBy(group_col, "bin")


# -- AGG-25..29: counts and column profiles ---------------------------------------------------------

def value_counts_ordered(df: DataFrame, col: str = "risk_level",
                         order: Sequence[str] = tuple(dims.RISK_ORDER)) -> DataFrame:
    """AGG-25: counts per value in a declared category order (null dropped)."""
    order_expr = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.when(order_expr > 0, order_expr).asc_nulls_last(), col))


def normalized_value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG-26: share of each value, nulls kept as a group; the total is a
    one-row aggregate broadcast to the (small) count table."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__t"))
    return (counts.crossJoin(F.broadcast(total))
            .select(col, (F.col("__c") / F.col("__t")).alias("proportion"))
            .orderBy(F.col("proportion").desc(), F.col(col).asc_nulls_last()))


def scoring_kpis(df: DataFrame, proba: str = "p_churn", risk: str = "risk_level") -> DataFrame:
    """AGG-27: number of scored customers, mean probability, share high and
    share medium risk (risk derived from the probability when absent)."""
    r = F.col(risk) if risk in df.columns else classify_risk(proba)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg(proba).alias("avg_p_churn"),
                  F.avg((r == F.lit(dims.RISK_HIGH)).cast("double")).alias("pct_high"),
                  F.avg((r == F.lit(dims.RISK_MEDIUM)).cast("double")).alias("pct_medium"))


def numeric_profile(df: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """AGG-28 (numbers): min, max and exact median per numeric column, long
    format (column, min, max, median); NULL and NaN are missing.  All columns in
    two scans of the wide rows (:mod:`.fences`)."""
    cols = [c for c in numeric_cols if c in df.columns]
    found = fenced_quartiles(df, cols).select(F.col("column").alias("c"), "min", "max", "median")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(found, F.col("column") == F.col("c"), "left")
                 .select("column", "min", "max", "median").orderBy("column"))


def text_options(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """AGG-28 (text): sorted distinct non-null values per text column, as
    rows (column, value) — never collected into one array."""
    cols = [c for c in text_cols if c in df.columns]
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
              .unpivot([], cols, "column", "value"))
    return long.where(F.col("value").isNotNull()).distinct().orderBy("column", "value")


def default_profile(df: DataFrame, numeric_cols: Sequence[str], text_cols: Sequence[str]) -> DataFrame:
    """AGG-29: default value per column — exact median for numbers (0.0 when
    all null), most frequent text for categories ('Unknown' when all null,
    ties to the smallest).  Long format (column, kind, num_value, text_value)."""
    spark = df.sparkSession
    ncols = [c for c in numeric_cols if c in df.columns]
    tcols = [c for c in text_cols if c in df.columns]
    parts = []
    if ncols:
        med = fenced_quartiles(df, ncols).select("column", F.col("median").alias("m"))
        names = spark.createDataFrame([(c,) for c in ncols], "column string")
        parts.append(names.join(med, "column", "left").select(
            "column", F.lit("numeric").alias("kind"),
            F.coalesce("m", F.lit(0.0)).alias("num_value"),
            F.lit(None).cast("string").alias("text_value")))
    if tcols:
        long = (df.select(*[F.col(c).cast("string").alias(c) for c in tcols])
                  .unpivot([], tcols, "column", "value"))
        md = modes(long, "value", ["column"], name="m")
        names = spark.createDataFrame([(c,) for c in tcols], "column string")
        parts.append(names.join(md, "column", "left").select(
            "column", F.lit("text").alias("kind"), F.lit(None).cast("double").alias("num_value"),
            F.coalesce("m", F.lit("Unknown")).alias("text_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_with_counts(df: DataFrame, group_col: str, target: str = dims.TARGET) -> DataFrame:
    """JN-1 folded: the mean table and the size table of the original, joined
    null-safely on the key, are one aggregate here."""
    return df.groupBy(group_col).agg(_rate(target).alias("churn_rate"),
                                     F.count(F.lit(1)).alias("n"))
