"""Classification metrics as DataFrame aggregates (ML-12 … ML-16, ML-24).

Nothing is collected: metrics for any number of models are one grouped
aggregate of conditional counts.  ROC and AUC need prefix sums over the
score order; a global window would put every row in one task, so:

1. rows collapse to one row per (group, distinct score) with positive and
   negative counts (partial aggregation);
2. scores are cut into ``n_buckets`` ranges of nearly equal numbers of distinct
   scores, however they are distributed (bounds from one sketch); bucket totals
   (a small table) are prefix-summed per group;
3. a window partitioned by (group, bucket) finishes the prefix sums inside
   each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import attach_per_group

N_BUCKETS = 1024


def _div0(num: Column, den: Column) -> Column:
    """Ratio with 0 when undefined (the ``zero_division=0`` rule)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def score_groups(df: DataFrame, y_true: str, y_score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): positives and negatives.  A NULL or
    NaN score has no place in the order, so it raises."""
    score = F.col(y_score).cast("double")
    checked = F.when(score.isNull() | F.isnan(score), F.raise_error(F.lit(f"{y_score} is NULL or NaN")).cast("double")) \
        .otherwise(score)
    return (df.groupBy(*group_cols, checked.alias("s"))
              .agg(F.sum((F.col(y_true) == 1).cast("long")).alias("pos"),
                   F.sum((F.col(y_true) == 0).cast("long")).alias("neg")))


def _bucket(n_buckets: int) -> Column:
    """Number of the ``bounds`` that lie above ``s`` (descending order), by
    binary search in the sorted array."""
    steps = max(1, n_buckets.bit_length())
    middle = "cast((r.lo + r.hi) / 2 as int)"
    below = F.expr(f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size(bounds)), (r, i) ->
        CASE WHEN r.lo >= r.hi THEN r
             WHEN get(bounds, {middle}) <= s THEN named_struct('lo', {middle} + 1, 'hi', r.hi)
             ELSE named_struct('lo', r.lo, 'hi', {middle}) END, r -> r.lo)""")
    return (F.size("bounds") - below).cast("long")


def cumulative_by_score(df: DataFrame, y_true: str, y_score: str, group_cols: Sequence[str] = (),
                        n_buckets: int = N_BUCKETS, with_next: bool = False) -> DataFrame:
    """Per (group, distinct score), in descending score order: pos, neg,
    cumulative tp / fp (inclusive) and group totals P / N.

    One plan for every size.  Bounds that cut the distinct scores into
    ``n_buckets`` nearly equal buckets come from one sketch (a single row,
    broadcast).  Bucket totals (at most n_buckets rows a group) are prefix-summed;
    each bucket then finishes alone."""
    g = list(group_cols)
    sg = score_groups(df, y_true, y_score, g)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = sg.agg(F.coalesce(F.percentile_approx("s", probs, 8 * n_buckets), F.array().cast("array<double>")).alias("bounds"))
    sg = sg.crossJoin(F.broadcast(bounds)).withColumn("b", _bucket(n_buckets)).drop("bounds")
    firsts = F.max_by(F.struct("pos", "neg"), F.col("s")).alias("__f")
    totals = sg.groupBy(*g, "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), firsts)
    w_grp = Window.partitionBy(*g) if g else Window.partitionBy()
    w_before = w_grp.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"__key_{c}") for c in [*g, "b"]],
        F.coalesce(F.sum("bp").over(w_before), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("bn").over(w_before), F.lit(0)).alias("fp0"),
        F.sum("bp").over(w_grp).alias("P"), F.sum("bn").over(w_grp).alias("N"),
        F.lead("__f").over(w_grp.orderBy("b")).alias("__nf"))
    same = [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in g] + [F.col("b") == F.col("__key_b")]
    w_order = Window.partitionBy(*g, "b").orderBy(F.col("s").desc())
    w_in = w_order.rowsBetween(Window.unboundedPreceding, 0)
    out = (sg.join(starts, same).drop(*[f"__key_{c}" for c in [*g, "b"]])
           .withColumn("tp", F.col("tp0") + F.sum("pos").over(w_in))
           .withColumn("fp", F.col("fp0") + F.sum("neg").over(w_in)))
    if with_next:
        # the next score group (in descending order): inside the bucket by
        # ``lead``; for a bucket's last row, the first row of the next bucket
        out = (out.withColumn("next_pos", F.coalesce(F.lead("pos").over(w_order), F.col("__nf.pos")))
               .withColumn("next_neg", F.coalesce(F.lead("neg").over(w_order), F.col("__nf.neg")))
               .withColumn("is_first", (F.col("tp") - F.col("pos") == 0) & (F.col("fp") - F.col("neg") == 0)))
    return out.drop("tp0", "fp0", "b", "__nf")


def roc_curve(df: DataFrame, y_true: str = "y_true", y_score: str = "p_churn",
              group_cols: Sequence[str] = (), n_buckets: int = N_BUCKETS,
              drop_intermediate: bool = False) -> DataFrame:
    """ML-14: (group…, fpr, tpr, threshold) for every distinct score, plus the
    (0, 0, +inf) start point.  ``drop_intermediate`` drops a point whose
    next score group adds the same (positives, negatives) as its own — a
    collinear point, the library default; first and last points stay."""
    g = list(group_cols)
    c = cumulative_by_score(df, y_true, y_score, g, n_buckets, with_next=drop_intermediate)
    if drop_intermediate:
        last = F.col("next_pos").isNull()
        same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        c = c.where(F.col("is_first") | last | ~same)
    pts = c.select(*g, _div0(F.col("fp"), F.col("N")).alias("fpr"),
                   _div0(F.col("tp"), F.col("P")).alias("tpr"), F.col("s").alias("threshold"))
    start_src = c.select(*g).distinct() if g else c.limit(1).select()
    start = start_src.select(*g, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                             F.lit(float("inf")).alias("threshold"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, y_true: str = "y_true", y_score: str = "p_churn",
            group_cols: Sequence[str] = (), n_buckets: int = N_BUCKETS) -> DataFrame:
    """ML-15: area under the ROC curve with ties counted half (trapezoid),
    one row per group; NULL when a group has one class only."""
    g = list(group_cols)
    c = cumulative_by_score(df, y_true, y_score, g, n_buckets)
    part = F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos").cast("double") / 2.0)
    aggs = [F.sum(part).alias("__a"), F.max("P").alias("__P"), F.max("N").alias("__N")]
    out = c.groupBy(*g).agg(*aggs) if g else c.agg(*aggs)
    return out.select(*g, F.try_divide(F.col("__a"), F.col("__P").cast("double") * F.col("__N"))
                      .alias("roc_auc"))


def classification_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                           y_score: str | None = "p_churn", group_cols: Sequence[str] = (),
                           model_name: str | None = None) -> DataFrame:
    """ML-12 / ML-16: accuracy, precision, recall, F1 (0 when undefined) and
    ROC AUC in one row per group (one conditional-count aggregate)."""
    g = list(group_cols)
    t, p = F.col(y_true), F.col(y_pred)
    counts = [F.count(F.lit(1)).alias("__n"),
              F.sum(((t == 1) & (p == 1)).cast("long")).alias("__tp"),
              F.sum(((t == 0) & (p == 0)).cast("long")).alias("__tn"),
              F.sum(((t == 0) & (p == 1)).cast("long")).alias("__fp"),
              F.sum(((t == 1) & (p == 0)).cast("long")).alias("__fn")]
    agg = df.groupBy(*g).agg(*counts) if g else df.agg(*counts)
    tp, tn, fp, fn = (F.col(c) for c in ("__tp", "__tn", "__fp", "__fn"))
    precision, recall = _div0(tp, tp + fp), _div0(tp, tp + fn)
    out = agg.select(*g, _div0(tp + tn, F.col("__n")).alias("accuracy"),
                     precision.alias("precision"), recall.alias("recall"),
                     _div0(2 * tp, 2 * tp + fp + fn).alias("f1"))
    if y_score is not None:
        auc = roc_auc(df, y_true, y_score, g)
        if g:
            auc = auc.withColumnsRenamed({c: f"__key_{c}" for c in g})
            out = out.join(auc, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in g], "left") \
                .drop(*[f"__key_{c}" for c in g])
        else:
            out = out.crossJoin(auc)
    if model_name is not None:
        out = out.select(F.lit(model_name).alias("model"), *out.columns)
    return out


def compare_models(df: DataFrame, model_col: str = "model", **kw) -> DataFrame:
    """ML-16: metrics per model, best AUC first."""
    return (classification_metrics(df, group_cols=[model_col], **kw)
            .orderBy(F.col("roc_auc").desc_nulls_last(), model_col))


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     normalize: bool = True, labels: Sequence[int] = (0, 1),
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """ML-13: one row per true label (every label present), columns
    ``pred_<label>`` with counts or percent of the row total (0 for a label
    that doesn't occur)."""
    g = list(group_cols)
    spark = df.sparkSession
    aggs = [F.sum((F.col(y_pred) == F.lit(lab)).cast("long")).alias(f"pred_{lab}") for lab in labels]
    counts = df.groupBy(*g, F.col(y_true).alias("label")).agg(*aggs)
    label_df = spark.createDataFrame([(int(lab),) for lab in labels], "label int")
    if g:
        label_df = counts.select(*g).distinct().crossJoin(F.broadcast(label_df))
    full = label_df.join(counts, [*g, "label"], "left")
    cols = [F.coalesce(F.col(f"pred_{lab}"), F.lit(0)).alias(f"pred_{lab}") for lab in labels]
    full = full.select(*g, F.col("label").cast("long").alias("label"), *cols)
    if normalize:
        total = sum((F.col(f"pred_{lab}") for lab in labels), F.lit(0))
        full = full.select(*g, "label", *[F.coalesce(F.try_divide(F.col(f"pred_{lab}") * 100.0, total), F.lit(0.0))
                                          .alias(f"pred_{lab}") for lab in labels])
    return full.orderBy(*g, "label")


def class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """ML-24: 'balanced' weights n / (k * n_class) attached per row.  The
    class table has one row per class (bounded by the label cardinality)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    w_all = Window.partitionBy()
    weights = counts.select(label, (F.sum("__nc").over(w_all).cast("double") /
                                    (F.count(F.lit(1)).over(w_all) * F.col("__nc"))).alias(weight_col))
    return attach_per_group(df, weights, [label], how="left")
