"""Quartiles, fences and values beyond them for many columns in two scans (AGG-21, AGG-22).

A value is beyond the fences when it is below ``q1 - f (q3 - q1)`` or above
``q3 + f (q3 - q1)``.  The exact quartiles are known only after all rows are read, but a
sketch brackets them after one scan, and with them the fences.  So:

1. one aggregate has the count and a bounded sketch of every column;
2. in the second scan a row adds to counters (per column: values below a bracket and at
   its ends, values surely beyond a fence, extremes surely inside), and only values between
   the ends of a bracket, or where a fence may lie, are kept.  Between the ends lie about a
   thousandth of a column's rows, however often a value is repeated: a frequent value is an
   end.  A fence whose quartiles are known from the sketch is exact and keeps nothing.
   A row's kept values form its *signature*, an array that is empty for nearly all rows;
   rows are grouped by signature, so all rows without a kept value become one row per task
   before the shuffle.

There is no row per column and value: the wide rows are never unpivoted.  What is kept is
ranked exactly (:mod:`.quantiles`), then the doubtful values are decided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles as qu
from ..session import ensure_checkpoint_dir
from .groups import MAX_BROADCAST_GROUPS

PROBS = [0.25, 0.5, 0.75]
#: Kinds of kept values: the brackets of the three quartiles, then both fences.
LOWER, UPPER = 3, 4


#: The expressions below are SQL text: a wide table has hundreds of them, and one call to the
#: JVM for each is quicker than one for each operator in it.
LEAST, MOST = "double('-inf')", "double('inf')"


def _limits(i: int, accuracy: int, factor: float) -> tuple[list[str], list[str]]:
    """Ends of the brackets of column ``i`` (from its sketch ``s``), and from them the ranges in
    which the fences lie.  A range has room for the rounding of an interpolation; NaN ends are open."""
    ends = [f"if(n{i} < {accuracy}, {MOST if k % 2 else LEAST}, s{i}[{k}]) AS b{i}_{k}" for k in range(6)]
    b = [f"b{i}_{k}" for k in range(6)]
    most, least, f = f"({b[5]} - {b[0]})", f"({b[4]} - {b[1]})", f"{float(factor)!r}D"
    known = f"{b[0]} = {b[1]} AND {b[4]} = {b[5]}"
    fences = []
    for j, low, high in ((LOWER, f"({b[0]} - {f} * {most})", f"({b[1]} - {f} * {least})"),
                         (UPPER, f"({b[4]} + {f} * {least})", f"({b[5]} + {f} * {most})")):
        fences += [f"if({known}, {low}, nanvl({low} - abs({low}) * 1e-9D, {LEAST})) AS b{i}_{2 * j}",
                   f"if({known}, {low}, nanvl({high} + abs({high}) * 1e-9D, {MOST})) AS b{i}_{2 * j + 1}"]
    return ends, fences


def _kept(i: int) -> list[str]:
    """A row's value of column ``i`` in each kind of range, or NULL."""
    out = []
    for j in range(5):
        low, high = f"b{i}_{2 * j}", f"b{i}_{2 * j + 1}"
        inside = f"v{i} > {low} AND v{i} < {high}" if j < LOWER else f"{low} < {high} AND v{i} BETWEEN {low} AND {high}"
        out.append(f"if({inside}, named_struct('i', {i}, 'j', {j}, 'k', v{i}), NULL)")
    return out


def _counters(i: int) -> list[str]:
    """What all rows add to: rows below a bracket and at its ends, rows surely beyond a fence, extremes surely inside."""
    out = []
    for j in range(3):
        low, high = f"b{i}_{2 * j}", f"b{i}_{2 * j + 1}"
        out += [f"sum(cast(({hit}) AS long)) AS {what}{i}_{j}" for what, hit in
                (("below", f"v{i} < {low}"), ("low", f"v{i} = {low}"), ("high", f"v{i} = {high} AND {low} < {high}"))]
    b = [f"b{i}_{k}" for k in range(10)]
    sure = f"(v{i} > {b[7]} OR ({b[6]} = {b[7]} AND v{i} = {b[6]})) AND (v{i} < {b[8]} OR ({b[8]} = {b[9]} AND v{i} = {b[8]}))"
    return [*out, f"sum(cast((v{i} < {b[6]} OR v{i} > {b[9]}) AS long)) AS beyond{i}",
            f"min(if({sure}, v{i}, NULL)) AS least{i}", f"max(if({sure}, v{i}, NULL)) AS most{i}"]


def _counted(i: int) -> str:
    """Column ``i``'s counters as one value: the ends of the brackets with their rows, and the rest."""
    ends = [f"named_struct('j', {j}, 'k', {k}, 'c', {what}{i}_{j})" for j in range(3) for what, k in
            (("below", LEAST), ("low", f"b{i}_{2 * j}"), ("high", f"b{i}_{2 * j + 1}"))]
    return (f"named_struct('i', {i}, 'ends', array({', '.join(ends)}), 'beyond', beyond{i}, "
            f"'least', least{i}, 'most', most{i})")


def fenced_quartiles(df: DataFrame, columns: Sequence[str], factor: float = 1.5, group_cols: Sequence[str] = (),
                     accuracy: int = qu.DEFAULT_ACCURACY) -> DataFrame:
    """One row per (group, column) that has a value: n, q1, median, q3, lower_bound,
    upper_bound, n_outliers, lower_whisker, upper_whisker (most extreme values inside the
    fences), min, max.  NULL and NaN are missing values; a column without any other has no row.
    Groups are compared null-safe."""
    g, spark = list(group_cols), df.sparkSession
    columns = [c for c in columns if c in df.columns]
    schema_g = [df.schema[c].simpleString().replace(":", " ", 1) for c in g]
    if not columns:
        return spark.createDataFrame([], ", ".join([*schema_g, "column string, n long", *[
            f"{c} double" for c in ("q1", "median", "q3", "lower_bound", "upper_bound")], "n_outliers long",
            "lower_whisker double", "upper_whisker double", "min double", "max double"]))
    ensure_checkpoint_dir(spark)
    ids = range(len(columns))
    keys = [F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(g)]
    gk = [f"__g{i}" for i in range(len(g))]
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    data = df.select(*keys, *[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in zip(ids, value, strict=True)])

    # first scan: counts and sketches
    margin = qu._MARGIN_FACTOR / accuracy
    at = [x for p in PROBS for x in (max(0.0, p - margin), min(1.0, p + margin))]
    stats = data.groupBy(*gk).agg(*[a for i in ids for a in (
        F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", at, accuracy).alias(f"s{i}"),
        F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}"))])
    limits = [_limits(i, accuracy, factor) for i in ids]
    carried = [*gk, *[f"{what}{i}" for i in ids for what in ("n", "min", "max")]]
    bounds = stats.selectExpr(*carried, *[e for ends, _ in limits for e in ends]).selectExpr(
        *carried, *[f"b{i}_{k}" for i in ids for k in range(6)], *[e for _, fences in limits for e in fences]).checkpoint()
    n_groups, *largest = bounds.agg(F.count(F.lit(1)), *[F.max(f"n{i}") for i in ids]).first()
    max_n = max([n or 0 for n in largest])
    largest_band = min(max_n, 2 * margin * max_n + 4) if max_n >= accuracy else max_n

    # second scan: counters, and the few values that are kept
    if not g:
        rows = data.crossJoin(F.broadcast(bounds))
    else:
        side = F.broadcast(bounds) if n_groups <= MAX_BROADCAST_GROUPS else bounds
        side = side.withColumnsRenamed({k: f"{k}r" for k in gk})
        same = [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in gk]
        rows = data.join(side, same).drop(*[f"{k}r" for k in gk])
    signature = F.expr(f"array_compact(array({', '.join(e for i in ids for e in _kept(i))}))").alias("signature")
    # read three times below: written to the checkpoint folder, which also keeps the plan short
    by_signature = (rows.select(*gk, signature, *[f"v{i}" for i in ids], *[f"b{i}_{k}" for i in ids for k in range(10)])
                               .groupBy(*gk, "signature").agg(F.count(F.lit(1)).alias("c"), *[F.expr(e) for i in ids for e in _counters(i)])).checkpoint()

    # from here on: small tables
    names = F.array(*[F.lit(c) for c in columns])
    values = (by_signature.select(*gk, "c", F.explode("signature").alias("e"))
              .groupBy(*gk, "e.i", "e.j", "e.k").agg(F.sum("c").alias("c")))
    totals = by_signature.groupBy(*gk).agg(
        *[F.expr(f"sum({what}{i}_{j}) AS {what}{i}_{j}") for i in ids for j in range(3) for what in ("below", "low", "high")],
        *[F.expr(f"{how}({what}{i}) AS {what}{i}") for i in ids for how, what in (("sum", "beyond"), ("min", "least"), ("max", "most"))])
    sizes = ", ".join(f"named_struct('i', {i}, 'n', n{i}, 'min', min{i}, 'max', max{i})" for i in ids)
    counted = bounds.selectExpr(*gk, f"explode(array({sizes})) AS e") \
        .select(*gk, "e.*").where(F.col("n") > 0)
    on = [*gk, "i"]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({k: f"{k}_r" for k in on})
        return left.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on]).drop(*[f"{k}_r" for k in on])

    with_ends = totals.join(bounds.withColumnsRenamed({k: f"{k}_b" for k in gk}),
                            [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in gk]) if g else totals.crossJoin(F.broadcast(bounds))

    whole = f"explode(array({', '.join(_counted(i) for i in ids)})) AS e"
    per_column = joined(with_ends.selectExpr(*gk, whole).select(*gk, "e.*"), counted)
    ends = per_column.select(*on, F.explode("ends").alias("e")).select(*on, "e.*").where(F.col("c") > 0)
    band = values.where(F.col("j") < LOWER).select(*on, "j", "k", "c").unionByName(ends)
    # one text per (group, column): the NULL group ranks as any other
    key = F.to_json(F.struct(*[F.col(k) for k in on]), {"ignoreNullFields": "false"})
    cut = qu._interpolated(joined(band, counted).withColumn("__key", key), ["__key"], PROBS, ["q1", "median", "q3"],
                           largest_band, qu.BAND_ROWS_PER_TASK, qu.SUB_BUCKETS)
    whole = per_column.withColumn("__key", key).join(cut.select("__key", "q1", "median", "q3"), "__key").drop("__key", "ends")
    spread = F.col("q3") - F.col("q1")
    whole = whole.withColumn("lower_bound", F.col("q1") - F.lit(factor) * spread) \
                 .withColumn("upper_bound", F.col("q3") + F.lit(factor) * spread)
    doubtful = values.where(F.col("j") >= LOWER).groupBy(*on, "k").agg(F.max("c").alias("c"))
    decided = joined(doubtful, whole.select(*on, "lower_bound", "upper_bound", F.col("least").alias("__l")))
    out_here = (F.col("k") < F.col("lower_bound")) | (F.col("k") > F.col("upper_bound"))
    in_here = (F.col("k") >= F.col("lower_bound")) & (F.col("k") <= F.col("upper_bound"))
    decided = decided.groupBy(*on).agg(F.sum(F.when(out_here, F.col("c")).otherwise(0)).alias("more"),
                                       F.min(F.when(in_here, F.col("k"))).alias("low_k"),
                                       F.max(F.when(in_here, F.col("k"))).alias("high_k"))
    right = decided.withColumnsRenamed({k: f"{k}_r" for k in on})
    whole = whole.join(right, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on], "left")
    return whole.select(*[F.col(k).alias(c) for k, c in zip(gk, g, strict=True)], F.element_at(names, F.col("i") + 1).alias("column"),
                        "n", "q1", "median", "q3", "lower_bound", "upper_bound",
                        (F.col("beyond") + F.coalesce("more", F.lit(0))).alias("n_outliers"),
                        F.least("least", "low_k").alias("lower_whisker"), F.greatest("most", "high_k").alias("upper_whisker"), "min", "max")
