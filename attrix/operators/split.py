"""Exact, seeded, stratified splits, folds and samples (SPL-1 … SPL-6).

``sampleBy`` / ``randomSplit`` are Bernoulli samples: sizes are only
approximately right.  Here every row gets a hash order key
``md5(id || ':' || seed)`` (the same text in any SQL engine), and each
stratum keeps exactly its quota of smallest keys.

Quota rule: ``n_test = ceil(n * fraction)`` (or an absolute size), each
stratum gets ``floor(n_test * n_s / n)`` plus one for the strata with the
largest remainders (ties to the lower label) — integer arithmetic only.

A split or a sample moves no wide row.  The first hex digits of the key cut each
stratum into 65,536 buckets of near-equal size.  Counting rows per (stratum,
bucket) gives a small table whose prefix sums say in which bucket a stratum's
quota ends, its cut bucket.  Only the keys of that bucket (one row in 65,536) are
ranked, which gives the last key that is in; comparing a row's key with that
decides the row in the scan.

Folds need the rank of every row: a window partitioned by (stratum, bucket)
ranks rows inside their bucket, and the bucket's prefix sum is added; no
partition is larger than a bucket, however hot a stratum is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import attach_per_group

PREFIX_LEN = 4   # 65,536 buckets per stratum
NULL_STRATUM = "\u0000null"


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def _stratum(label: str | None) -> Column:
    if label is None:
        return F.lit("all")
    return F.coalesce(F.col(label).cast("string"), F.lit(NULL_STRATUM))


def _keyed(df: DataFrame, id_col: str, seed: int, label: str | None, prefix_len: int = PREFIX_LEN) -> DataFrame:
    return (df.withColumn("__stratum", _stratum(label)).withColumn("__h", hash_key(id_col, seed))
              .withColumn("__p", F.substring("__h", 1, prefix_len)))


def _starts(keyed: DataFrame) -> DataFrame:
    """(``__stratum``, ``__p``, ``__start``, ``__c``, ``__n_stratum``): rows of
    the stratum before each bucket; strata x 65,536 rows at most."""
    counts = keyed.groupBy("__stratum", "__p").agg(F.count(F.lit(1)).alias("__c"))
    w_before = Window.partitionBy("__stratum").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("__start", F.coalesce(F.sum("__c").over(w_before), F.lit(0)))
                  .withColumn("__n_stratum", F.sum("__c").over(Window.partitionBy("__stratum"))))


def ranked_within_strata(df: DataFrame, id_col: str, seed: int, label: str | None = None,
                         prefix_len: int = PREFIX_LEN) -> DataFrame:
    """Adds ``__stratum``, ``__n_stratum`` and ``__rank`` (1-based, by hash key
    then id, exact within the stratum)."""
    keyed = _keyed(df, id_col, seed, label, prefix_len)
    w_in = Window.partitionBy("__stratum", "__p").orderBy("__h", id_col)
    return (attach_per_group(keyed, _starts(keyed).drop("__c"), ["__stratum", "__p"])
            .withColumn("__rank", F.col("__start") + F.row_number().over(w_in))
            .drop("__start", "__h", "__p"))


def _flag_first(df: DataFrame, id_col: str, seed: int, label: str | None, quotas, flag_col: str) -> DataFrame:
    """``df`` with a 0/1 flag: 1 for the quota of smallest (key, id) of each
    stratum.  ``quotas``: (stratum sizes) -> (``__stratum``, ``__quota``)."""
    keyed = _keyed(df, id_col, seed, label)
    narrow = keyed.select("__stratum", "__p", "__h", F.col(id_col).alias("__id"))
    starts = _starts(narrow)
    quota = quotas(starts.groupBy("__stratum").agg(F.max("__n_stratum").alias("__ns")))
    cut = (starts.join(quota, "__stratum")
           .where((F.col("__quota") > F.col("__start")) & (F.col("__quota") <= F.col("__start") + F.col("__c")))
           .select("__stratum", "__p", (F.col("__quota") - F.col("__start")).alias("__more")))
    # keys of the cut buckets only; the last one that is in
    in_cut = Window.partitionBy("__stratum").orderBy("__h", "__id")
    last = (narrow.join(cut, ["__stratum", "__p"]).withColumn("__r", F.row_number().over(in_cut))
            .where(F.col("__r") == F.col("__more"))
            .select("__stratum", F.struct("__h", "__id").alias("__last")))
    inside = F.struct(F.col("__h"), F.col(id_col).alias("__id")) <= F.col("__last")
    return (attach_per_group(keyed, last, ["__stratum"], how="left")
            .withColumn(flag_col, F.coalesce(inside, F.lit(False)).cast("long"))
            .drop("__stratum", "__h", "__p", "__last"))


def stratum_quotas(sizes: DataFrame, fraction: float | None = None, size: int | None = None) -> DataFrame:
    """(``__stratum``, ``__quota``) from stratum sizes (``__stratum``, ``__ns``):
    largest-remainder allocation of the test size.  One row per stratum."""
    w_all = Window.partitionBy()
    n = F.sum("__ns").over(w_all)
    nt = (F.lit(int(size)).cast("long") if size is not None
          else F.ceil(n.cast("double") * F.lit(float(fraction))).cast("long"))
    q = (sizes.withColumn("__n", n).withColumn("__nt", F.least(nt, F.col("__n")))
              .withColumn("__fl", F.floor(F.col("__nt") * F.col("__ns") / F.col("__n")).cast("long"))
              .withColumn("__rem", (F.col("__nt") * F.col("__ns")) % F.col("__n"))
              .withColumn("__left", F.col("__nt") - F.sum("__fl").over(w_all))
              .withColumn("__r", F.row_number().over(
                  w_all.orderBy(F.col("__rem").desc(), F.col("__stratum").asc()))))
    return q.select("__stratum", (F.col("__fl") + (F.col("__r") <= F.col("__left")).cast("long"))
                    .alias("__quota"))


def stratified_split(df: DataFrame, label: str, id_col: str, fraction: float | None = 0.2,
                     size: int | None = None, seed: int = 42, flag_col: str = "is_test") -> DataFrame:
    """SPL-1/SPL-2: the table with a 0/1 ``flag_col`` — exactly the quota of
    each stratum is 1.  The input is scanned for counts and keys; the rows
    themselves are flagged where they are read."""
    return _flag_first(df, id_col, seed, label, lambda sizes: stratum_quotas(sizes, fraction, size), flag_col)


def split_frames(df: DataFrame, label: str, id_col: str, fraction: float | None = 0.2,
                 size: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    flagged = stratified_split(df, label, id_col, fraction, size, seed, "__is_test")
    return (flagged.where(F.col("__is_test") == 0).drop("__is_test"),
            flagged.where(F.col("__is_test") == 1).drop("__is_test"))


def reserve_pool(df: DataFrame, label: str, id_col: str, pool_size: int = 1000,
                 seed: int = 42) -> DataFrame:
    """SPL-2: exact-size stratified pool; error when the table is not larger
    than the pool (one count action, as in the original)."""
    n = df.count()
    if n <= pool_size:
        raise ValueError(f"the table has {n} rows and cannot hold out a pool of {pool_size}")
    return stratified_split(df, label, id_col, None, pool_size, seed, "in_pool")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """SPL-3: fold = (rank in stratum - 1) mod k — every fold gets each
    class in equal parts (sizes differ by at most one)."""
    ranked = ranked_within_strata(df, id_col, seed, label)
    return (ranked.withColumn(fold_col, ((F.col("__rank") - 1) % k).cast("int"))
                  .drop("__stratum", "__n_stratum", "__rank"))


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """SPL-4: exactly ``min(n, size)`` rows chosen by hash order; n <= 0 -> no
    rows.  Rows are filtered where they are read, for any n."""
    if n <= 0:
        return df.limit(0)
    def quota(sizes):
        return sizes.select("__stratum", F.least(F.col("__ns"), F.lit(n)).alias("__quota"))
    return _flag_first(df, id_col, seed, None, quota, "__in").where(F.col("__in") == 1).drop("__in")


def random_row(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """SPL-5: one row (the smallest hash key) — a top-1, one row per task."""
    return (df.withColumn("__h", hash_key(id_col, seed))
              .orderBy("__h", id_col).limit(1).drop("__h"))


def generate_batch(pool: DataFrame, n: int, batches_dir: str, id_col: str, seed: int = 42,
                   fmt: str = "parquet") -> str:
    """SPL-6: sample ``n`` rows of the labelled pool and store them as a new
    pending batch (a new directory the retraining stream will pick up)."""
    from ..sources.io import save_batch
    return save_batch(sample_rows(pool, n, id_col, seed), batches_dir, fmt=fmt)
