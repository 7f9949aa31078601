"""Projections and derived columns (PRJ-1 … PRJ-34).

Every function is ``DataFrame -> DataFrame`` (chain with ``df.transform``),
adds columns only when their inputs exist (the original skips silently),
and is a pure projection: Catalyst fuses the whole chain into one
whole-stage-codegen ``Project`` after the scan, with no shuffle.  The only
exceptions are the two data-dependent rules (tenure relative to the newest
customer, skip flag by quantile) which need one scalar aggregate, attached
as a one-row broadcast.

Where the analysed project defines a column more than once with different
rules, one function takes a ``variant`` argument: ``"canonical"`` (the
package rule that feeds training), ``"final"`` (final exploration
notebook), ``"early"`` (first exploration notebook) or ``"page"`` (app page).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..functions.binning import cut
from ..functions.columns import (classify_risk, clean_feature_name, clip, equals_flag, flag,
                                 format_fixed, format_percent, map_values, nan_to_null, ordinal, safe_div,
                                 target_label)


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


# -- PRJ-1..3: light features ------------------------------------------------

def add_engagement_index(df: DataFrame, hours: str = "weekly_hours",
                         skip: str = "song_skip_rate", out: str = "engagement_index") -> DataFrame:
    if not _has(df, hours, skip):
        return df
    return df.withColumn(out, F.col(hours) * (F.lit(1) - F.col(skip)))


def add_equality_flag(df: DataFrame, column: str, value, out: str) -> DataFrame:
    """1 when ``column == value``; a missing value gives 0."""
    if not _has(df, column):
        return df
    return df.withColumn(out, equals_flag(column, value))


def add_basic_features(df: DataFrame) -> DataFrame:
    """PRJ-1..3 together: engagement index, free-plan and high-inquiry flags."""
    return (df.transform(add_engagement_index)
              .transform(add_equality_flag, "subscription_type", "Free", "is_free_plan")
              .transform(add_equality_flag, "customer_service_inquiries", "High",
                         "is_high_inquiries"))


# -- PRJ-4/5: tenure ---------------------------------------------------------

def add_tenure(df: DataFrame, signup: str = "signup_date", variant: str = "canonical") -> DataFrame:
    """Tenure from the negative day offset.

    canonical/final: ``tenure_days = -signup``, months = days / 30.
    early: days relative to the newest customer (``max(signup) - signup``),
    months rounded half-even to one decimal; the maximum is one scalar
    aggregate broadcast as a single row.
    """
    if not _has(df, signup):
        return df
    if variant == "early":
        newest = df.agg(F.max(signup).alias("__max_signup"))
        return (df.crossJoin(F.broadcast(newest))
                  .withColumn("tenure_days", F.col("__max_signup") - F.col(signup))
                  .withColumn("tenure_months", F.bround(F.col("tenure_days") / 30.0, 1))
                  .drop("__max_signup"))
    return (df.withColumn("tenure_days", -F.col(signup))
              .withColumn("tenure_months", F.col("tenure_days") / 30.0))


def add_tenure_days(df: DataFrame, signup: str = "signup_date") -> DataFrame:
    """Days only (the exploration page variant)."""
    if not _has(df, signup):
        return df
    return df.withColumn("tenure_days", -F.col(signup))


# -- PRJ-6: songs per hour ----------------------------------------------------

def songs_per_hour_expr(songs: str, hours: str, variant: str = "canonical") -> Column:
    s, h = F.col(songs), F.col(hours)
    if variant == "canonical":      # zero hours -> NULL, infinities -> NULL
        return safe_div(s, F.when(h != 0, h))
    if variant == "final":          # only defined for positive hours
        return F.when(h > 0, s.cast("double") / h)
    if variant == "early":          # hours clipped to at least one
        return s.cast("double") / clip(h, lower=1.0)
    raise ValueError(f"unknown variant {variant!r}")


def add_songs_per_hour(df: DataFrame, variant: str = "canonical",
                       songs: str = "weekly_songs_played", hours: str = "weekly_hours",
                       out: str = "songs_per_hour") -> DataFrame:
    if not _has(df, songs, hours):
        return df
    return df.withColumn(out, songs_per_hour_expr(songs, hours, variant))


# -- PRJ-7/8: high skip flag ---------------------------------------------------

def add_high_skip(df: DataFrame, variant: str = "canonical", skip: str = "song_skip_rate",
                  out: str = "high_skip_user", threshold: float = dims.HIGH_SKIP_THRESHOLD,
                  quantile: float = 0.75) -> DataFrame:
    """canonical: ``skip >= 0.7``; early: ``skip >`` the data's 75th percentile.

    The percentile is exact (linear interpolation) and computed by the
    distributed quantile operator, then attached as a one-row broadcast.
    """
    if not _has(df, skip):
        return df
    if variant == "early":
        from .quantiles import exact_quantiles
        q = exact_quantiles(df, skip, [quantile]).select(F.col("q0").alias("__thr"))
        return (df.crossJoin(F.broadcast(q))
                  .withColumn(out, flag(nan_to_null(F.col(skip).cast("double")) > F.col("__thr")))
                  .drop("__thr"))
    return df.withColumn(out, flag(nan_to_null(F.col(skip).cast("double")) >= F.lit(float(threshold))))


# -- PRJ-9..13: early-notebook engineered features -----------------------------

def add_unique_ratio(df: DataFrame, unique: str = "weekly_unique_songs",
                     played: str = "weekly_songs_played", out: str = "unique_ratio") -> DataFrame:
    if not _has(df, unique, played):
        return df
    ratio = F.coalesce(safe_div(unique, played), F.lit(0.0))
    return df.withColumn(out, F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def add_social_intensity(df: DataFrame, friends: str = "num_platform_friends",
                         shared: str = "num_shared_playlists", out: str = "social_intensity") -> DataFrame:
    if not _has(df, friends, shared):
        return df
    return df.withColumn(out, F.col(friends) + F.col(shared))


def add_playlists_per_friend(df: DataFrame, created: str = "num_playlists_created",
                             friends: str = "num_platform_friends",
                             out: str = "playlists_per_friend") -> DataFrame:
    if not _has(df, created, friends):
        return df
    return df.withColumn(out, safe_div(created, F.col(friends) + F.lit(1)))


def add_has_paused(df: DataFrame, pauses: str = "num_subscription_pauses",
                   out: str = "has_paused") -> DataFrame:
    if not _has(df, pauses):
        return df
    return df.withColumn(out, flag(F.col(pauses) > 0))


def add_ordinal(df: DataFrame, column: str = "customer_service_inquiries",
                order: Sequence[str] = tuple(dims.INQUIRY_ORDINALS), out: str | None = None) -> DataFrame:
    if not _has(df, column):
        return df
    return df.withColumn(out or f"{column}_ord", ordinal(column, list(order)))


# -- PRJ-14..16, 23: geography --------------------------------------------------

def correct_values(df: DataFrame, column: str = "location",
                   corrections: Mapping[str, str] = dims.LOCATION_CORRECTIONS,
                   normalise: bool = False) -> DataFrame:
    """PRJ-14: replace known bad values; ``normalise`` first trims and
    title-cases (final notebook; a missing value becomes the text 'Nan'
    there, as the original casts to text before title-casing)."""
    if not _has(df, column):
        return df
    c = F.col(column)
    if normalise:
        c = F.initcap(F.trim(F.coalesce(c, F.lit("nan"))))
    fixed = c
    for bad, good in corrections.items():
        fixed = F.when(c == F.lit(bad), F.lit(good)).otherwise(fixed)
    return df.withColumn(column, fixed)


def add_state_code(df: DataFrame, table: int = 19, location: str = "location",
                   out: str = "state_code", trim: bool = True) -> DataFrame:
    """PRJ-15: state name -> code (19- or 50-entry table); unknown -> NULL.
    The lookup key is trimmed (canonical) but the stored name is not."""
    if not _has(df, location):
        return df
    mapping = dims.STATE_NAME_TO_CODE_19 if table == 19 else dims.STATE_NAME_TO_CODE_50
    key = F.trim(F.col(location)) if trim else F.col(location)
    return df.withColumn(out, map_values(key, mapping))


def add_region(df: DataFrame, variant: str = "code", location: str = "location",
               state_code: str = "state_code", out: str = "region") -> DataFrame:
    """PRJ-16: region from the state code (canonical), from the 50-state name
    table (final notebook / page) or from the four early sets with 'Other'."""
    if variant == "code":
        if not _has(df, state_code):
            return df
        return df.withColumn(out, map_values(state_code, dims.STATE_CODE_TO_REGION_19))
    if not _has(df, location):
        return df
    if variant == "name":
        return df.withColumn(out, map_values(location, dims.STATE_NAME_TO_REGION_50))
    if variant == "other":
        by_state = {s: r for r, states in dims.REGION_SETS_EARLY.items() for s in states}
        return df.withColumn(out, map_values(location, by_state, default=dims.REGION_OTHER))
    raise ValueError(f"unknown variant {variant!r}")


def add_region_coords(df: DataFrame, region: str = "region") -> DataFrame:
    """PRJ-23: region -> lat / lon (4-entry table, inline map literal)."""
    if not _has(df, region):
        return df
    lat = {r: float(v["lat"]) for r, v in dims.REGION_COORDS.items()}
    lon = {r: float(v["lon"]) for r, v in dims.REGION_COORDS.items()}
    return (df.withColumn("lat", map_values(region, lat))
              .withColumn("lon", map_values(region, lon)))


# -- PRJ-17..21: bins -------------------------------------------------------------

def add_binned(df: DataFrame, column: str, edges: Sequence[float],
               labels: Sequence[str] | None = None, out: str | None = None,
               right: bool = True, include_lowest: bool = True) -> DataFrame:
    """PRJ-17 ``create_binned_column``: default name ``<column>_bin``."""
    if not _has(df, column):
        return df
    return df.withColumn(out or f"{column}_bin",
                         cut(column, edges, labels, right=right, include_lowest=include_lowest))


def add_age_group(df: DataFrame, age: str = "age", out: str = "age_group") -> DataFrame:
    """PRJ-18: right-closed, lowest included; labels read as left-closed."""
    return add_binned(df, age, dims.AGE_EDGES, dims.AGE_LABELS, out, right=True,
                      include_lowest=True)


def add_weekly_hours_bin(df: DataFrame, variant: str = "canonical", hours: str = "weekly_hours",
                         out: str = "weekly_hours_bin") -> DataFrame:
    """PRJ-19: canonical left-closed (50 -> NULL); final right-closed;
    early five bins with an open top."""
    if variant == "canonical":
        return add_binned(df, hours, dims.HOURS_EDGES, dims.HOURS_LABELS, out, right=False)
    if variant == "final":
        return add_binned(df, hours, dims.HOURS_EDGES, dims.HOURS_LABELS, out, right=True)
    if variant == "early":
        return add_binned(df, hours, dims.HOURS_EDGES_OPEN, dims.HOURS_LABELS_OPEN, out, right=True)
    raise ValueError(f"unknown variant {variant!r}")


def add_skip_rate_bin(df: DataFrame, variant: str = "canonical", skip: str = "song_skip_rate",
                      out: str = "skip_rate_bin") -> DataFrame:
    """PRJ-20: canonical left-closed with a 1.0000001 top edge; final right-closed."""
    if variant == "canonical":
        return add_binned(df, skip, dims.SKIP_EDGES_LEFT, dims.SKIP_LABELS, out, right=False)
    if variant == "final":
        return add_binned(df, skip, dims.SKIP_EDGES_RIGHT, dims.SKIP_LABELS, out, right=True)
    raise ValueError(f"unknown variant {variant!r}")


def add_tenure_bucket(df: DataFrame, column: str = "tenure_months",
                      out: str = "tenure_bucket") -> DataFrame:
    """PRJ-21: 0/3/12/24/60 months; the input column is required."""
    if column not in df.columns:
        raise ValueError(f"{column} is not a column of the table")
    return add_binned(df, column, dims.TENURE_EDGES, dims.TENURE_LABELS, out, right=True)


# -- PRJ-22, 24, 25, 29, 30, 34: labels, risk, names, formats, constants --------

def add_target_label(df: DataFrame, target: str = "churned", out: str = "churn_label",
                     labels: Mapping[int, str] | None = None) -> DataFrame:
    if not _has(df, target):
        return df
    return df.withColumn(out, target_label(target, labels))


def add_risk_level(df: DataFrame, proba: str = "p_churn", out: str = "risk_level") -> DataFrame:
    """PRJ-24: risk class from the probability (NULL -> highest, N12)."""
    if not _has(df, proba):
        return df
    return df.withColumn(out, classify_risk(proba))


def prettify_columns(df: DataFrame, labels: Mapping[str, str] = dims.DISPLAY_LABELS) -> DataFrame:
    """PRJ-25: rename the columns that have a display label."""
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})


def select_existing(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """PRJ-26: keep the preferred columns that exist, in preferred order."""
    return df.select([c for c in preferred if c in df.columns])


def existing_columns(df: DataFrame, preferred: Sequence[str]) -> list[str]:
    return [c for c in preferred if c in df.columns]


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-27: drop helper columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def split_column_types(df: DataFrame, categorical: Sequence[str] | None = None):
    """PRJ-28: (numeric, categorical) column lists, by name list or by type."""
    if categorical is not None:
        cats = [c for c in categorical if c in df.columns]
        return [c for c in df.columns if c not in cats], cats
    nums, cats = [], []
    for f in df.schema.fields:
        (nums if isinstance(f.dataType, T.NumericType) else cats).append(f.name)
    return nums, cats


def add_clean_feature_name(df: DataFrame, column: str = "feature",
                           out: str = "feature_clean") -> DataFrame:
    """PRJ-29."""
    return df.withColumn(out, clean_feature_name(column))


def add_formatted(df: DataFrame, column: str, kind: str = "percent", digits: int = 2,
                  out: str | None = None) -> DataFrame:
    """PRJ-30: number as text, ``.2%`` or ``.2f``."""
    expr = format_percent(column, digits) if kind == "percent" else format_fixed(column, digits)
    return df.withColumn(out or f"{column}_text", expr)


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """PRJ-34: constant provenance columns (``source``, ``model_used``…)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


# -- PRJ-31/32: types ---------------------------------------------------------------

def cast_types(df: DataFrame, categorical: Sequence[str] = (), target: str | None = dims.TARGET,
               target_type: str = "int") -> DataFrame:
    """PRJ-31: category columns as text, target as integer."""
    out = df
    for c in categorical:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    if target and target in out.columns:
        out = out.withColumn(target, F.col(target).cast(target_type))
    return out


def align_to_schema(incoming: DataFrame, training_schema: T.StructType,
                    categorical: Sequence[str] = tuple(dims.CATEGORICAL_FEATURES),
                    target: str = dims.TARGET) -> DataFrame:
    """PRJ-32: same columns and order as training; missing -> NULL; extras
    dropped; categorical -> text; others -> number; target -> nullable long.
    Pure projection.

    A number stays the number it is: an integer column takes the training
    type, any other numeric column is a double, and so is text, where bad text
    and NaN are NULL (``'12.0'`` is 12, ``' 7'`` is 7, 7.5 stays 7.5 also where
    training had integers)."""
    present = set(incoming.columns)
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    cols = []
    for f in training_schema.fields:
        name = f.name
        if name in categorical:
            to_type = T.StringType()
        elif name == target:
            to_type = T.LongType()
        elif isinstance(f.dataType, T.NumericType):
            to_type = f.dataType
        else:
            to_type = T.DoubleType()
        if name in present:
            src = F.col(name)
            if name in categorical:
                expr = src.cast("string")
            elif name == target:
                expr = src.cast("string").try_cast("double").try_cast("long")
            else:
                given = incoming.schema[name].dataType
                if isinstance(given, integral):
                    expr = src.try_cast(to_type)
                elif isinstance(given, T.StringType):
                    expr = nan_to_null(F.trim(src).try_cast("double"))
                else:
                    expr = nan_to_null(src.try_cast("double"))
        else:
            expr = F.lit(None).cast(to_type)
        cols.append(expr.alias(name))
    return incoming.select(cols)


# -- PRJ-33: composed preparation ------------------------------------------------------

def clean_raw(df: DataFrame, variant: str = "canonical") -> DataFrame:
    """Cleaning step: tenure, songs per hour, fixed skip flag."""
    tenure_variant = "early" if variant == "early" else "canonical"
    out = df.transform(add_tenure, variant=tenure_variant)
    out = out.transform(add_songs_per_hour, variant="final" if variant == "final" else "canonical")
    return out.transform(add_high_skip, variant="canonical")


def add_model_ready_features(df: DataFrame) -> DataFrame:
    """Canonical model-ready columns: corrected location, age group, hour and
    skip bins, state code and region (19-state table)."""
    return (df.transform(correct_values, "location")
              .transform(add_age_group)
              .transform(add_weekly_hours_bin, "canonical")
              .transform(add_skip_rate_bin, "canonical")
              .transform(add_state_code, 19)
              .transform(add_region, "code"))


def build_model_ready(df: DataFrame) -> DataFrame:
    """PRJ-33 ``build_train_model_ready``: clean, then model-ready features."""
    return df.transform(clean_raw).transform(add_model_ready_features)


def add_features_final(df: DataFrame) -> DataFrame:
    """PRJ-33, final-notebook ``add_features``: tenure days, right-closed
    bins, normalised location, 50-state code and region by name."""
    return (df.transform(add_tenure_days)
              .transform(add_age_group)
              .transform(add_weekly_hours_bin, "final")
              .transform(add_skip_rate_bin, "final")
              .transform(correct_values, "location", normalise=True)
              .transform(add_state_code, 50, trim=False)
              .transform(add_region, "name"))


def add_engineered_features(df: DataFrame) -> DataFrame:
    """PRJ-33, early-notebook ``add_engineered_features``."""
    return (df.transform(add_songs_per_hour, "early")
              .transform(add_unique_ratio)
              .transform(add_social_intensity)
              .transform(add_playlists_per_friend)
              .transform(add_has_paused)
              .transform(add_high_skip, "early")
              .transform(add_ordinal)
              .transform(add_region, "other"))
