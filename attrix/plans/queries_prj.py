"""Registered projection queries (PRJ-*, SRC-*, JOB-1/2) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import features as fe
from ..sources.io import read_data, read_table, table_path
from .catalog import register, round_doubles
from .fixtures import scores, subscribers
from .sqltext import case_cut, case_map, flag, risk, with_ctes


def _subs(spark, sf):
    return subscribers(spark, sf)


def _sel(df, *cols):
    return df.select("customer_id", *cols)


def _sql(exprs: str, src: str = "subscribers", *ctes: str) -> str:
    return with_ctes(f"SELECT customer_id, {exprs} FROM {src}", *ctes)


_TITLE = ("array_to_string(list_transform(string_split(lower(trim(coalesce(location, 'nan'))), ' '), "
          "lambda w: upper(w[1]) || w[2:]), ' ')")


# -- sources ----------------------------------------------------------------------

@register("src_scan", "SELECT * FROM customer")
def src_scan(spark, sf):
    """SRC-1: read a table with a declared schema (Parquet test table)."""
    return read_data(spark, table_path(sf, "customer"), fmt="parquet")


@register("src_scan_features", with_ctes(f"""
SELECT *, weekly_hours * (1 - song_skip_rate) AS engagement_index,
  {flag("subscription_type = 'Free'")} AS is_free_plan,
  {flag("customer_service_inquiries = 'High'")} AS is_high_inquiries FROM subscribers"""))
def src_scan_features(spark, sf):
    """SRC-2: lazy read followed by the light feature step."""
    return _subs(spark, sf).transform(fe.add_basic_features)


# -- PRJ-1..3 ------------------------------------------------------------------------

@register("prj_engagement_index", _sql("weekly_hours * (1 - song_skip_rate) AS engagement_index"))
def prj_engagement(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_engagement_index), "engagement_index")


@register("prj_equality_flag", _sql(f"{flag(chr(39).join(['subscription_type = ', 'Free', '']))} AS is_free_plan, "
                                    f"{flag(chr(39).join(['customer_service_inquiries = ', 'High', '']))} AS is_high_inquiries"))
def prj_flags(spark, sf):
    df = (_subs(spark, sf).transform(fe.add_equality_flag, "subscription_type", "Free", "is_free_plan")
          .transform(fe.add_equality_flag, "customer_service_inquiries", "High", "is_high_inquiries"))
    return _sel(df, "is_free_plan", "is_high_inquiries")


# -- PRJ-4/5 ---------------------------------------------------------------------------

@register("prj_tenure_sign", _sql("-signup_date AS tenure_days, "
                                  "round(CAST(-signup_date AS DOUBLE) / 30.0::DOUBLE, 6) AS tenure_months"))
def prj_tenure_sign(spark, sf):
    return round_doubles(_sel(_subs(spark, sf).transform(fe.add_tenure), "tenure_days", "tenure_months"))


@register("prj_tenure_relative", _sql(
    "(SELECT max(signup_date) FROM subscribers) - signup_date AS tenure_days, "
    "round_even(CAST((SELECT max(signup_date) FROM subscribers) - signup_date AS DOUBLE) / 30.0::DOUBLE, 1) "
    "AS tenure_months"))
def prj_tenure_relative(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_tenure, variant="early"), "tenure_days", "tenure_months")


# -- PRJ-6 -------------------------------------------------------------------------------

@register("prj_songs_per_hour_null", _sql(
    "round(CASE WHEN weekly_hours = 0 THEN NULL ELSE weekly_songs_played / weekly_hours END, 6) "
    "AS songs_per_hour"))
def prj_sph_null(spark, sf):
    return round_doubles(_sel(_subs(spark, sf).transform(fe.add_songs_per_hour, "canonical"),
                              "songs_per_hour"))


@register("prj_songs_per_hour_positive", _sql(
    "round(CASE WHEN weekly_hours > 0 THEN weekly_songs_played / weekly_hours END, 6) AS songs_per_hour"))
def prj_sph_pos(spark, sf):
    return round_doubles(_sel(_subs(spark, sf).transform(fe.add_songs_per_hour, "final"),
                              "songs_per_hour"))


@register("prj_songs_per_hour_clip", _sql(
    "round(weekly_songs_played / CASE WHEN weekly_hours IS NOT NULL THEN greatest(weekly_hours, 1.0::DOUBLE) END, 6) "
    "AS songs_per_hour"))
def prj_sph_clip(spark, sf):
    return round_doubles(_sel(_subs(spark, sf).transform(fe.add_songs_per_hour, "early"),
                              "songs_per_hour"))


# -- PRJ-7/8 -------------------------------------------------------------------------------

@register("prj_high_skip_fixed", _sql(f"{flag('song_skip_rate >= 0.7::DOUBLE')} AS high_skip_user"))
def prj_high_skip_fixed(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_high_skip), "high_skip_user")


@register("prj_high_skip_quantile", _sql(
    f"{flag('song_skip_rate > (SELECT quantile_cont(song_skip_rate, 0.75) FROM subscribers)')} "
    "AS high_skip_user"))
def prj_high_skip_quantile(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_high_skip, "early"), "high_skip_user")


# -- PRJ-9..13 ------------------------------------------------------------------------------

@register("prj_unique_ratio", _sql(
    "round(least(greatest(coalesce(CASE WHEN weekly_songs_played = 0 THEN NULL ELSE "
    "weekly_unique_songs / weekly_songs_played END, 0.0), 0.0), 1.0), 6) AS unique_ratio"))
def prj_unique_ratio(spark, sf):
    return round_doubles(_sel(_subs(spark, sf).transform(fe.add_unique_ratio), "unique_ratio"))


@register("prj_social_intensity", _sql("num_platform_friends + num_shared_playlists AS social_intensity"))
def prj_social(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_social_intensity), "social_intensity")


@register("prj_playlists_per_friend", _sql(
    "round(num_playlists_created / (num_platform_friends + 1), 6) AS playlists_per_friend"))
def prj_ppf(spark, sf):
    return round_doubles(_sel(_subs(spark, sf).transform(fe.add_playlists_per_friend),
                              "playlists_per_friend"))


@register("prj_has_paused", _sql(f"{flag('num_subscription_pauses > 0')} AS has_paused"))
def prj_has_paused(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_has_paused), "has_paused")


@register("prj_ordinal", _sql(
    "CAST(CASE customer_service_inquiries WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END "
    "AS BIGINT) AS customer_service_inquiries_ord"))
def prj_ordinal(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_ordinal), "customer_service_inquiries_ord")


# -- PRJ-14..16, 23: geography ------------------------------------------------------------------

@register("prj_correct_location", _sql(
    "CASE WHEN location = 'Nebrasksa' THEN 'Nebraska' ELSE location END AS location"))
def prj_correct(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.correct_values, "location"), "location")


@register("prj_correct_location_title", _sql(
    f"CASE WHEN {_TITLE} = 'Nebrasksa' THEN 'Nebraska' ELSE {_TITLE} END AS location"))
def prj_correct_title(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.correct_values, "location", normalise=True), "location")


@register("prj_state_code_19", _sql(f"{case_map('trim(location)', dims.STATE_NAME_TO_CODE_19)} AS state_code"))
def prj_state19(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_state_code, 19), "state_code")


@register("prj_state_code_50", _sql(f"{case_map('location', dims.STATE_NAME_TO_CODE_50)} AS state_code"))
def prj_state50(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_state_code, 50, trim=False), "state_code")


@register("prj_region_code", _sql(
    f"{case_map(case_map('trim(location)', dims.STATE_NAME_TO_CODE_19), dims.STATE_CODE_TO_REGION_19)} AS region"))
def prj_region_code(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_state_code, 19).transform(fe.add_region, "code"), "region")


@register("prj_region_name", _sql(f"{case_map('location', dims.STATE_NAME_TO_REGION_50)} AS region"))
def prj_region_name(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_region, "name"), "region")


_EARLY = {s: r for r, states in dims.REGION_SETS_EARLY.items() for s in states}


@register("prj_region_other", _sql(f"{case_map('location', _EARLY, default='Other')} AS region"))
def prj_region_other(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_region, "other"), "region")


def _coord(key: str) -> str:
    whens = " ".join(f"WHEN region = '{r}' THEN {float(v[key])!r}::DOUBLE"
                     for r, v in dims.REGION_COORDS.items())
    return f"(CASE {whens} END)"


@register("prj_region_coords", with_ctes(f"""
SELECT customer_id, region, {_coord('lat')} AS lat, {_coord('lon')} AS lon FROM model_ready""", "model_ready"))
def prj_coords(spark, sf):
    df = _subs(spark, sf).transform(fe.build_model_ready).transform(fe.add_region_coords)
    return _sel(df, "region", "lat", "lon")


# -- PRJ-17..21: bins ------------------------------------------------------------------------------

@register("prj_binned_generic", _sql(
    f"{case_cut('average_session_length', [0, 10, 25, 50, 100], ['(0.0, 10.0]', '(10.0, 25.0]', '(25.0, 50.0]', '(50.0, 100.0]'], True, True)} "
    "AS average_session_length_bin"))
def prj_binned(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_binned, "average_session_length", [0, 10, 25, 50, 100]),
                "average_session_length_bin")


@register("prj_age_group", _sql(f"{case_cut('age', dims.AGE_EDGES, dims.AGE_LABELS, True, True)} AS age_group"))
def prj_age(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_age_group), "age_group")


@register("prj_hours_bin_left", _sql(
    f"{case_cut('weekly_hours', dims.HOURS_EDGES, dims.HOURS_LABELS, False)} AS weekly_hours_bin"))
def prj_hours_left(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_weekly_hours_bin, "canonical"), "weekly_hours_bin")


@register("prj_hours_bin_right", _sql(
    f"{case_cut('weekly_hours', dims.HOURS_EDGES, dims.HOURS_LABELS, True, True)} AS weekly_hours_bin"))
def prj_hours_right(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_weekly_hours_bin, "final"), "weekly_hours_bin")


@register("prj_hours_bin_open", _sql(
    f"{case_cut('weekly_hours', dims.HOURS_EDGES_OPEN, dims.HOURS_LABELS_OPEN, True, True)} AS weekly_hours_bin"))
def prj_hours_open(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_weekly_hours_bin, "early"), "weekly_hours_bin")


@register("prj_skip_bin_left", _sql(
    f"{case_cut('song_skip_rate', dims.SKIP_EDGES_LEFT, dims.SKIP_LABELS, False)} AS skip_rate_bin"))
def prj_skip_left(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_skip_rate_bin, "canonical"), "skip_rate_bin")


@register("prj_skip_bin_right", _sql(
    f"{case_cut('song_skip_rate', dims.SKIP_EDGES_RIGHT, dims.SKIP_LABELS, True, True)} AS skip_rate_bin"))
def prj_skip_right(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_skip_rate_bin, "final"), "skip_rate_bin")


@register("prj_tenure_bucket", _sql(
    f"{case_cut('CAST(-signup_date AS DOUBLE) / 30.0::DOUBLE', dims.TENURE_EDGES, dims.TENURE_LABELS, True, True)} "
    "AS tenure_bucket"))
def prj_tenure_bucket(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_tenure).transform(fe.add_tenure_bucket), "tenure_bucket")


# -- PRJ-22, 24..26, 29..31, 34 ---------------------------------------------------------------------

@register("prj_label", _sql("CASE WHEN churned = 1 THEN 'Churn' WHEN churned = 0 THEN 'No churn' END AS churn_label"))
def prj_label(spark, sf):
    return _sel(_subs(spark, sf).transform(fe.add_target_label), "churn_label")


@register("prj_risk_level", _sql(f"p_churn, {risk('p_churn')} AS risk_level", "scores", "scores"))
def prj_risk(spark, sf):
    return scores(spark, sf).transform(fe.add_risk_level).select("customer_id", "p_churn", "risk_level")


@register("prj_rename", with_ctes("SELECT customer_id, " + ", ".join(
    f'{c} AS "{lab}"' for c, lab in dims.DISPLAY_LABELS.items()
    if c in {"age", "subscription_type", "weekly_hours", "location", "state_code", "region", "churned"})
    + " FROM model_ready", "model_ready"))
def prj_rename(spark, sf):
    df = _subs(spark, sf).transform(fe.build_model_ready).select(
        "customer_id", "age", "subscription_type", "weekly_hours", "location", "state_code", "region",
        "churned")
    return fe.prettify_columns(df)


@register("prj_select_existing", with_ctes(
    "SELECT " + ", ".join(c for c in dims.NUMERIC_PLOT_CANDIDATES if c != "engagement_index")
    + " FROM subscribers"))
def prj_select_existing(spark, sf):
    return fe.select_existing(_subs(spark, sf), dims.NUMERIC_PLOT_CANDIDATES)


@register("prj_drop_helpers", with_ctes("SELECT * EXCLUDE (customer_id) FROM scores", "scores"))
def prj_drop(spark, sf):
    """PRJ-27: drop helper columns (the id) that exist."""
    return fe.drop_columns(scores(spark, sf), ["customer_id", "not_a_column"])


@register("prj_clean_names", _sql(
    "'cat__subscription_type_' || coalesce(subscription_type, 'nan') AS feature, "
    "replace(replace(replace('cat__subscription_type_' || coalesce(subscription_type, 'nan'), 'num__', ''), "
    "'cat__', ''), '_', ' ') AS feature_clean"))
def prj_clean_names(spark, sf):
    df = _subs(spark, sf).select(
        "customer_id",
        F.concat(F.lit("cat__subscription_type_"), F.coalesce("subscription_type", F.lit("nan"))).alias("feature"))
    return df.transform(fe.add_clean_feature_name)


@register("prj_format", _sql("printf('%.2f%%', p_churn * 100.0) AS p_churn_text, "
                             "printf('%.2f', p_churn) AS p_churn_fixed", "scores", "scores"))
def prj_format(spark, sf):
    df = (scores(spark, sf).transform(fe.add_formatted, "p_churn", "percent")
          .transform(fe.add_formatted, "p_churn", "fixed", out="p_churn_fixed"))
    return df.select("customer_id", "p_churn_text", "p_churn_fixed")


@register("prj_cast", _sql("CAST(subscription_type AS VARCHAR) AS subscription_type, "
                           "CAST(age AS VARCHAR) AS age, CAST(churned AS INTEGER) AS churned"))
def prj_cast(spark, sf):
    df = fe.cast_types(_subs(spark, sf), categorical=["subscription_type", "age"])
    return _sel(df, "subscription_type", "age", "churned")


@register("prj_constants", _sql("'incoming' AS source, 'RF Tuned' AS model_used"))
def prj_constants(spark, sf):
    return _sel(fe.add_constants(_subs(spark, sf), {"source": "incoming", "model_used": "RF Tuned"}),
                "source", "model_used")


# -- PRJ-32/33, JOB-1/2 ---------------------------------------------------------------------------------

MR_COLS = ["customer_id", "age", "location", "subscription_type", "payment_plan", "payment_method",
           "num_subscription_pauses", "signup_date", "weekly_hours", "average_session_length",
           "song_skip_rate", "weekly_songs_played", "weekly_unique_songs", "num_favorite_artists",
           "num_platform_friends", "num_playlists_created", "num_shared_playlists",
           "notifications_clicked", "customer_service_inquiries", "churned", "tenure_days",
           "tenure_months", "songs_per_hour", "high_skip_user", "age_group", "weekly_hours_bin",
           "skip_rate_bin", "state_code", "region"]

_MR_SQL = with_ctes("SELECT * REPLACE (round(tenure_months, 6) AS tenure_months, "
                    "round(songs_per_hour, 6) AS songs_per_hour) FROM model_ready", "model_ready")


@register("prj_model_ready", _MR_SQL)
def prj_model_ready(spark, sf):
    return round_doubles(_subs(spark, sf).transform(fe.build_model_ready))


@register("job_1_model_ready", _MR_SQL)
def job_1(spark, sf):
    from .jobs import model_ready_job
    return round_doubles(model_ready_job(_subs(spark, sf)))


def incoming(spark, sf):
    """Incoming customers — no target, one extra column, one missing
    column, an integer column as text (a bad value, ``12.0``, ``  7``, ``7.5``)
    and another as double with fractions."""
    k = F.col("customer_id")
    return (_subs(spark, sf).drop("churned", "num_favorite_artists")
            .withColumn("extra_col", F.lit(1))
            .withColumn("weekly_unique_songs",
                        F.when(k % 13 == 0, F.lit("x1")).otherwise(F.concat(
                            F.when(k % 13 == 2, F.lit("  ")).otherwise(F.lit("")),
                            F.col("weekly_unique_songs").cast("string"),
                            F.when(k % 13 == 1, F.lit(".0")).when(k % 13 == 3, F.lit(".5")).otherwise(F.lit("")))))
            .withColumn("num_shared_playlists", F.col("num_shared_playlists") + F.when(k % 7 == 0, F.lit(0.5)).otherwise(F.lit(0.0))))


_ALIGN_SQL = with_ctes(f"""
SELECT {", ".join(
    "CAST(NULL AS BIGINT) AS churned" if c == "churned" else
    "CAST(NULL AS BIGINT) AS num_favorite_artists" if c == "num_favorite_artists" else
    "CASE customer_id % 13 WHEN 0 THEN NULL WHEN 3 THEN weekly_unique_songs + 0.5::DOUBLE ELSE CAST(weekly_unique_songs AS DOUBLE) END AS weekly_unique_songs" if c == "weekly_unique_songs" else
    "CAST(num_shared_playlists AS DOUBLE) + CASE WHEN customer_id % 7 = 0 THEN 0.5 ELSE 0.0 END AS num_shared_playlists" if c == "num_shared_playlists" else
    f"round({c}, 6) AS {c}" if c in ("tenure_months", "songs_per_hour") else c
    for c in MR_COLS)}
FROM model_ready""", "model_ready")


@register("prj_align_schema", _ALIGN_SQL)
def prj_align(spark, sf):
    train = _subs(spark, sf).transform(fe.build_model_ready)
    inc = incoming(spark, sf).transform(fe.build_model_ready)
    return round_doubles(fe.align_to_schema(inc, train.schema))


@register("job_2_incoming_aligned", _ALIGN_SQL)
def job_2(spark, sf):
    from .jobs import incoming_prediction_ready_job
    return round_doubles(incoming_prediction_ready_job(incoming(spark, sf), _subs(spark, sf)))


@register("prj_features_final", with_ctes(f"""
SELECT customer_id, -signup_date AS tenure_days,
  {case_cut('age', dims.AGE_EDGES, dims.AGE_LABELS, True, True)} AS age_group,
  {case_cut('weekly_hours', dims.HOURS_EDGES, dims.HOURS_LABELS, True, True)} AS weekly_hours_bin,
  {case_cut('song_skip_rate', dims.SKIP_EDGES_RIGHT, dims.SKIP_LABELS, True, True)} AS skip_rate_bin,
  loc AS location, {case_map('loc', dims.STATE_NAME_TO_CODE_50)} AS state_code,
  {case_map('loc', dims.STATE_NAME_TO_REGION_50)} AS region
FROM (SELECT *, CASE WHEN {_TITLE} = 'Nebrasksa' THEN 'Nebraska' ELSE {_TITLE} END AS loc FROM subscribers)"""))
def prj_features_final(spark, sf):
    df = _subs(spark, sf).transform(fe.add_features_final)
    return df.select("customer_id", "tenure_days", "age_group", "weekly_hours_bin", "skip_rate_bin",
                     "location", "state_code", "region")


@register("prj_engineered_early", _sql(f"""
  round(weekly_songs_played / CASE WHEN weekly_hours IS NOT NULL THEN greatest(weekly_hours, 1.0::DOUBLE) END, 6)
    AS songs_per_hour,
  round(least(greatest(coalesce(CASE WHEN weekly_songs_played = 0 THEN NULL ELSE
    weekly_unique_songs / weekly_songs_played END, 0.0), 0.0), 1.0), 6) AS unique_ratio,
  num_platform_friends + num_shared_playlists AS social_intensity,
  round(num_playlists_created / (num_platform_friends + 1), 6) AS playlists_per_friend,
  {flag('num_subscription_pauses > 0')} AS has_paused,
  {flag('song_skip_rate > (SELECT quantile_cont(song_skip_rate, 0.75) FROM subscribers)')} AS high_skip_user,
  CAST(CASE customer_service_inquiries WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS BIGINT)
    AS customer_service_inquiries_ord,
  {case_map('location', _EARLY, default='Other')} AS region"""))
def prj_engineered(spark, sf):
    df = _subs(spark, sf).transform(fe.add_engineered_features)
    return round_doubles(df.select("customer_id", "songs_per_hour", "unique_ratio", "social_intensity",
                                   "playlists_per_friend", "has_paused", "high_skip_user",
                                   "customer_service_inquiries_ord", "region"))


@register("src_read_lineitem_projection", """
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'""")
def src_read_projection(spark, sf):
    """SRC-1 with a predicate and a projection that reach the Parquet scan."""
    return (read_table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
            .select("l_orderkey", "l_extendedprice"))
