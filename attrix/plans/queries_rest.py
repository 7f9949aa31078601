"""Registered filter, join, sort, set and split queries (FLT, JN, SRT, SET,
SPL, JOB-4) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import features as fe
from ..operators import filters as fl
from ..operators import joins as jn
from ..operators import metrics as me
from ..operators import profile as pr
from ..operators import reshape as rs
from ..operators import split as sp
from ..operators import topk as tk
from ..sources.io import read_data, read_data_with_features, read_optional, write_table
from .catalog import register, round_doubles
from .fixtures import scores, subscribers
from .sqltext import case_map, risk, with_ctes


def _subs(spark, sf):
    return subscribers(spark, sf)


_RISK = risk("p_churn")


# -- filters ----------------------------------------------------------------------------

@register("flt_1_view_churned", with_ctes("SELECT * FROM subscribers WHERE churned = 1"))
def flt_1(spark, sf):
    return fl.by_view(_subs(spark, sf), "churned")


@register("flt_2_membership", with_ctes(
    "SELECT * FROM subscribers WHERE subscription_type IN ('Free', 'Premium')"))
def flt_2(spark, sf):
    return fl.by_values(_subs(spark, sf), "subscription_type", ["Free", "Premium"])


@register("flt_2_empty_list_keeps_all", with_ctes("SELECT * FROM subscribers"))
def flt_2b(spark, sf):
    return fl.by_values(_subs(spark, sf), "subscription_type", [])


@register("flt_3_active_only", with_ctes("SELECT * FROM scores WHERE y_true = 0", "scores"))
def flt_3(spark, sf):
    return fl.active_only(scores(spark, sf))


@register("flt_4_risk_level", with_ctes(
    f"SELECT *, {_RISK} AS risk_level FROM scores WHERE {_RISK} = 'Medio'", "scores"))
def flt_4(spark, sf):
    return fl.by_risk_level(scores(spark, sf).transform(fe.add_risk_level), "Medio")


@register("flt_4_risk_all", with_ctes(f"SELECT *, {_RISK} AS risk_level FROM scores", "scores"))
def flt_4b(spark, sf):
    return fl.by_risk_level(scores(spark, sf).transform(fe.add_risk_level), dims.RISK_ALL)


@register("flt_5_drop_null_key", with_ctes(
    "SELECT * FROM model_ready WHERE state_code IS NOT NULL", "model_ready"))
def flt_5(spark, sf):
    return round_doubles(fl.drop_null_keys(_subs(spark, sf).transform(fe.build_model_ready),
                                           ["state_code"]))


@register("flt_6_by_source", with_ctes("""
SELECT customer_id, p_churn, CASE WHEN customer_id % 2 = 0 THEN 'manual' ELSE 'random' END AS source
FROM scores WHERE (CASE WHEN customer_id % 2 = 0 THEN 'manual' ELSE 'random' END) = 'manual'""", "scores"))
def flt_6(spark, sf):
    log = scores(spark, sf).select(
        "customer_id", "p_churn",
        F.when(F.col("customer_id") % 2 == 0, "manual").otherwise("random").alias("source"))
    return fl.by_values(log, "source", ["manual"])


@register("flt_7_one_segment", with_ctes("""
SELECT subscription_type, customer_service_inquiries, count(*) AS n_customers,
       round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate
FROM subscribers WHERE subscription_type = 'Free' GROUP BY 1, 2"""))
def flt_7(spark, sf):
    summary = (_subs(spark, sf).groupBy("subscription_type", "customer_service_inquiries")
               .agg(F.count(F.lit(1)).alias("n_customers"),
                    F.avg(F.col("churned").cast("double")).alias("churn_rate")))
    return round_doubles(fl.by_values(summary, "subscription_type", ["Free"]))


@register("flt_9_outside_range", """
SELECT * FROM lineitem WHERE l_extendedprice < 2000.0::DOUBLE OR l_extendedprice > 95000.0::DOUBLE""")
def flt_9(spark, sf):
    from ..sources.io import read_table
    return fl.outside_range(read_table(spark, sf, "lineitem"), "l_extendedprice", 2000.0, 95000.0)


# -- joins --------------------------------------------------------------------------------

@register("jn_null_safe", with_ctes("""
SELECT a.customer_service_inquiries, round(a.churn_rate, 6) AS churn_rate, b.n
FROM (SELECT customer_service_inquiries, avg(CAST(churned AS DOUBLE)) AS churn_rate FROM subscribers GROUP BY 1) a
LEFT JOIN (SELECT customer_service_inquiries AS k, count(*) AS n FROM subscribers GROUP BY 1) b
  ON a.customer_service_inquiries IS NOT DISTINCT FROM b.k"""))
def jn_1(spark, sf):
    df = _subs(spark, sf)
    means = df.groupBy("customer_service_inquiries").agg(
        F.avg(F.col("churned").cast("double")).alias("churn_rate"))
    counts = df.groupBy("customer_service_inquiries").agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(jn.null_safe_left_join(means, counts, "customer_service_inquiries"))


@register("jn_null_safe_folded", with_ctes("""
SELECT customer_service_inquiries, round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate, count(*) AS n
FROM subscribers GROUP BY 1"""))
def jn_1b(spark, sf):
    return round_doubles(pr.summary_with_counts(_subs(spark, sf), "customer_service_inquiries"))


@register("jn_lookup", with_ctes(
    f"SELECT customer_id, location, {case_map('location', dims.STATE_NAME_TO_CODE_50)} AS state_code "
    "FROM subscribers"))
def jn_2(spark, sf):
    dim = jn.dimension(spark, dims.STATE_NAME_TO_CODE_50, "location", "state_code")
    return jn.lookup_join(_subs(spark, sf).select("customer_id", "location"), dim, "location")


@register("jn_scalar", with_ctes("""
SELECT customer_id, round(weekly_hours - (SELECT avg(weekly_hours) FROM subscribers), 6) AS hours_vs_mean
FROM subscribers"""))
def jn_3(spark, sf):
    df = _subs(spark, sf)
    mean = df.agg(F.avg("weekly_hours").alias("__m"))
    return round_doubles(jn.attach_scalars(df, mean).select(
        "customer_id", (F.col("weekly_hours") - F.col("__m")).alias("hours_vs_mean")))


# -- sorts and top-k -------------------------------------------------------------------------

@register("srt_1_top_risk", with_ctes(
    "SELECT * FROM scores ORDER BY p_churn DESC, customer_id LIMIT 20", "scores"))
def srt_1(spark, sf):
    return tk.top_risk_customers(scores(spark, sf), 20)


@register("srt_1_top_risk_active", with_ctes(
    "SELECT * FROM scores WHERE y_true = 0 ORDER BY p_churn DESC, customer_id LIMIT 20", "scores"))
def srt_1b(spark, sf):
    return tk.top_risk_customers(scores(spark, sf), 20, active=True)


@register("srt_2_risk_table", with_ctes(
    f"SELECT *, {_RISK} AS risk_level FROM scores WHERE y_true = 0 AND {_RISK} = 'Alto'", "scores"))
def srt_2(spark, sf):
    return tk.filter_risk_table(scores(spark, sf), "Alto", active=True)


def _segment_coef(spark, sf):
    """(feature, coefficient): churn-rate lift of each location — a
    coefficient-shaped table derived from the data."""
    df = _subs(spark, sf)
    overall = df.agg(F.avg(F.col("churned").cast("double")).alias("__o"))
    per = df.where(F.col("location").isNotNull()).groupBy("location").agg(
        F.avg(F.col("churned").cast("double")).alias("__r"))
    return round_doubles(per.crossJoin(F.broadcast(overall)).select(
        F.concat(F.lit("cat__location_"), F.col("location")).alias("feature"),
        (F.col("__r") - F.col("__o")).alias("coefficient")))


_COEF_SQL = """
coef AS (SELECT 'cat__location_' || location AS feature,
  round(avg(CAST(churned AS DOUBLE)) - (SELECT avg(CAST(churned AS DOUBLE)) FROM subscribers), 6) AS coefficient
  FROM subscribers WHERE location IS NOT NULL GROUP BY location)"""


@register("srt_3_coefficient_extremes", with_ctes("""
SELECT * FROM (SELECT * FROM coef WHERE coefficient > 0 ORDER BY coefficient DESC, feature LIMIT 5)
UNION ALL
SELECT * FROM (SELECT * FROM coef WHERE coefficient < 0 ORDER BY coefficient ASC, feature LIMIT 5)""", _COEF_SQL))
def srt_3(spark, sf):
    return tk.extremes(_segment_coef(spark, sf), "coefficient", k=5)


@register("srt_4_top_importances", with_ctes("""
SELECT * FROM coef ORDER BY coefficient DESC, feature LIMIT 8""", _COEF_SQL))
def srt_4(spark, sf):
    return tk.top_n_ascending(_segment_coef(spark, sf), "coefficient", n=8)


@register("srt_5_sort_all", with_ctes("SELECT * FROM scores", "scores"))
def srt_5(spark, sf):
    return tk.sort_rows(scores(spark, sf), "p_churn", ascending=False, id_col="customer_id")


@register("srt_6_declared_order", with_ctes(
    f"SELECT {_RISK} AS risk_level, count(*) AS n FROM scores GROUP BY 1", "scores"))
def srt_6(spark, sf):
    counts = scores(spark, sf).transform(fe.add_risk_level).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"))
    return tk.sort_by_order(counts, "risk_level", dims.RISK_ORDER)


# -- set / reshape ------------------------------------------------------------------------------

@register("set_1_append_batch", with_ctes("""
SELECT * FROM subscribers WHERE customer_id % 10 <> 3
UNION ALL
SELECT * FROM subscribers WHERE customer_id % 10 = 3"""))
def set_1(spark, sf):
    df = _subs(spark, sf)
    base = df.where(F.col("customer_id") % 10 != 3)
    batch = df.where(F.col("customer_id") % 10 == 3).withColumn("extra", F.lit("x")).select(
        "extra", *reversed(df.columns))
    return rs.append_batch(base, batch)


@register("set_2_append_records", with_ctes("""
SELECT customer_id, p_churn, NULL::VARCHAR AS source FROM scores WHERE y_true = 1
UNION ALL
SELECT customer_id, p_churn, 'simulated' AS source FROM scores WHERE y_true = 0""", "scores"))
def set_2(spark, sf):
    s = scores(spark, sf)
    log = s.where(F.col("y_true") == 1).select("customer_id", "p_churn")
    rec = s.where(F.col("y_true") == 0).select("customer_id", "p_churn", F.lit("simulated").alias("source"))
    return rs.append_records(log, rec)


_METRICS_SQL = """
m AS (SELECT model,
  round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(coalesce(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) * 1.0 /
    nullif(sum(y_pred), 0), 0.0), 6) AS precision,
  round(coalesce(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) * 1.0 /
    nullif(sum(y_true), 0), 0.0), 6) AS recall
  FROM scores GROUP BY model)"""


def _metrics_wide(spark, sf):
    return round_doubles(me.classification_metrics(scores(spark, sf), y_score=None,
                                                   group_cols=["model"]).drop("f1"))


@register("set_3_stack_models", with_ctes("SELECT * FROM m", "scores", _METRICS_SQL))
def set_3(spark, sf):
    s = scores(spark, sf)
    frames = [round_doubles(me.classification_metrics(s.where(F.col("model") == m), y_score=None,
                                                      model_name=m).drop("f1"))
              for m in ("m0", "m1", "m2")]
    return rs.stack(frames)


@register("set_4_unpivot_metrics", with_ctes("""
SELECT model, 'accuracy' AS metric, accuracy AS score FROM m
UNION ALL SELECT model, 'precision', precision FROM m
UNION ALL SELECT model, 'recall', recall FROM m""", "scores", _METRICS_SQL))
def set_4(spark, sf):
    return rs.to_long(_metrics_wide(spark, sf), ["model"], ["accuracy", "precision", "recall"])


@register("set_5_distinct_values", with_ctes(
    "SELECT DISTINCT location FROM subscribers WHERE location IS NOT NULL"))
def set_5(spark, sf):
    return rs.distinct_values(_subs(spark, sf), "location")


# -- splits and samples ----------------------------------------------------------------------------

def _quota_sql(src: str, label: str, size_expr: str) -> str:
    return f"""
k AS (SELECT *, md5(CAST(customer_id AS VARCHAR) || ':42') AS h FROM {src}),
n AS (SELECT coalesce(CAST({label} AS VARCHAR), chr(0) || 'null') AS st, count(*) AS ns FROM k GROUP BY 1),
t AS (SELECT sum(ns) AS n, least({size_expr}, sum(ns)) AS nt FROM n),
f AS (SELECT st, ns, (nt * ns) // n AS fl, (nt * ns) % n AS rem, nt FROM n, t),
q AS (SELECT st, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, st ASC) <=
        (max(nt) OVER () - sum(fl) OVER ()) THEN 1 ELSE 0 END AS quota FROM f),
r AS (SELECT k.*, row_number() OVER (PARTITION BY coalesce(CAST({label} AS VARCHAR), chr(0) || 'null')
        ORDER BY h, customer_id) AS rn, coalesce(CAST({label} AS VARCHAR), chr(0) || 'null') AS st FROM k)"""


@register("spl_1_stratified_split", with_ctes(
    "SELECT r.* EXCLUDE (h, rn, st), CAST(CASE WHEN rn <= quota THEN 1 ELSE 0 END AS BIGINT) AS is_test "
    "FROM r JOIN q USING (st)", _quota_sql("subscribers", "churned", "CAST(ceil(sum(ns) * 0.2) AS BIGINT)")))
def spl_1(spark, sf):
    return sp.stratified_split(_subs(spark, sf), "churned", "customer_id", 0.2, seed=42)


@register("spl_1_split_by_plan", with_ctes(
    "SELECT customer_id, subscription_type, CAST(CASE WHEN rn <= quota THEN 1 ELSE 0 END AS BIGINT) AS is_test "
    "FROM r JOIN q USING (st)",
    _quota_sql("subscribers", "subscription_type", "CAST(ceil(sum(ns) * 0.1) AS BIGINT)")))
def spl_1b(spark, sf):
    return sp.stratified_split(_subs(spark, sf).select("customer_id", "subscription_type"),
                               "subscription_type", "customer_id", 0.1, seed=42)


@register("spl_2_retraining_pool", with_ctes(
    "SELECT r.* EXCLUDE (h, rn, st) FROM r JOIN q USING (st) WHERE rn <= quota",
    _quota_sql("subscribers", "churned", "1000")))
def spl_2(spark, sf):
    flagged = sp.reserve_pool(_subs(spark, sf), "churned", "customer_id", 1000, seed=42)
    return flagged.where(F.col("in_pool") == 1).drop("in_pool")


@register("job_4_base_and_pool", with_ctes(
    "SELECT r.* EXCLUDE (h, rn, st), CAST(CASE WHEN rn <= quota THEN 1 ELSE 0 END AS BIGINT) AS in_pool "
    "FROM r JOIN q USING (st)", _quota_sql("subscribers", "churned", "1000")))
def job_4(spark, sf):
    from .jobs import base_and_pool_job
    return base_and_pool_job(_subs(spark, sf))


@register("spl_3_stratified_folds", with_ctes("""
SELECT customer_id, churned, CAST((row_number() OVER (PARTITION BY churned ORDER BY
  md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id) - 1) % 5 AS INTEGER) AS fold FROM subscribers"""))
def spl_3(spark, sf):
    return sp.stratified_folds(_subs(spark, sf).select("customer_id", "churned"), "churned", "customer_id", 5)


@register("spl_4_sample_n", with_ctes("""
SELECT * FROM subscribers ORDER BY md5(CAST(customer_id AS VARCHAR) || ':7'), customer_id LIMIT 250"""))
def spl_4(spark, sf):
    return sp.sample_rows(_subs(spark, sf), 250, "customer_id", seed=7)


@register("spl_4_sample_zero", with_ctes("SELECT * FROM subscribers LIMIT 0"))
def spl_4b(spark, sf):
    return sp.sample_rows(_subs(spark, sf), 0, "customer_id", seed=7)


@register("spl_6_generate_batch", with_ctes("""
SELECT * FROM subscribers ORDER BY md5(CAST(customer_id AS VARCHAR) || ':9'), customer_id LIMIT 40"""))
def spl_6(spark, sf):
    """SPL-6: a sample stored as a pending batch, read back whole."""
    path = sp.generate_batch(_subs(spark, sf), 40, _scratch(spark, "batches"), "customer_id", seed=9)
    return spark.read.parquet(path)


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    import uuid
    from ..session import shared_path
    return shared_path(spark, name, uuid.uuid4().hex)


_CSV_COLS = ["customer_id", "location", "subscription_type", "weekly_hours", "song_skip_rate", "signup_date", "churned"]


@register("src_csv_inferred", with_ctes(f"SELECT {', '.join(_CSV_COLS)} FROM subscribers"))
def src_csv(spark, sf):
    """SRC-1/3/6: header CSV in the shared folder, types inferred, text kept as it is."""
    path = write_table(_subs(spark, sf).select(*_CSV_COLS), _scratch(spark, "csv"), fmt="csv")
    return read_data(spark, path).select(*_CSV_COLS)


@register("src_csv_features", with_ctes(
    "SELECT customer_id, round(weekly_hours * (1 - song_skip_rate), 6) AS engagement_index FROM subscribers"))
def src_csv_features(spark, sf):
    """SRC-2: partitioned read followed by the light feature step."""
    path = write_table(_subs(spark, sf), _scratch(spark, "csv"), fmt="csv")
    return round_doubles(read_data_with_features(spark, path).select("customer_id", "engagement_index"))


@register("src_optional", with_ctes("SELECT customer_id FROM subscribers"))
def src_optional(spark, sf):
    """SRC-5: an absent and an empty source add no rows."""
    raw = _subs(spark, sf).select("customer_id")
    empty = write_table(raw.limit(0), _scratch(spark, "empty"))
    absent = _scratch(spark, "absent")
    return raw.unionByName(read_optional(spark, empty, raw.schema)).unionByName(read_optional(spark, absent, raw.schema))


@register("spl_5_random_row", with_ctes("""
SELECT * FROM subscribers ORDER BY md5(CAST(customer_id AS VARCHAR) || ':3'), customer_id LIMIT 1"""))
def spl_5(spark, sf):
    return sp.random_row(_subs(spark, sf), "customer_id", seed=3)


@register("srt_7_preview", with_ctes(
    "SELECT * FROM scores WHERE y_true = 0 ORDER BY p_churn DESC, customer_id LIMIT 20", "scores"))
def srt_7(spark, sf):
    """SRT-7: first 20 rows of the ordered active risk table."""
    return tk.preview(tk.filter_risk_table(scores(spark, sf), dims.RISK_ALL, active=True).drop("risk_level"), 20)
