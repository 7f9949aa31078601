"""Registered aggregation queries (AGG-*, JOB-3) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import features as fe
from ..operators import profile as pr
from ..operators.density import kde_by_group
from .catalog import register, round_doubles
from .fixtures import scores, subscribers
from .sqltext import case_cut, with_ctes


def _mr(spark, sf):
    return subscribers(spark, sf).transform(fe.build_model_ready)


def _basic(spark, sf):
    return subscribers(spark, sf).transform(fe.add_basic_features)


# AGG-10 (flagship): plan x inquiries summary, null groups kept
AGG10_SQL = with_ctes("""
SELECT subscription_type, customer_service_inquiries,
       round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate,
       round(avg(weekly_hours), 6) AS avg_weekly_hours,
       round(avg(song_skip_rate), 6) AS avg_skip_rate,
       round(avg(CAST(num_subscription_pauses AS DOUBLE)), 6) AS avg_pauses,
       count(*) AS n_customers
FROM model_ready GROUP BY 1, 2""", "model_ready")


@register("agg_10_segment_two_keys", AGG10_SQL)
def agg_10(spark, sf):
    return round_doubles(pr.two_key_summary(_mr(spark, sf)))


@register("agg_10_segment_two_keys_dropna", with_ctes("""
SELECT subscription_type, customer_service_inquiries,
       round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate,
       round(avg(weekly_hours), 6) AS avg_weekly_hours,
       round(avg(song_skip_rate), 6) AS avg_skip_rate,
       round(avg(CAST(num_subscription_pauses AS DOUBLE)), 6) AS avg_pauses,
       count(*) AS n_customers
FROM model_ready WHERE subscription_type IS NOT NULL AND customer_service_inquiries IS NOT NULL
GROUP BY 1, 2""", "model_ready"))
def agg_10_dropna(spark, sf):
    return round_doubles(pr.two_key_summary(_mr(spark, sf), keep_null_group=False))


@register("job_3_segment_summary", AGG10_SQL)
def job_3(spark, sf):
    from .jobs import segment_summary_job
    return round_doubles(segment_summary_job(subscribers(spark, sf)))


@register("agg_1_churn_rate", with_ctes(
    "SELECT round(avg(CAST(churned AS DOUBLE)) * 100.0, 6) AS churn_rate_pct FROM subscribers"))
def agg_1(spark, sf):
    return round_doubles(pr.churn_rate(subscribers(spark, sf)))


@register("agg_2_global_split", with_ctes("""
SELECT 'No churn' AS status, round(100.0 - avg(CAST(churned AS DOUBLE)) * 100.0, 6) AS percentage
FROM subscribers
UNION ALL
SELECT 'Churn', round(avg(CAST(churned AS DOUBLE)) * 100.0, 6) FROM subscribers"""))
def agg_2(spark, sf):
    return round_doubles(pr.global_churn_split(subscribers(spark, sf)))


@register("agg_3_rate_by_segment", with_ctes("""
SELECT region, round_even(avg(CAST(churned AS DOUBLE)), 3) AS churn_rate
FROM model_ready GROUP BY region""", "model_ready"))
def agg_3(spark, sf):
    return pr.churn_rate_by_segment(_mr(spark, sf), "region")


@register("agg_4_pct_by_category", with_ctes("""
SELECT subscription_type, round(avg(CAST(churned AS DOUBLE)) * 100.0, 6) AS churn_pct
FROM subscribers WHERE subscription_type IS NOT NULL GROUP BY 1"""))
def agg_4(spark, sf):
    return round_doubles(pr.churn_pct_by_category(subscribers(spark, sf), "subscription_type"))


@register("agg_4_pct_by_pauses_unsorted", with_ctes("""
SELECT num_subscription_pauses, round(avg(CAST(churned AS DOUBLE)) * 100.0, 6) AS churn_pct
FROM subscribers GROUP BY 1"""))
def agg_4b(spark, sf):
    return round_doubles(pr.churn_pct_by_category(subscribers(spark, sf), "num_subscription_pauses",
                                                  sort_desc=False))


@register("agg_5_table_by_category", with_ctes("""
SELECT customer_service_inquiries, count(churned) AS n_obs,
       round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate
FROM subscribers WHERE customer_service_inquiries IS NOT NULL GROUP BY 1"""))
def agg_5(spark, sf):
    return round_doubles(pr.churn_table_by_category(subscribers(spark, sf),
                                                    "customer_service_inquiries"))


_WH = case_cut("weekly_hours", dims.HOURS_EDGES, dims.HOURS_LABELS, True, True)


@register("agg_6_numeric_bins_dense", with_ctes(f"""
SELECT l.bin AS weekly_hours_bin, round(a.churn_pct, 6) AS churn_pct
FROM (SELECT * FROM (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(dims.HOURS_LABELS))})
      t(bin, o)) l
LEFT JOIN (SELECT {_WH} AS b, avg(CAST(churned AS DOUBLE)) * 100.0 AS churn_pct
           FROM subscribers GROUP BY 1) a ON a.b = l.bin"""))
def agg_6(spark, sf):
    return round_doubles(pr.churn_by_numeric_bins(subscribers(spark, sf), "weekly_hours",
                                                  dims.HOURS_EDGES, dims.HOURS_LABELS))


def _dense_sql(bin_expr: str, labels, name: str, src: str = "subscribers") -> str:
    values = ", ".join(f"('{b}', {i})" for i, b in enumerate(labels))
    return f"""
SELECT l.bin AS {name}, CAST(coalesce(a.n_obs, 0) AS BIGINT) AS n_obs, round(a.churn_rate, 6) AS churn_rate
FROM (SELECT * FROM (VALUES {values}) t(bin, o)) l
LEFT JOIN (SELECT {bin_expr} AS b, count(churned) AS n_obs, avg(CAST(churned AS DOUBLE)) AS churn_rate
           FROM {src} GROUP BY 1) a ON a.b = l.bin"""


@register("agg_6_age_group_dense", with_ctes(_dense_sql("age_group", dims.AGE_LABELS, "age_group",
                                                         "model_ready"), "model_ready"))
def agg_6b(spark, sf):
    return round_doubles(pr.churn_by_bin_column(_mr(spark, sf), "age_group", dims.AGE_LABELS))


_TB = case_cut("CAST(-signup_date AS DOUBLE) / 30.0::DOUBLE", dims.TENURE_EDGES, dims.TENURE_LABELS,
               True, True)


@register("agg_7_tenure_bucket", with_ctes(_dense_sql(_TB, dims.TENURE_LABELS, "tenure_bucket")))
def agg_7(spark, sf):
    df = subscribers(spark, sf).transform(fe.add_tenure).transform(fe.add_tenure_bucket)
    return round_doubles(pr.churn_by_bin_column(df, "tenure_bucket", dims.TENURE_LABELS))


_WHO = case_cut("weekly_hours", dims.HOURS_EDGES_OPEN, dims.HOURS_LABELS_OPEN, True, True)


@register("agg_8_hours_bin_open", with_ctes(_dense_sql(_WHO, dims.HOURS_LABELS_OPEN,
                                                        "weekly_hours_bin")))
def agg_8(spark, sf):
    df = subscribers(spark, sf).transform(fe.add_weekly_hours_bin, "early")
    return round_doubles(pr.churn_by_bin_column(df, "weekly_hours_bin", dims.HOURS_LABELS_OPEN))


@register("agg_9_segment_summary", with_ctes("""
SELECT subscription_type AS segmento, count(*) AS n_clientes,
       round_even(avg(CAST(churned AS DOUBLE)), 3) AS churn_rate,
       round_even(avg(weekly_hours), 3) AS weekly_hours_media,
       round_even(avg(song_skip_rate), 3) AS skip_rate_media,
       round_even(avg(CAST(num_subscription_pauses AS DOUBLE)), 3) AS pauses_media,
       round_even(avg(weekly_hours * (1 - song_skip_rate)), 3) AS engagement_media
FROM subscribers GROUP BY 1"""))
def agg_9(spark, sf):
    return pr.segment_summary(_basic(spark, sf), "subscription_type")


@register("agg_11_customers_by_state", with_ctes("""
SELECT location, state_code, count(*) AS value FROM model_ready
WHERE state_code IS NOT NULL AND location IS NOT NULL GROUP BY 1, 2""", "model_ready"))
def agg_11(spark, sf):
    return pr.customers_by_state(_mr(spark, sf))


@register("agg_12_churn_by_state", with_ctes("""
SELECT location, state_code, round(avg(CAST(churned AS DOUBLE)), 6) AS value FROM model_ready
WHERE state_code IS NOT NULL AND location IS NOT NULL GROUP BY 1, 2""", "model_ready"))
def agg_12(spark, sf):
    return round_doubles(pr.customers_by_state(_mr(spark, sf), value="rate"))


def _coords_sql(expr: str, key: str) -> str:
    whens = " ".join(f"WHEN {expr} = '{r}' THEN {float(v[key])!r}::DOUBLE"
                     for r, v in dims.REGION_COORDS.items())
    return f"(CASE {whens} ELSE NULL END)"


@register("agg_13_region_map", with_ctes(f"""
SELECT region, count(*) AS value, {_coords_sql('region', 'lat')} AS lat,
       {_coords_sql('region', 'lon')} AS lon
FROM model_ready WHERE region IS NOT NULL GROUP BY region""", "model_ready"))
def agg_13(spark, sf):
    return pr.region_map_table(_mr(spark, sf))


@register("agg_14_churn_by_location", with_ctes("""
SELECT location, count(churned) AS n_users, round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate
FROM subscribers WHERE location IS NOT NULL GROUP BY 1"""))
def agg_14(spark, sf):
    return round_doubles(pr.churn_table_by_category(subscribers(spark, sf), "location",
                                                    count_name="n_users"))


@register("agg_15_users_by_region", with_ctes("""
SELECT region, count(churned) AS n_users, round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate
FROM model_ready WHERE region IS NOT NULL GROUP BY 1""", "model_ready"))
def agg_15(spark, sf):
    return round_doubles(pr.churn_table_by_category(_mr(spark, sf), "region", count_name="n_users",
                                                    sort_by="n_users"))


@register("agg_16_crosstab", with_ctes("""
SELECT subscription_type,
  round(avg(CASE WHEN customer_service_inquiries = 'Low' THEN CAST(churned AS DOUBLE) * 100.0 END), 6) AS "Low",
  round(avg(CASE WHEN customer_service_inquiries = 'Medium' THEN CAST(churned AS DOUBLE) * 100.0 END), 6) AS "Medium",
  round(avg(CASE WHEN customer_service_inquiries = 'High' THEN CAST(churned AS DOUBLE) * 100.0 END), 6) AS "High"
FROM subscribers WHERE subscription_type IS NOT NULL AND customer_service_inquiries IS NOT NULL
GROUP BY 1"""))
def agg_16(spark, sf):
    return round_doubles(pr.churn_crosstab(subscribers(spark, sf), "subscription_type",
                                           "customer_service_inquiries", ["Low", "Medium", "High"]))


@register("agg_16_crosstab_lineitem", """
SELECT l_returnflag,
  round(avg(CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_discount >= 0.05::DOUBLE THEN 1 ELSE 0 END * 100.0 END), 6) AS "F",
  round(avg(CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_discount >= 0.05::DOUBLE THEN 1 ELSE 0 END * 100.0 END), 6) AS "O"
FROM lineitem GROUP BY 1""")
def agg_16b(spark, sf):
    from ..sources.io import read_table
    li = read_table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.05).cast("long").alias("hit"))
    return round_doubles(pr.churn_crosstab(li, "l_returnflag", "l_linestatus", ["F", "O"], target="hit"))


_LABEL = "CASE WHEN churned = 1 THEN 'Churn' WHEN churned = 0 THEN 'No churn' END"


@register("agg_17_describe_by_group", with_ctes(f"""
SELECT {_LABEL} AS churn_label, count(weekly_hours) AS count,
  round_even(avg(weekly_hours), 3) AS mean, round_even(quantile_cont(weekly_hours, 0.5), 3) AS median,
  round_even(stddev_samp(weekly_hours), 3) AS std, round_even(min(weekly_hours), 3) AS min,
  round_even(max(weekly_hours), 3) AS max
FROM subscribers GROUP BY 1"""))
def agg_17(spark, sf):
    df = subscribers(spark, sf).transform(fe.add_target_label)
    return pr.describe_by_group(df, "weekly_hours", "churn_label")


@register("agg_17_describe_lineitem", """
SELECT l_returnflag, count(l_extendedprice) AS count,
  round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
  round(max(l_extendedprice), 6) AS max
FROM lineitem GROUP BY 1""")
def agg_17b(spark, sf):
    from ..sources.io import read_table
    li = read_table(spark, sf, "lineitem")
    return round_doubles(pr.describe_by_group(li, "l_extendedprice", "l_returnflag", digits=None))


@register("agg_18_rate_by_flag", with_ctes("""
SELECT CAST(CASE WHEN song_skip_rate >= 0.7::DOUBLE THEN 1 ELSE 0 END AS BIGINT) AS high_skip_user,
       round(avg(CAST(churned AS DOUBLE)) * 100.0, 6) AS churn_pct
FROM subscribers GROUP BY 1"""))
def agg_18(spark, sf):
    df = subscribers(spark, sf).transform(fe.add_high_skip)
    return round_doubles(pr.churn_pct_by_category(df, "high_skip_user"))


def _missing_sql(cols):
    parts = [f"SELECT '{c}' AS column, CAST(sum(CASE WHEN {c} IS NULL "
             f"{'OR isnan(' + c + ')' if dbl else ''} THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
             f"round_even(sum(CASE WHEN {c} IS NULL {'OR isnan(' + c + ')' if dbl else ''} THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS pct_missing "
             f"FROM model_ready" for c, dbl in cols]
    return "\nUNION ALL\n".join(parts)


_MR_COLS = [("customer_id", False), ("age", False), ("location", False), ("subscription_type", False),
            ("payment_plan", False), ("payment_method", False), ("num_subscription_pauses", False),
            ("signup_date", False), ("weekly_hours", True), ("average_session_length", True),
            ("song_skip_rate", True), ("weekly_songs_played", False), ("weekly_unique_songs", False),
            ("num_favorite_artists", False), ("num_platform_friends", False),
            ("num_playlists_created", False), ("num_shared_playlists", False),
            ("notifications_clicked", False), ("customer_service_inquiries", False),
            ("churned", False), ("tenure_days", False), ("tenure_months", True),
            ("songs_per_hour", True), ("high_skip_user", False), ("age_group", False),
            ("weekly_hours_bin", False), ("skip_rate_bin", False), ("state_code", False),
            ("region", False)]


@register("agg_19_missing_values", with_ctes(_missing_sql(_MR_COLS), "model_ready"))
def agg_19(spark, sf):
    return pr.missing_values(_mr(spark, sf))


_OUT_COLS = ["weekly_hours", "average_session_length", "song_skip_rate", "weekly_songs_played",
             "weekly_unique_songs"]


def _outlier_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column, q1, q3, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound,
       q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound,
       (SELECT count(*) FROM subscribers s WHERE s.{c} IS NOT NULL AND
          (CAST(s.{c} AS DOUBLE) < q1 - 1.5::DOUBLE * (q3 - q1) OR CAST(s.{c} AS DOUBLE) > q3 + 1.5::DOUBLE * (q3 - q1))) AS n_outliers,
       round_even((SELECT count(*) FROM subscribers s WHERE s.{c} IS NOT NULL AND
          (CAST(s.{c} AS DOUBLE) < q1 - 1.5::DOUBLE * (q3 - q1) OR CAST(s.{c} AS DOUBLE) > q3 + 1.5::DOUBLE * (q3 - q1))) * 100.0
          / (SELECT count({c}) FROM subscribers), 2) AS pct_outliers
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
      FROM subscribers)""")
    body = "\nUNION ALL\n".join(parts)
    return ('SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, '
            "round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound, n_outliers, "
            f"pct_outliers FROM ({body})")


@register("agg_21_outliers_iqr", with_ctes(_outlier_sql(_OUT_COLS)))
def agg_21(spark, sf):
    return round_doubles(pr.outliers_iqr(subscribers(spark, sf), _OUT_COLS))


@register("agg_21_outliers_lineitem", _outlier_sql(["l_extendedprice", "l_quantity"])
          .replace("subscribers", "lineitem"))
def agg_21b(spark, sf):
    from ..sources.io import read_table
    return round_doubles(pr.outliers_iqr(read_table(spark, sf, "lineitem"),
                                         ["l_extendedprice", "l_quantity"]))


#: lineitem with NaN in every fifth price; the oracle's table has NULL there, which NaN must equal
_HOLED = "(SELECT * REPLACE (CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM lineitem)"


def _holed(spark, sf):
    from ..sources.io import read_table
    price = F.when(F.col("l_linenumber") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return read_table(spark, sf, "lineitem").withColumn("l_extendedprice", price)


@register("agg_21_outliers_nan", _outlier_sql(["l_extendedprice", "l_quantity"]).replace("subscribers", _HOLED))
def agg_21_nan(spark, sf):
    """AGG-21 over a column with NaN: missing, neither counted nor an outlier."""
    return round_doubles(pr.outliers_iqr(_holed(spark, sf), ["l_extendedprice", "l_quantity"]))


def _box_sql(value: str, group: str, src: str) -> str:
    return f"""
WITH q AS (SELECT {group} AS g, count(*) AS n, quantile_cont({value}, 0.25) AS q1,
                  quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
           FROM {src} WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY 1),
b AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM q)
SELECT b.g AS {group}, b.n, round(b.q1, 6) AS q1, round(b.median, 6) AS median, round(b.q3, 6) AS q3,
  round(min(CASE WHEN s.{value} BETWEEN b.lo AND b.hi THEN s.{value} END), 6) AS lower_whisker,
  round(max(CASE WHEN s.{value} BETWEEN b.lo AND b.hi THEN s.{value} END), 6) AS upper_whisker,
  CAST(sum(CASE WHEN s.{value} BETWEEN b.lo AND b.hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM {src} s JOIN b ON s.{group} = b.g WHERE s.{value} IS NOT NULL
GROUP BY b.g, b.n, b.q1, b.median, b.q3"""


@register("agg_22_boxplot_lineitem", _box_sql("l_extendedprice", "l_returnflag", "lineitem"))
def agg_22(spark, sf):
    from ..sources.io import read_table
    return round_doubles(pr.boxplot_stats(read_table(spark, sf, "lineitem"), "l_extendedprice",
                                          "l_returnflag"))


@register("agg_22_boxplot_nan", _box_sql("l_extendedprice", "l_returnflag", _HOLED))
def agg_22_nan(spark, sf):
    """AGG-22 over a column with NaN."""
    return round_doubles(pr.boxplot_stats(_holed(spark, sf), "l_extendedprice", "l_returnflag"))


@register("agg_22_boxplot_events", _box_sql("value", "event_type", "events"))
def agg_22b(spark, sf):
    from ..sources.io import read_table
    return round_doubles(pr.boxplot_stats(read_table(spark, sf, "events"), "value", "event_type"))


@register("agg_22_boxplot_long", with_ctes(f"""
SELECT song_skip_rate, churned, {_LABEL} AS grupo FROM subscribers"""))
def agg_22c(spark, sf):
    return pr.boxplot_long(subscribers(spark, sf), "song_skip_rate")


def _hist_sql(value: str, group: str, src: str, nbins: int, density: bool) -> str:
    dens = ", round(CAST(count(*) AS DOUBLE) / (max(n) * w), 6) AS density" if density else ""
    return f"""
WITH r AS (SELECT min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi FROM {src}
           WHERE {value} IS NOT NULL),
p AS (SELECT {group} AS g, CAST({value} AS DOUBLE) AS v, lo,
             (CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END) / {nbins}.0::DOUBLE AS w FROM {src}, r
      WHERE {value} IS NOT NULL),
t AS (SELECT g, count(*) AS n FROM p GROUP BY g),
c AS (SELECT p.g, least(CAST(floor((v - lo) / w) AS BIGINT) + 1, {nbins}) AS bin, lo, w, t.n
      FROM p JOIN t ON p.g IS NOT DISTINCT FROM t.g)
SELECT g AS {group}, bin, count(*) AS count, round(lo + (bin - 1) * w, 6) AS bin_start,
       round(lo + (bin - 1) * w + w, 6) AS bin_end {dens}
FROM c GROUP BY g, bin, lo, w"""


@register("agg_23_histogram_events", _hist_sql("value", "event_type", "events", 30, True))
def agg_23(spark, sf):
    from ..sources.io import read_table
    return round_doubles(pr.histogram_by_group(read_table(spark, sf, "events"), "value", "event_type",
                                               nbins=30, density=True))


@register("agg_23_histogram_lineitem", _hist_sql("l_extendedprice", "l_returnflag", "lineitem", 40,
                                                 False))
def agg_23b(spark, sf):
    from ..sources.io import read_table
    return round_doubles(pr.histogram_by_group(read_table(spark, sf, "lineitem"), "l_extendedprice",
                                               "l_returnflag", nbins=40))


_KDE_BASE = """
base AS (SELECT churned AS g, CAST(song_skip_rate AS DOUBLE) AS v FROM subscribers
         WHERE song_skip_rate IS NOT NULL AND churned IS NOT NULL),
ends AS (SELECT lo, (CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END) / 99 AS apart FROM (
         SELECT min(v) AS lo, max(v) AS hi FROM base)),
widths AS (SELECT * FROM (SELECT g, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2::DOUBLE) AS bw, min(v) AS lo, max(v) AS hi
         FROM base GROUP BY g) WHERE bw > 0),
grid AS (SELECT gi, lo + gi * apart AS x FROM ends, range(100) t(gi))"""


@register("agg_24_kde_by_churn", with_ctes("""
SELECT churned, round(x, 6) AS x, round(coalesce(k, 0.0) / (n * bw * sqrt(2 * pi())), 6) AS density,
       round(1e-6::DOUBLE / (bw * sqrt(2 * pi())), 6) AS max_error
FROM (SELECT w.g AS churned, n, bw, gi, x FROM widths w, grid) LEFT JOIN (
  SELECT g AS churned, gi, sum((c - r) * exp(-0.5::DOUBLE * pow((x - node) / bw, 2)) + r * exp(-0.5::DOUBLE * pow((x - node - step) / bw, 2))) AS k
  FROM (SELECT g, bw, step, lo + cell * step AS node, count(*) AS c, sum(place - cell) AS r
        FROM (SELECT g, bw, lo, step, place, least(floor(place), cells - 1) AS cell
              FROM (SELECT g, bw, lo, cells, (hi - lo) / cells AS step, (v - lo) / ((hi - lo) / cells) AS place
                    FROM base JOIN (SELECT *, ceil((hi - lo) / (2 * sqrt(1e-6::DOUBLE) * bw)) AS cells FROM widths) USING (g)))
        GROUP BY g, bw, lo, step, cell), grid
  WHERE x BETWEEN node - sqrt(-2 * ln(5e-7::DOUBLE)) * bw AND node + step + sqrt(-2 * ln(5e-7::DOUBLE)) * bw
  GROUP BY 1, 2) USING (churned, gi)""", _KDE_BASE))
def agg_24(spark, sf):
    return round_doubles(kde_by_group(subscribers(spark, sf), "song_skip_rate", "churned", grid_points=100))


@register("agg_24_kde_against_rows", with_ctes("""
SELECT w.g AS churned, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((x - v) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM base JOIN widths w USING (g), grid GROUP BY w.g, gi, x, n, bw""", _KDE_BASE))
def agg_24_rows(spark, sf):
    """Nodes so fine that the stated error is below the rounding: the SQL sums the kernel over all rows."""
    return round_doubles(kde_by_group(subscribers(spark, sf), "song_skip_rate", "churned", grid_points=100,
                                      tolerance=1e-12).drop("max_error"))


def _risk_scores(spark, sf):
    return scores(spark, sf).transform(fe.add_risk_level)


_RISK = ("CASE WHEN p_churn < 0.33::DOUBLE THEN 'Bajo' WHEN p_churn < 0.66::DOUBLE THEN 'Medio' "
         "ELSE 'Alto' END")


@register("agg_25_risk_counts", with_ctes(f"""
SELECT {_RISK} AS risk_level, count(*) AS count FROM scores GROUP BY 1""", "scores"))
def agg_25(spark, sf):
    return pr.value_counts_ordered(_risk_scores(spark, sf))


@register("agg_26_normalized_counts", with_ctes("""
SELECT customer_service_inquiries, round(count(*) * 1.0 / (SELECT count(*) FROM subscribers), 6)
  AS proportion FROM subscribers GROUP BY 1"""))
def agg_26(spark, sf):
    return round_doubles(pr.normalized_value_counts(subscribers(spark, sf), "customer_service_inquiries"))


@register("agg_27_scoring_kpis", with_ctes(f"""
SELECT count(*) AS n, round(avg(p_churn), 6) AS avg_p_churn,
       round(avg(CASE WHEN {_RISK} = 'Alto' THEN 1.0 ELSE 0.0 END), 6) AS pct_high,
       round(avg(CASE WHEN {_RISK} = 'Medio' THEN 1.0 ELSE 0.0 END), 6) AS pct_medium
FROM scores""", "scores"))
def agg_27(spark, sf):
    return round_doubles(pr.scoring_kpis(scores(spark, sf)))


_PROFILE_NUM = ["age", "weekly_hours", "song_skip_rate", "weekly_songs_played", "signup_date"]
_PROFILE_TXT = ["subscription_type", "customer_service_inquiries", "location", "payment_method"]


@register("agg_28_numeric_profile", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(min(CAST({c} AS DOUBLE)), 6) AS min, "
    f"round(max(CAST({c} AS DOUBLE)), 6) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median "
    f"FROM subscribers" for c in _PROFILE_NUM)))
def agg_28(spark, sf):
    return round_doubles(pr.numeric_profile(subscribers(spark, sf), _PROFILE_NUM))


@register("agg_28_text_options", with_ctes("\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM subscribers "
    f"WHERE {c} IS NOT NULL" for c in _PROFILE_TXT)))
def agg_28b(spark, sf):
    return pr.text_options(subscribers(spark, sf), _PROFILE_TXT)


def _mode_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column, 'text' AS kind, NULL::DOUBLE AS num_value, "
            f"coalesce((SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM subscribers "
            f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v ASC LIMIT 1), 'Unknown') AS text_value")


@register("agg_29_default_profile", with_ctes("\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column, 'numeric' AS kind, round(coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), "
     f"0.0), 6) AS num_value, NULL::VARCHAR AS text_value FROM subscribers" for c in _PROFILE_NUM] +
    [_mode_sql(c) for c in _PROFILE_TXT])))
def agg_29(spark, sf):
    return round_doubles(pr.default_profile(subscribers(spark, sf), _PROFILE_NUM, _PROFILE_TXT))


# column count, null total and type names come from DuckDB's own star
# expressions over the model-ready view, not from a column list
@register("agg_20_overview", with_ctes("""
SELECT a.n_rows, t.n_columns, n.n_nulls, a.churn_rate, t.dtypes FROM
  (SELECT count(*) AS n_rows, round(avg(CAST(churned AS DOUBLE)), 6) AS churn_rate FROM model_ready) a,
  (SELECT CAST(list_sum(list_value(*COLUMNS(*))) AS BIGINT) AS n_nulls
     FROM (SELECT count(*) - count(COLUMNS(*)) FROM model_ready)) n,
  (SELECT CAST(len(list_value(*COLUMNS(*))) AS INTEGER) AS n_columns, concat_ws(', ', *COLUMNS(*)) AS dtypes
     FROM (SELECT alias(COLUMNS(*)) || ':' ||
                  replace(replace(lower(typeof(COLUMNS(*))), 'varchar', 'string'), 'integer', 'int')
           FROM model_ready LIMIT 1)) t""", "model_ready"))
def agg_20(spark, sf):
    """AGG-20: one-row overview (rows, columns, nulls, churn rate, types)."""
    return round_doubles(pr.basic_overview(_mr(spark, sf)))
