"""Subscriber-shaped views derived from the TPC-H-like test tables.

The analysed project ships no input data, so its operators are exercised on
views that Spark derives from ``customer``, ``orders`` and ``nation``: one
row per customer, arithmetic that any SQL engine computes identically, and
nulls / edge values placed on purpose.  The same rules are written once more
as SQL text (``SUBSCRIBERS_SQL``) for the independent DuckDB oracle.

Scale notes: ``orders`` is aggregated per customer first (partial
aggregation, one shuffle on ``o_custkey``); the customer join then reuses
that partitioning.  The only broadcast is the one-row "latest order day".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import STATE_NAME_TO_CODE_19
from ..sources.io import read_table

# FIXED VALUES of the derived view: nation key -> location text.
_PROPER_19 = [s for s in STATE_NAME_TO_CODE_19 if s != "Nebrasksa"]
LOCATION_BY_NATION = _PROPER_19 + ["Nebrasksa", " Utah ", "Texas", "Puerto Rico",
                                   "District of Columbia", None]
SEGMENT_TO_PLAN = {"BUILDING": "Free", "AUTOMOBILE": "Student",
                   "MACHINERY": "Premium", "FURNITURE": "Family"}
PAYMENT_METHODS = ["Apple Pay", "Paypal", "Debit Card", "Credit Card"]
CHURN_GAP_DAYS = 365


def _day(c: str):
    return F.unix_date(F.to_date(F.col(c)))


_VIEWS: dict = {}


def _view(spark: SparkSession, key: tuple, build):
    """A derived view is defined once per session (a lazy plan, like a temp
    view); every query reading it still executes it from the source tables."""
    from ..session import session_key
    k = (session_key(spark), *key)
    if k not in _VIEWS:
        _VIEWS[k] = build()
    return _VIEWS[k]


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw subscriber table (fixture B1) with the 20 raw columns."""
    return _view(spark, ("subscribers", sf_dir), lambda: _subscribers(spark, sf_dir))


def _subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")

    per_customer = (orders
                    .select("o_custkey", "o_orderpriority", _day("o_orderdate").alias("d"))
                    .groupBy("o_custkey")
                    .agg(F.count(F.lit(1)).alias("n_orders"),
                         F.sum((F.col("o_orderpriority") == "1-URGENT").cast("long")).alias("n_urgent"),
                         F.min("d").alias("first_day"),
                         F.max("d").alias("last_day")))
    # the latest order day from the per-customer table: no second scan of orders
    latest = per_customer.agg(F.max("last_day").alias("latest_day"))

    k = F.col("c_custkey")
    n_urgent = F.coalesce(F.col("n_urgent"), F.lit(0))
    inquiries = (F.when(k % 97 == 0, F.lit(None).cast("string"))
                 .when(n_urgent <= 1, "Low").when(n_urgent == 2, "Medium").otherwise("High"))
    hours = (F.when(k % 50 == 0, F.lit(0.0)).when(k % 50 == 1, F.lit(50.0))
             .when(k % 50 == 2, F.lit(None).cast("double"))
             .otherwise(((k * 31) % 499).cast("double") / 10.0))
    plan = F.lit(None).cast("string")
    for seg, p in reversed(list(SEGMENT_TO_PLAN.items())):
        plan = F.when(F.col("c_mktsegment") == seg, F.lit(p)).otherwise(plan)
    location = F.element_at(F.array(*[F.lit(x).cast("string") for x in LOCATION_BY_NATION]),
                            (F.col("c_nationkey") + 1).cast("int"))
    songs = F.when(k % 41 == 0, F.lit(0)).otherwise(F.coalesce(F.col("n_orders"), F.lit(0)) * 10)
    churned = F.when(F.col("last_day").isNull(), F.lit(1)).otherwise(
        (F.col("latest_day") - F.col("last_day") > CHURN_GAP_DAYS).cast("long"))

    return (customer
            .join(per_customer, customer.c_custkey == per_customer.o_custkey, "left")
            .crossJoin(F.broadcast(latest))
            .select(
                k.cast("long").alias("customer_id"),
                (F.lit(18) + k % 63).cast("long").alias("age"),
                location.alias("location"),
                plan.alias("subscription_type"),
                F.when(k % 3 == 0, "Yearly").otherwise("Monthly").alias("payment_plan"),
                F.element_at(F.array(*[F.lit(x) for x in PAYMENT_METHODS]),
                             (k % 4 + 1).cast("int")).alias("payment_method"),
                (k % 5).cast("long").alias("num_subscription_pauses"),
                (-(F.col("latest_day") - F.col("first_day"))).cast("long").alias("signup_date"),
                hours.alias("weekly_hours"),
                (F.abs(F.col("c_acctbal")) / 100.0).alias("average_session_length"),
                (((k * 37) % 101).cast("double") / 100.0).alias("song_skip_rate"),
                songs.cast("long").alias("weekly_songs_played"),
                (k % 120).cast("long").alias("weekly_unique_songs"),
                (k % 30).cast("long").alias("num_favorite_artists"),
                (k % 200).cast("long").alias("num_platform_friends"),
                (k % 17).cast("long").alias("num_playlists_created"),
                (k % 11).cast("long").alias("num_shared_playlists"),
                (k % 25).cast("long").alias("notifications_clicked"),
                inquiries.alias("customer_service_inquiries"),
                churned.cast("long").alias("churned"),
            ))


def _sql_case(expr: str, mapping: dict, else_sql: str = "NULL") -> str:
    parts = " ".join(f"WHEN {k!r} THEN {v!r}" if isinstance(k, str)
                     else f"WHEN {k} THEN {'NULL' if v is None else repr(v)}"
                     for k, v in mapping.items())
    return f"CASE {expr} {parts} ELSE {else_sql} END"


def subscribers_sql() -> str:
    """The same view as SQL text (DuckDB dialect) for the oracle."""
    loc = _sql_case("c_nationkey", dict(enumerate(LOCATION_BY_NATION)))
    plan = _sql_case("c_mktsegment", SEGMENT_TO_PLAN)
    pay = _sql_case("c_custkey % 4", dict(enumerate(PAYMENT_METHODS)))
    return f"""
subscribers AS (
  SELECT
    CAST(c_custkey AS BIGINT) AS customer_id,
    CAST(18 + c_custkey % 63 AS BIGINT) AS age,
    {loc} AS location,
    {plan} AS subscription_type,
    CASE WHEN c_custkey % 3 = 0 THEN 'Yearly' ELSE 'Monthly' END AS payment_plan,
    {pay} AS payment_method,
    CAST(c_custkey % 5 AS BIGINT) AS num_subscription_pauses,
    CAST(-(lt.latest_day - pc.first_day) AS BIGINT) AS signup_date,
    CASE WHEN c_custkey % 50 = 0 THEN 0.0::DOUBLE
         WHEN c_custkey % 50 = 1 THEN 50.0::DOUBLE
         WHEN c_custkey % 50 = 2 THEN NULL::DOUBLE
         ELSE CAST((c_custkey * 31) % 499 AS DOUBLE) / 10.0::DOUBLE END AS weekly_hours,
    abs(c_acctbal) / 100.0::DOUBLE AS average_session_length,
    CAST((c_custkey * 37) % 101 AS DOUBLE) / 100.0::DOUBLE AS song_skip_rate,
    CAST(CASE WHEN c_custkey % 41 = 0 THEN 0 ELSE coalesce(pc.n_orders, 0) * 10 END AS BIGINT)
      AS weekly_songs_played,
    CAST(c_custkey % 120 AS BIGINT) AS weekly_unique_songs,
    CAST(c_custkey % 30 AS BIGINT) AS num_favorite_artists,
    CAST(c_custkey % 200 AS BIGINT) AS num_platform_friends,
    CAST(c_custkey % 17 AS BIGINT) AS num_playlists_created,
    CAST(c_custkey % 11 AS BIGINT) AS num_shared_playlists,
    CAST(c_custkey % 25 AS BIGINT) AS notifications_clicked,
    CASE WHEN c_custkey % 97 = 0 THEN NULL
         WHEN coalesce(pc.n_urgent, 0) <= 1 THEN 'Low'
         WHEN coalesce(pc.n_urgent, 0) = 2 THEN 'Medium'
         ELSE 'High' END AS customer_service_inquiries,
    CAST(CASE WHEN pc.last_day IS NULL THEN 1
              WHEN lt.latest_day - pc.last_day > {CHURN_GAP_DAYS} THEN 1 ELSE 0 END AS BIGINT)
      AS churned
  FROM customer
  LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders,
           sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent,
           min(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS first_day,
           max(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS last_day
    FROM orders GROUP BY o_custkey) pc ON customer.c_custkey = pc.o_custkey
  CROSS JOIN (SELECT max(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS latest_day
              FROM orders) lt
)"""


def scores(spark: SparkSession, sf_dir: str, signal: bool = False) -> DataFrame:
    """Deterministic score table (B2; B3 with ``signal=True``)."""
    return _view(spark, ("scores", sf_dir, signal), lambda: _scores(spark, sf_dir, signal))


def _scores(spark: SparkSession, sf_dir: str, signal: bool) -> DataFrame:
    subs = subscribers(spark, sf_dir)
    k = F.col("customer_id")
    noise = ((k * 7919) % 1000).cast("double") / 1000.0
    p = (F.col("churned").cast("double") * 0.5 + noise * 0.5) if signal else noise
    return (subs.select(
        "customer_id",
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
        F.col("churned").cast("long").alias("y_true"),
        p.alias("p_churn"))
        .withColumn("y_pred", (F.col("p_churn") >= 0.5).cast("long")))


def scores_sql(signal: bool = False) -> str:
    noise = "CAST((customer_id * 7919) % 1000 AS DOUBLE) / 1000.0::DOUBLE"
    p = f"(CAST(churned AS DOUBLE) * 0.5::DOUBLE + {noise} * 0.5::DOUBLE)" if signal else noise
    name = "signal_scores" if signal else "scores"
    return f"""
{name} AS (
  SELECT customer_id, 'm' || CAST(customer_id % 3 AS VARCHAR) AS model,
         CAST(churned AS BIGINT) AS y_true, {p} AS p_churn,
         CAST(CASE WHEN {p} >= 0.5::DOUBLE THEN 1 ELSE 0 END AS BIGINT) AS y_pred
  FROM subscribers)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to labels: a second, real binary target."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "inner")
