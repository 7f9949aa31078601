"""Literal edge frames for the null / tie / rounding rules (N1 … N17)."""

import pytest
from pyspark.sql import functions as F

from attrix.functions import dims
from attrix.functions.binning import cut
from attrix.functions.columns import classify_risk, format_fixed, format_percent, half_even
from attrix.operators import features as fe
from attrix.operators import filters as fl
from attrix.operators import profile as pr
from attrix.operators import reshape as rs
from attrix.operators import topk as tk
from attrix.operators.quantiles import exact_median, modes


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_n1_flag_on_null_is_zero(spark):
    df = spark.createDataFrame([("Free",), ("Premium",), (None,)], "subscription_type string")
    out = fe.add_equality_flag(df, "subscription_type", "Free", "is_free_plan")
    assert [r.is_free_plan for r in out.collect()] == [1, 0, 0]


def test_n2_n3_null_group_and_count_flavours(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 0)], "k string, churned int")
    kept = {r.segmento: r.n_clientes for r in pr.segment_summary(df, "k").collect()}
    assert kept == {"a": 2, None: 1}                        # size counts rows
    table = pr.churn_table_by_category(df, "k")
    assert rows(table, "k", "n_obs") == [("a", 1)]          # count(col) skips null, null key dropped


def test_n4_dense_bins(spark):
    df = spark.createDataFrame([(1.0, 1), (5.0, 0)], "x double, churned int")
    out = pr.churn_by_numeric_bins(df, "x", [0, 2, 4, 6, 8, 10], ["b1", "b2", "b3", "b4", "b5"])
    got = rows(out, "x_bin", "churn_pct")
    assert [g[0] for g in got] == ["b1", "b2", "b3", "b4", "b5"]
    assert [g[1] is None for g in got] == [False, True, False, True, True]


def test_n6_sort_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "id int, v double")
    assert [r.v for r in tk.sort_rows(df, "v", True, "id").collect()] == [1.0, 2.0, None]
    assert [r.v for r in tk.sort_rows(df, "v", False, "id").collect()] == [2.0, 1.0, None]


def test_n7_half_even_rounding(spark):
    df = spark.createDataFrame([(0.0625,)], "x double")
    assert df.select(half_even("x", 3).alias("r")).first().r == 0.062


def test_python_style_formatting(spark):
    df = spark.createDataFrame([(0.595,), (0.125,), (0.5,), (None,)], "x double")
    got = [r.t for r in df.select(format_fixed("x", 2).alias("t")).collect()]
    assert got == [format(0.595, ".2f"), format(0.125, ".2f"), format(0.5, ".2f"), None]
    pct = df.select(format_percent("x", 2).alias("t")).first().t
    assert pct == format(0.595, ".2%")


def test_n8_zero_hours(spark):
    df = spark.createDataFrame([(10, 0.0), (10, None)], "weekly_songs_played long, weekly_hours double")
    assert [r.songs_per_hour for r in fe.add_songs_per_hour(df, "canonical").collect()] == [None, None]
    assert [r.songs_per_hour for r in fe.add_songs_per_hour(df, "early").collect()] == [10.0, None]


def test_n9_n11_median_and_mode(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert exact_median(df, "x").first()["median"] == 3.0
    m = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "v string")
    assert modes(m, "v").first()["mode"] == "a"


def test_n12_risk_classes(spark):
    df = spark.createDataFrame([(None,), (0.33,), (0.66,), (0.1,)], "p double")
    got = [r.r for r in df.select(classify_risk("p").alias("r")).collect()]
    assert got == ["Alto", "Medio", "Alto", "Bajo"]


def test_n13_n14_bins(spark):
    df = spark.createDataFrame([(18,), (25,), (26,), (80,), (81,)], "age long")
    assert [r.age_group for r in fe.add_age_group(df).collect()] == ["18-24", "18-24", "25-34", "65-79", None]
    h = spark.createDataFrame([(0.0,), (5.0,), (49.9,), (50.0,)], "weekly_hours double")
    assert [r.weekly_hours_bin for r in fe.add_weekly_hours_bin(h).collect()] == ["0-5", "5-10", "40-50", None]
    s = spark.createDataFrame([(0.2,), (1.0,)], "song_skip_rate double")
    assert [r.skip_rate_bin for r in fe.add_skip_rate_bin(s).collect()] == ["0.2-0.4", "0.8-1.0"]


def test_cut_default_labels(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    assert df.select(cut("x", [0, 1, 2]).alias("b")).first().b == "(1.0, 2.0]"


def test_n15_empty_filter_list(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert fl.by_values(df, "k", []).count() == 2
    assert fl.by_values(df, "k", ["a"]).count() == 1


def test_n16_trimmed_lookup(spark):
    df = spark.createDataFrame([("Nebrasksa",), (" Utah ",), (" Nebrasksa ",), (None,)], "location string")
    out = fe.add_model_ready_features(df).collect()
    assert [r.location for r in out] == ["Nebraska", " Utah ", " Nebrasksa ", None]
    assert [r.state_code for r in out] == ["NE", "UT", "NE", None]
    assert [r.region for r in out] == ["Midwest", "West", "Midwest", None]


def test_set1_append_batch_rules(spark):
    base = spark.createDataFrame([(1, "a")], "id long, k string")
    empty = spark.createDataFrame([], "")
    assert rs.append_batch(base, empty).count() == 1
    extra = spark.createDataFrame([("z", "b", 2)], "x string, k string, id long")
    assert rows(rs.append_batch(base, extra), "id", "k") == [(1, "a"), (2, "b")]
    missing = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(ValueError, match="k"):
        rs.append_batch(base, missing)


def test_missing_column_tenure_bucket(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        fe.add_tenure_bucket(df)


def test_align_to_schema(spark):
    train = spark.createDataFrame([(1, 2.0, "a", 1)], "id long, x double, region string, churned long")
    inc = spark.createDataFrame([("x1", "b", 9)], "x string, region string, extra int")
    out = fe.align_to_schema(inc, train.schema)
    assert out.columns == ["id", "x", "region", "churned"]
    r = out.first()
    assert (r.id, r.x, r.region, r.churned) == (None, None, "b", None)


def test_risk_filter_all_and_missing_column(spark):
    df = spark.createDataFrame([(0.1,), (0.9,)], "p_churn double")
    assert fl.by_risk_level(df, dims.RISK_ALL).count() == 2
    assert fl.by_risk_level(df, "Alto").count() == 2     # no risk column -> unchanged
    table = tk.filter_risk_table(df, "Alto", active=False, id_col="p_churn")
    assert [r.p_churn for r in table.collect()] == [0.9]


def test_golden_comparison_unpivot(spark):
    # stored comparison (three models, five metrics) -> 15-row long table
    wide = spark.createDataFrame(
        [("RF Tuned", 0.84748, 0.84931, 0.85454, 0.85192, 0.93825),
         ("LogReg Tuned", 0.84140, 0.84616, 0.84464, 0.84540, 0.93020),
         ("DNN Tuned", 0.82804, 0.85024, 0.80725, 0.82818, 0.92189)],
        "model string, accuracy double, precision double, recall double, f1 double, roc_auc double")
    long = rs.to_long(wide, ["model"], ["accuracy", "precision", "recall", "f1", "roc_auc"])
    assert long.count() == 15
    best = tk.top_n_ascending(wide, "roc_auc", 1, "model").first()
    assert best.model == "RF Tuned"


def test_clean_feature_names(spark):
    df = spark.createDataFrame([("num__weekly_hours",), ("cat__subscription_type_Free",)], "feature string")
    got = [r.feature_clean for r in fe.add_clean_feature_name(df).collect()]
    assert got == ["weekly hours", "subscription type Free"]


def test_attach_scalars_needs_one_row(spark):
    from attrix.operators.joins import attach_scalars
    rows = spark.range(3)
    assert attach_scalars(rows, spark.range(5, 6).toDF("x")).count() == 3
    for n in (0, 2):
        with pytest.raises(Exception, match="exactly one row"):
            attach_scalars(rows, spark.range(n).toDF("x")).collect()


def test_large_dictionary_joins(spark):
    from attrix.operators.joins import dimension, lookup_join
    dim = dimension(spark, {str(i): str(-i) for i in range(120_000)}, "k", "v")
    got = lookup_join(spark.createDataFrame([("7",), ("x",)], "k string"), dim, "k").collect()
    assert {r["k"]: r["v"] for r in got} == {"7": "-7", "x": None}


def test_align_keeps_numbers(spark):
    train = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long").schema
    got = spark.createDataFrame([(12.0, "12.0", 5), (7.5, " 7", 6), (float("nan"), "x1", None)],
                                "a double, b string, c int")
    out = fe.align_to_schema(got, train)
    assert [tuple(r) for r in out.collect()] == [(12.0, 12.0, 5), (7.5, 7.0, 6), (None, None, None)]


def test_nan_is_missing(spark, tmp_path):
    from attrix.sources.io import read_data
    with open(tmp_path / "x.csv", "w") as f:
        f.write("song_skip_rate,n\nNaN,1\n0.9,2\n")
    df = read_data(spark, str(tmp_path / "x.csv"))
    assert [r[0] for r in df.collect()] == [None, 0.9]
    raw = spark.createDataFrame([(float("nan"),), (0.9,)], "song_skip_rate double")
    assert [r["high_skip_user"] for r in fe.add_high_skip(raw).collect()] == [0, 1]
    assert pr.basic_overview(raw, "none").first()["n_nulls"] == 1


def test_missing_percent_is_half_even(spark):
    df = spark.range(800).select(F.when(F.col("id") > 0, F.col("id")).alias("x"))
    assert pr.missing_values(df).first()["pct_missing"] == 0.12


def test_column_types(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "n long, location string, x double")
    assert fe.split_column_types(df) == (["n", "x"], ["location"])
    assert fe.split_column_types(df, ["location", "n", "absent"]) == (["x"], ["location", "n"])
