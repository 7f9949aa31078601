"""Sources and sinks: CSV/Parquet round trips, optional sources, catalogue."""

import tempfile

import pytest
from pyspark.sql import functions as F

from attrix.operators import filters as fl
from attrix.plans.jobs import combined_training_job
from attrix.sources.io import (Catalogue, append_once, clear_batch, move_new, read_data, read_export, read_log,
                               read_optional, save_batch, write_table)


def test_csv_roundtrip_and_row_cap(spark):
    root = tempfile.mkdtemp(prefix="attrix-io-")
    df = spark.createDataFrame([(i, f"s{i}", i / 2) for i in range(10)], "id long, s string, x double")
    write_table(df.coalesce(1), f"{root}/t", fmt="csv")
    back = read_data(spark, f"{root}/t", fmt="csv", schema=df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert read_data(spark, f"{root}/t", fmt="csv", schema=df.schema, nrows=3).count() == 3
    inferred = read_export(spark, f"{root}/t")
    assert inferred.columns == ["id", "s", "x"]


def test_missing_path_raises(spark):
    with pytest.raises(FileNotFoundError):
        read_data(spark, "/nonexistent/attrix/path", fmt="parquet")


def test_optional_source_and_clear(spark):
    root = tempfile.mkdtemp(prefix="attrix-io-")
    schema = "id long, churned long"
    assert read_optional(spark, f"{root}/absent", schema).count() == 0
    clear_batch(spark, f"{root}/pending", schema)
    assert read_optional(spark, f"{root}/pending", schema).count() == 0


def test_catalogue_and_combined_job(spark):
    root = tempfile.mkdtemp(prefix="attrix-io-")
    cat = Catalogue(root)
    base = spark.createDataFrame([(1, 0), (2, 1)], "id long, churned long")
    cat.write(base, "train_model_ready_base")
    batch = spark.createDataFrame([(3, 1)], "id long, churned long")
    p = save_batch(batch, f"{root}/new", batch_name="b1")
    combined = combined_training_job(spark, cat.path("train_model_ready_base"), p, base.schema)
    assert combined.count() == 3
    empty = combined_training_job(spark, cat.path("train_model_ready_base"), f"{root}/none", base.schema)
    assert empty.count() == 2


def test_require_rows(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert fl.require_rows(df).count() == 1
    with pytest.raises(ValueError):
        fl.require_rows(df.where("x > 5"))


def test_a_batch_is_appended_once(spark, tmp_path):
    """The same batch twice is one set of records; torn and uncommitted attempts are invisible."""
    log = f"file://{tmp_path}/log"
    first = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, p double")
    assert read_log(spark, log, "id long, p double").count() == 0
    assert append_once(first, log, "2024-01-01") and not append_once(first, log, "2024-01-01")
    assert append_once(first.withColumn("note", F.lit("x")).drop("p"), log, "2024-01-01.b")     # other columns
    # a writer that died before its commit, and one that died while writing
    first.write.parquet(f"{log}/data/attempt=b-2024-01-02.{'0' * 32}")
    (tmp_path / "log/data/attempt=b-2024-01-03.1/_temporary").mkdir(parents=True)
    rows = read_log(spark, log, "id long, p double").orderBy("note", "id").collect()
    assert [(r.id, r.p, r.note) for r in rows] == [(1, 0.5, None), (2, 0.25, None), (1, None, "x"), (2, None, "x")]
    # two writers that both found the name free: the second rename is refused
    source = tmp_path / "late.txt"
    source.write_text("late")
    assert not move_new(spark, f"file://{source}", f"{log}/commits/2024-01-01.txt")
    with pytest.raises(ValueError):
        append_once(first, log, "a/b")
