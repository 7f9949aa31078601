"""Retraining stream: whole batches, skipped batches, restart from the checkpoint."""

import glob
import tempfile

from pyspark.sql import functions as F

from attrix.sources.io import announce_batch, read_data, save_batch
from attrix.streaming.retrain import start_retraining

from .conftest import SF_SMALL


def test_batches_are_the_unit(spark):
    from attrix.plans.fixtures import subscribers
    run = tempfile.mkdtemp(prefix="attrix-st-")
    raw = subscribers(spark, SF_SMALL).cache()
    base = raw.where(F.col("customer_id") % 10 >= 3)
    seen = {}

    def trainer(combined, out):
        seen[out] = combined.count()

    def stream():
        q = start_retraining(spark, f"{run}/batches", raw.schema, base, f"{run}/out", f"{run}/ckpt",
                             trainer=trainer, log_path=f"{run}/log")
        q.awaitTermination()

    stream()                                                # nothing announced yet
    assert seen == {}
    part = lambda k: raw.where(F.col("customer_id") % 10 == k)
    path = save_batch(part(1).repartition(5), f"{run}/batches", batch_name="b1")
    assert len(glob.glob(f"{path}/part-*")) >= 4            # several part files, one run on all of them
    save_batch(raw.where(F.lit(False)), f"{run}/batches", batch_name="b_empty")
    broken = save_batch(part(1).coalesce(1), f"{run}/batches", batch_name="b_broken")
    for f in glob.glob(f"{broken}/part-*"):
        with open(f, "r+b") as x:
            x.write(b"not a parquet file")
            x.seek(-20, 2)
            x.write(b"nothing here either!")
    save_batch(part(1).drop("age"), f"{run}/batches", batch_name="b_columns")
    announce_batch(spark, f"{run}/batches", "b_absent")
    stream()
    n_base = base.count()
    assert seen == {f"{run}/out/batch=b1": n_base + part(1).count()}

    # a further batch arrives; a restarted query only processes that one
    save_batch(part(2).repartition(4), f"{run}/batches", batch_name="b2")
    stream()
    assert len(seen) == 2 and seen[f"{run}/out/batch=b2"] == n_base + part(2).count()
    log = {r["name"]: r for r in read_data(spark, f"{run}/log", fmt="parquet").collect()}
    assert {k: r["status"].split(":")[0] for k, r in log.items()} == {
        "b1": "trained", "b2": "trained", "b_empty": "skipped", "b_broken": "skipped", "b_columns": "skipped",
        "b_absent": "skipped"}
    assert {r.name for r in spark.read.parquet(f"{run}/log_attempts").collect()} == {"b_broken", "b_absent"}
    assert log["b1"]["n_rows"] == n_base + part(1).count() and log["b1"]["n_new"] == part(1).count()


def test_csv_batch(spark):
    run = tempfile.mkdtemp(prefix="attrix-st-")
    base = spark.createDataFrame([(1, 0), (2, 1)], "customer_id long, churned long")
    seen = []
    save_batch(spark.range(10, 18).select(F.col("id").alias("customer_id"), F.lit(1).cast("long").alias("churned")),
               f"{run}/batches", fmt="csv", batch_name="b1")
    start_retraining(spark, f"{run}/batches", base.schema, base, f"{run}/out", f"{run}/ckpt", fmt="csv",
                     trainer=lambda c, _out: seen.append(c.count())).awaitTermination()
    assert seen == [10]


def test_a_transient_failure_is_tried_again(spark, monkeypatch, tmp_path):
    """A reader that fails twice and then works: trained once, two failures in the table."""
    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql.streaming import StreamingQueryException

    from attrix.streaming import retrain
    run = str(tmp_path)
    base = spark.createDataFrame([(1, 0), (2, 1)], "customer_id long, churned long")
    monkeypatch.setattr(retrain, "WAIT_SECONDS", 0.01)
    read, calls, seen = retrain.read_batch, [], []

    def flaky(failures):
        def fail(*args):
            calls.append(args[2])
            if len(calls) <= failures:
                raise PySparkException("executor lost")
            return read(*args)
        return fail

    def stream():
        retrain.start_retraining(spark, f"{run}/batches", base.schema, base, f"{run}/out", f"{run}/ckpt", log_path=f"{run}/log",
                                 trainer=lambda c, _out: seen.append(c.count())).awaitTermination()

    save_batch(spark.createDataFrame([(7, 1)], base.schema), f"{run}/batches", batch_name="b1")
    monkeypatch.setattr(retrain, "read_batch", flaky(2))
    stream()
    assert seen == [3] and calls == ["b1"] * 3
    noted = spark.read.parquet(f"{run}/log_attempts").orderBy("attempt").collect()
    assert [(r.name, r.attempt, r.error) for r in noted] == [("b1", 1, "executor lost"), ("b1", 2, "executor lost")]

    # one that goes on failing ends the stream; nothing is skipped, and a restart trains it
    save_batch(spark.createDataFrame([(8, 1), (9, 0)], base.schema), f"{run}/batches", batch_name="b2")
    calls.clear()
    monkeypatch.setattr(retrain, "read_batch", flaky(99))
    with pytest.raises(StreamingQueryException):
        stream()
    assert len(calls) == retrain.ATTEMPTS and seen == [3]
    monkeypatch.setattr(retrain, "read_batch", read)
    stream()
    assert seen == [3, 4]
    assert {r["name"]: r["status"] for r in read_data(spark, f"{run}/log", fmt="parquet").collect()} == {"b1": "trained", "b2": "trained"}
