"""Retraining from new labelled batches with Structured Streaming (ST-1 … ST-4).

The original polls one CSV path, keeps its modification time as a cursor and
launches a retraining run when the file changed and has rows.  Here the unit is
a batch, however many part files it has:

* ST-1: a writer first stores the batch's directory, then announces it by a
  manifest file that holds its name (:func:`attrix.sources.io.save_batch`).
  The stream reads the manifests; for each announced batch the handler reads
  the whole directory, merges it with the base table, retrains and exports;
* ST-2: a batch that is empty or lacks required columns is skipped, and the reason
  is logged; the stream goes on.  A read that fails is tried again (``ATTEMPTS``
  times); only a batch that then is proved absent or damaged is skipped, any other
  failure ends the stream before its checkpoint passes the batch;
* ST-3: the checkpoint remembers which manifests were consumed, so a restart
  resumes after the last committed batch; a table of attempts (batch, attempt,
  error) beside the log remembers the failures across restarts;
* ST-4: one run per batch name, written under ``<out>/batch=<name>`` with
  overwrite: a replay rewrites the same output (idempotent).

``trigger(availableNow=True)`` processes what is there and stops, which is
the sensor's "run when something arrived" in batch form; a long-running
deployment uses a processing-time trigger instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.groups import release_small_tables
from ..operators.reshape import append_batch
from ..sources.io import batch_path, manifest_dir, write_table


ATTEMPT_SCHEMA = "name string, attempt int, error string"
#: tries of a batch's read, and seconds between them (times the number of the try)
ATTEMPTS = 3
WAIT_SECONDS = 2.0
# FIXED VALUES: how Spark names a missing or damaged input
DAMAGE = ("PATH_NOT_FOUND", "Path does not exist", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER",
          "is not a Parquet file", "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD", "CSV header does not conform", "ChecksumException")


def damaged(error: Exception) -> bool:
    """Whether an error says that the input itself is absent or can't be read."""
    return any(name in str(error) for name in DAMAGE)


def default_trainer(combined: DataFrame, out_path: str,
                    rf_params: Mapping[str, Any] | None = None) -> None:
    """Retrain the final forest on ``combined`` and export its bundle."""
    from ..operators.features import build_model_ready
    from ..operators.ml import export_training_outputs, train_final_model
    data = combined if "age_group" in combined.columns else combined.transform(build_model_ready)
    bundle = train_final_model(data, rf_params=rf_params)
    export_training_outputs(bundle, out_path)
    bundle["data"].unpersist()


def read_batch(spark: SparkSession, batches_dir: str, name: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """All part files of one batch.  Parquet brings its own columns (checked
    against the base later); a CSV's header must agree with ``schema``."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.load(batch_path(batches_dir, name))


def make_batch_handler(batches_dir: str, schema: StructType, base: DataFrame, out_root: str,
                       trainer: Callable[[DataFrame, str], None] = default_trainer,
                       log_path: str | None = None, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Handler of a micro-batch of manifests.  ``log_path`` gets one record
    per announced batch: ``name, status, n_rows, n_new, churn_rate``; the table
    ``<log_path>_attempts`` one per failed read: ``name, attempt, error``."""
    def log(spark: SparkSession, name: str, status: str, combined: DataFrame | None = None, n_new: int = 0) -> None:
        if not log_path:
            return
        if combined is None:
            record = spark.range(1).select(F.lit(0).cast("long").alias("n_rows"), F.lit(None).cast("double").alias("churn_rate"))
        else:
            record = combined.agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.avg(F.col("churned").cast("double")).alias("churn_rate"))
        write_table(record.select(F.lit(name).alias("name"), F.lit(status).alias("status"), "n_rows",
                                  F.lit(n_new).cast("long").alias("n_new"), "churn_rate"), f"{log_path}/batch={name}")

    def note(spark: SparkSession, name: str, attempt: int, error: Exception) -> None:
        if log_path:
            spark.createDataFrame([(name, attempt, str(error).split("\n")[0][:500])], ATTEMPT_SCHEMA).coalesce(1) \
                .write.mode("append").parquet(f"{log_path}_attempts")

    def read_whole(spark: SparkSession, name: str) -> tuple[DataFrame, int]:
        batch = read_batch(spark, batches_dir, name, schema, fmt)
        combined = append_batch(base, batch)                  # SET-1 (column check)
        # every column is read once, so that a damaged file shows here and not in the middle of training
        return combined, append_batch(base.limit(0), batch).select(F.hash(*base.columns).alias("h")) \
            .agg(F.count("h"), F.max("h")).first()[0]

    def retrain(spark: SparkSession, name: str) -> None:
        for attempt in range(1, ATTEMPTS + 1):
            try:
                combined, n_new = read_whole(spark, name)
                break
            except ValueError as e:                               # ST-2: columns missing
                return log(spark, name, f"skipped: {e}")
            except (PySparkException, Py4JError) as e:
                note(spark, name, attempt, e)
                if attempt < ATTEMPTS:
                    time.sleep(WAIT_SECONDS * attempt)
                elif damaged(e):                                  # ST-2: absent or unreadable every time
                    return log(spark, name, "skipped: unreadable")
                else:
                    raise
        if not n_new:
            return log(spark, name, "skipped: empty")
        trainer(combined, f"{out_root.rstrip('/')}/batch={name}")     # ST-4
        log(spark, name, "trained", combined, n_new)

    def handle(manifests: DataFrame, _batch_id: int) -> None:
        # one name per manifest, as many manifests as the trigger takes
        names = [r["value"].strip() for r in manifests.select("value").distinct().orderBy("value").collect()]
        for name in names:
            try:
                retrain(manifests.sparkSession, name)
            finally:
                # the stream runs for days: drop this batch's small cached tables
                release_small_tables()
    return handle


def start_retraining(spark: SparkSession, batches_dir: str, schema: StructType, base: DataFrame,
                     out_root: str, checkpoint: str, fmt: str = "parquet",
                     trainer: Callable[[DataFrame, str], None] = default_trainer,
                     log_path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """ST-1: start the stream; ``query.awaitTermination()`` waits for it."""
    manifests = (spark.readStream.format("text").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
                 .load(manifest_dir(spark, batches_dir)))
    writer = (manifests.writeStream
              .foreachBatch(make_batch_handler(batches_dir, schema, base, out_root, trainer, log_path, fmt))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
