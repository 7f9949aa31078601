"""The analysed project's pipeline steps as Spark jobs (JOB-1 … JOB-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features as fe
from ..operators import profile as pr


def segment_summary_job(raw: DataFrame) -> DataFrame:
    """JOB-3: raw -> model-ready -> plan x inquiries summary."""
    return pr.two_key_summary(raw.transform(fe.build_model_ready))


def model_ready_job(raw: DataFrame) -> DataFrame:
    """JOB-1: raw -> model-ready (write it with ``sources.io.write_table``)."""
    return raw.transform(fe.build_model_ready)


def incoming_prediction_ready_job(raw_incoming: DataFrame, raw_train: DataFrame) -> DataFrame:
    """JOB-2: incoming -> same preparation -> aligned to the training schema.
    Only the training *schema* is needed: no training rows are read."""
    train_schema = raw_train.transform(fe.build_model_ready).schema
    prepared = raw_incoming.transform(fe.build_model_ready)
    return fe.align_to_schema(prepared, train_schema)


def base_and_pool_job(model_ready: DataFrame, pool_size: int = 1000, seed: int = 42,
                      target: str = "churned", id_col: str = "customer_id") -> DataFrame:
    """JOB-4: flag an exact-size stratified retraining pool (``in_pool``);
    base = in_pool 0, pool = in_pool 1 — write both with ``write_table``."""
    from ..operators.split import reserve_pool
    return reserve_pool(model_ready, target, id_col, pool_size, seed)


def combined_training_job(spark, base_path: str, batch_path: str, schema, fmt: str = "parquet") -> DataFrame:
    """JOB-5 input: the reduced base plus the pending batch (optional source;
    empty -> base only; missing columns -> error)."""
    from ..operators.reshape import append_batch
    from ..sources.io import read_data, read_optional
    base = read_data(spark, base_path, fmt=fmt, schema=schema)
    batch = read_optional(spark, batch_path, schema, fmt=fmt)
    return append_batch(base, batch)


def scoring_log_job(model, incoming_aligned: DataFrame, source: str, model_name: str,
                    log: DataFrame | None = None) -> DataFrame:
    """JOB-7: score incoming customers, classify risk, add provenance and
    append to the scoring log (columns may differ: missing -> NULL)."""
    from ..operators import ml
    from ..operators.features import add_constants, add_risk_level
    from ..operators.reshape import append_records
    scored = ml.score(model, incoming_aligned)
    keep = [c for c in incoming_aligned.columns] + ["p_churn"]
    records = (scored.select(*keep).transform(add_risk_level)
               .transform(add_constants, {"source": source, "model_used": model_name}))
    return records if log is None else append_records(log, records)
