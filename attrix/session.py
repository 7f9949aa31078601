"""Session helpers: one place for the configuration every job expects.

On a cluster the session is created by the platform and these helpers only
read from it.  Locally (tests, bench) they build a ``local[N]`` session with
AQE on, the UI off and a checkpoint folder when none is configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness of the operators (ANSI division,
# timezone-free day arithmetic) or for plan quality (AQE, skew handling).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app_name: str = "attrix", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions is None:
        shuffle_partitions = 8 if cpus == "*" else max(2, int(cpus))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    A folder set on the context, or else ``spark.checkpoint.dir``, is used as
    it is.  Only a local session (tests) without either gets a scratch folder;
    on a cluster a missing setting raises, as a machine-local folder would not
    be shared.
    """
    held = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if held:
        # Spark appends a folder of its own to the one that was set
        return configured or held
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="attrix-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def session_key(spark: SparkSession) -> tuple:
    """Identity of a live session (application id + JVM session hash), for
    per-session definitions of tables and views."""
    return (spark.sparkContext.applicationId, spark._jsparkSession.hashCode())
