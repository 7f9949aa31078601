"""Sources and sinks (SRC-*, SNK-*).

The original reads and writes header CSV files with inferred types.  Here a
table is read with an explicit schema when one is known (no inference pass
over 100 TB), Parquet is the default format, and every write is a Spark
write: partitioned files in a shared folder, never a single local file.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.columns import nan_to_null

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_TABLES: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the (read-only) test tables (Parquet; filters and projections
    push down).  The DataFrame is defined once per session — like a table in
    a catalogue — so file listing and footer reads are not repeated."""
    from ..session import session_key
    key = (session_key(spark), table_path(sf_dir, name))
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = spark.read.parquet(table_path(sf_dir, name))
    return df


def read_data(spark: SparkSession, path: str, fmt: str = "csv",
              schema: StructType | str | None = None, nrows: int | None = None,
              header: bool = True) -> DataFrame:
    """SRC-1/SRC-6: read a header CSV (or Parquet/JSON/ORC) table.

    ``nrows`` keeps the first rows only, as a preview cap the caller asks for.
    A missing path raises ``FileNotFoundError`` like the original.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.load(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"file not found: {path}") from exc
        raise
    # NaN is a missing value, as in the reference's reader
    floats = {f.name: nan_to_null(F.col(f"`{f.name}`")).cast(f.dataType) for f in df.schema.fields
              if isinstance(f.dataType, (DoubleType, FloatType))}
    df = df.withColumns(floats) if floats else df
    return df.limit(nrows) if nrows is not None else df


def read_data_with_features(spark: SparkSession, path: str, fmt: str = "csv",
                            schema: StructType | str | None = None) -> DataFrame:
    """SRC-2: lazy partitioned read followed by the light feature step."""
    from ..operators.features import add_basic_features
    return read_data(spark, path, fmt=fmt, schema=schema).transform(add_basic_features)


def read_export(spark: SparkSession, path: str, index_col: str | None = None) -> DataFrame:
    """SRC-3: an exported result table; an index column is an ordinary column
    (an unnamed leading CSV column is renamed to ``index_col``)."""
    df = read_data(spark, path, fmt="csv")
    if index_col and "_c0" in df.columns:
        df = df.withColumnRenamed("_c0", index_col)
    return df


class Catalogue:
    """SRC-4: the named tables of a project, resolved under one root folder."""

    DEFAULT_NAMES = {
        "raw_train": "raw/train",
        "raw_incoming": "raw/incoming_customers",
        "train_model_ready": "processed/train_model_ready",
        "train_model_ready_base": "processed/train_model_ready_base",
        "retraining_pool": "processed/retraining_pool",
        "incoming_prediction_ready": "processed/incoming_prediction_ready",
        "new_batches": "new_data/batches",
        "scoring_log": "processed/scoring_log",
        "exports": "exports",
        "models": "models",
    }

    def __init__(self, root: str, fmt: str = "parquet", names: dict | None = None):
        self.root = root.rstrip("/")
        self.fmt = fmt
        self.names = dict(self.DEFAULT_NAMES, **(names or {}))

    def path(self, name: str) -> str:
        return f"{self.root}/{self.names.get(name, name)}"

    def read(self, spark: SparkSession, name: str, schema=None) -> DataFrame:
        return read_data(spark, self.path(name), fmt=self.fmt, schema=schema)

    def read_optional(self, spark: SparkSession, name: str, schema) -> DataFrame:
        return read_optional(spark, self.path(name), schema, fmt=self.fmt)

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> str:
        return write_table(df, self.path(name), fmt=self.fmt, mode=mode)


def read_optional(spark: SparkSession, path: str, schema: StructType | str,
                  fmt: str = "parquet") -> DataFrame:
    """SRC-5: an optional source — absent or empty gives an empty typed table."""
    try:
        return read_data(spark, path, fmt=fmt, schema=schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """SNK-1/SNK-4/SNK-5: overwrite (or append) a table as partitioned files."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # text is kept as it is, blanks at its ends included
        writer = writer.option("header", True).option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def batch_path(batches_dir: str, name: str) -> str:
    return f"{batches_dir.rstrip('/')}/data/{name}"


def manifest_dir(spark: SparkSession, batches_dir: str) -> str:
    """Folder of the manifests, made if absent (a stream needs it to start)."""
    path = f"{batches_dir.rstrip('/')}/manifest"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hpath)
    return path


def announce_batch(spark: SparkSession, batches_dir: str, name: str) -> None:
    """Tell the retraining stream that the batch ``name`` is complete."""
    (spark.createDataFrame([(name,)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{manifest_dir(spark, batches_dir)}/{name}"))


def save_batch(df: DataFrame, batches_dir: str, fmt: str = "parquet",
               batch_name: str | None = None) -> str:
    """SNK-2: write a pending batch (any number of part files) under a new,
    unique directory name, then announce it.

    The stream's checkpoint remembers which announcements were consumed, so
    "clearing" the pending batch is not needed.
    """
    name = batch_name or f"batch-{uuid.uuid4().hex}"
    path = batch_path(batches_dir, name)
    write_table(df, path, fmt=fmt, mode="errorifexists")
    announce_batch(df.sparkSession, batches_dir, name)
    return path


def clear_batch(spark: SparkSession, path: str, schema: StructType | str,
                fmt: str = "parquet") -> str:
    """SNK-2: overwrite a batch location with an empty, typed table."""
    return write_table(spark.createDataFrame([], schema), path, fmt=fmt, mode="overwrite")


# -- SET-2 / JOB-7: a log that grows, each batch once --------------------------------------------

def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file to a name that must be free; False if it is taken."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(paths[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdir(paths[1].getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    if files.util().exists(paths[1]):
        return False
    no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(paths[0], paths[1], no_options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def append_once(records: DataFrame, log_path: str, batch: str) -> bool:
    """Append the records of ``batch`` to a log, once however often the job runs.

    The records are staged under an attempt of their own; one rename of a small
    manifest, which names the attempt, to the batch's name commits it.  A job that
    was repeated finds the name taken (False, nothing is added); an attempt whose
    writer died has no manifest and is never read."""
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"a batch name has letters, digits, dots and dashes only: {batch}")
    spark, root = records.sparkSession, log_path.rstrip("/")
    commits = read_optional(spark, f"{root}/commits", "value string", fmt="text")
    if commits.where(F.regexp_replace("value", r"\.[0-9a-f]{32}$", "") == f"b-{batch}").count():
        return False
    attempt = f"b-{batch}.{uuid.uuid4().hex}"
    records.write.parquet(f"{root}/data/attempt={attempt}")
    staged = f"{root}/staged/{attempt}"
    spark.createDataFrame([(attempt,)], "value string").coalesce(1).write.text(staged)
    name = [f for f in spark.read.text(staged).inputFiles() if "part-" in f][0]
    return move_new(spark, name, f"{root}/commits/{batch}.txt")


def read_log(spark: SparkSession, log_path: str, schema: StructType | str) -> DataFrame:
    """All committed records of a log; batches may differ in columns (missing: NULL)."""
    root = log_path.rstrip("/")
    commits = read_optional(spark, f"{root}/commits", "value string", fmt="text").select(F.col("value").alias("attempt"))
    try:
        data = spark.read.option("mergeSchema", True).option("basePath", f"{root}/data").parquet(f"{root}/data")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return data.withColumn("attempt", F.col("attempt").cast("string")).join(commits, "attempt", "left_semi").drop("attempt")
