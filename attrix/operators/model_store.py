"""Versioned store of models and their result tables (ML-19, ML-20, SNK-3, SNK-5).

Layout under a root that driver and executors share:

    data/<attempt>/tables/<name>    Parquet
    data/<attempt>/models/<name>    Spark ML persistence
    manifests/v<version>.json       one line per table or model of the version

A publication writes all its files under an attempt of its own, counts what it wrote,
and then renames one manifest to the first free version number.  A writer that dies
leaves no manifest, so its files are never read; two writers at once get two versions.
Readers take a version's tables with the schema and the number of rows that the
manifest states, in any session.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import clean_feature_name, none_text_to_null, parse_int_tuple
from . import metrics as me

MANIFEST = "tag string, kind string, name string, path string, n_rows long, schema string"
_NAME = re.compile(r"[\w.-]+")


@dataclass
class Published:
    """One version: tables are read when used, models when asked for."""

    version: int
    tag: str
    tables: dict[str, DataFrame]
    model_paths: dict[str, str] = field(default_factory=dict)

    def model(self, name: str) -> PipelineModel:
        return PipelineModel.load(self.model_paths[name])


def _entries(spark: SparkSession, root: str) -> DataFrame:
    from ..sources.io import read_optional
    version = F.regexp_extract(F.col("file"), r"v(\d+)\.json$", 1).cast("long")
    files = read_optional(spark, f"{root}/manifests", MANIFEST, fmt="json")
    return files.withColumn("file", F.input_file_name()).withColumn("version", version).drop("file")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All that is published: (version, tag, kind, name, n_rows, path)."""
    return _entries(spark, root.rstrip("/")).select("version", "tag", "kind", "name", "n_rows", "path")


def latest(spark: SparkSession, root: str, tag: str | None = None) -> int | None:
    """Newest version, of those with ``tag`` if one is given; None without any."""
    found = _entries(spark, root.rstrip("/"))
    if tag is not None:
        found = found.where(F.col("tag") == tag)
    return found.agg(F.max("version")).first()[0]


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame],
            models: Mapping[str, PipelineModel] | None = None, tag: str = "") -> int:
    """Write tables and models as one new version and return its number."""
    from ..sources.io import move_new, write_table
    root, attempt = root.rstrip("/"), uuid.uuid4().hex
    models = models or {}
    bad = [n for n in [*tables, *models] if not _NAME.fullmatch(n)]
    if bad or not (tables or models):
        raise ValueError(f"names have letters, digits, dots and dashes only, and there is one at least: {bad}")
    rows = []
    for name, df in tables.items():
        path = write_table(df, f"{root}/data/{attempt}/tables/{name}", mode="errorifexists")
        n_rows = spark.read.schema(df.schema).parquet(path).count()
        rows.append((tag, "table", name, path, n_rows, df.schema.json()))
    for name, model in models.items():
        path = f"{root}/data/{attempt}/models/{name}"
        model.write().save(path)
        rows.append((tag, "model", name, path, None, None))
    staged = f"{root}/staged/{attempt}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(staged)
    part = [f for f in spark.read.schema(MANIFEST).json(staged).inputFiles() if "part-" in f][0]
    version = (latest(spark, root) or 0) + 1
    while not move_new(spark, part, f"{root}/manifests/v{version:08d}.json"):
        version += 1
    return version


def load(spark: SparkSession, root: str, version: int | None = None, tag: str | None = None,
         verify: bool = False) -> Published:
    """A version (the newest, or the newest with ``tag``, if none is named); a version that
    isn't there raises.  ``verify`` counts the rows again and raises where files are missing."""
    root = root.rstrip("/")
    version = latest(spark, root, tag) if version is None else version
    rows = _entries(spark, root).where(F.col("version") == F.lit(version)).collect()   # a row per table and model
    if not rows:
        raise FileNotFoundError(f"nothing is published under {root} as version {version}, tag {tag}")
    tables = {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(r["path"])
              for r in rows if r["kind"] == "table"}
    if verify:
        for r in rows:
            if r["kind"] == "table" and tables[r["name"]].count() != r["n_rows"]:
                raise ValueError(f"table {r['name']} of version {version} has not the {r['n_rows']} rows of its manifest")
    return Published(version, rows[0]["tag"], tables, {r["name"]: r["path"] for r in rows if r["kind"] == "model"})


# -- JOB-6 as a version: tables, refitted models, weights ----------------------------------------

def feature_weights(models: Mapping[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """ML-17 / ML-18 for several models: (model, kind, feature, feature_clean, value), where
    kind is 'coefficients' or 'importance'.  Models without either have no rows.  ``rows``
    gives the input columns only; it isn't read."""
    from .ml import feature_names
    out = []
    for name, model in models.items():
        last = model.stages[-1]
        for kind, attribute in (("coefficients", "coefficients"), ("importance", "featureImportances")):
            if hasattr(last, attribute):
                slots = feature_names(model.transform(rows.limit(0)))
                out += [(name, kind, s, float(v)) for s, v in zip(slots, getattr(last, attribute).toArray(), strict=True)]
    df = rows.sparkSession.createDataFrame(out, "model string, kind string, feature string, value double")
    return df.select("model", "kind", "feature", clean_feature_name("feature").alias("feature_clean"), "value")


COMPARISON_TABLES = ("comparison", "comparison_long", "auc_summary", "roc_points", "best_params", "predictions")


def comparison_parts(out: Mapping[str, Any]) -> tuple[dict[str, DataFrame], dict[str, PipelineModel]]:
    """Tables and refitted models of :func:`.ml.model_comparison`, as :func:`publish` takes them."""
    tables = {name: out[name] for name in COMPARISON_TABLES}
    tables["weights"] = feature_weights(out["models"], out["data"])
    return tables, {family.replace(" ", "_"): model for family, model in out["models"].items()}


def select_published(published: Published, model: str) -> dict[str, Any]:
    """ML-20 from what was written: one model's metrics, predictions, confusion matrix (% by
    row), what explains it (kind and weights; 'none' without weights) and the fitted model, if
    it is in the version.  A model without metrics raises."""
    mine = {n: published.tables[n].where(F.col("model") == model) for n in ("comparison", "predictions")}
    if mine["comparison"].isEmpty():
        raise ValueError(f"version {published.version} has no model named {model}")
    chosen: dict[str, Any] = {"metrics": mine["comparison"], "predictions": mine["predictions"],
                              "confusion": me.confusion_matrix(mine["predictions"], normalize=True),
                              "kind": "none", "weights": None, "model": None}
    if "weights" in published.tables:
        weights = published.tables["weights"].where(F.col("model") == model)
        first = weights.first()
        if first is not None:
            chosen |= {"kind": first["kind"], "weights": weights.orderBy(F.abs("value").desc(), "feature")}
    if model.replace(" ", "_") in published.model_paths:
        chosen["model"] = published.model(model.replace(" ", "_"))
    return chosen


# -- ML-19: best parameters, exported and read back with types -------------------------------------

# FIXED VALUES: prefixes and names of the original's export, and its parameters when there is none
EXPORT_PREFIXES = ("classifier__model__", "classifier__")
EXPORT_NAMES = {"solver": "solver", "class_weight": "class_weight", "C": "C", "n_estimators": "n_estimators",
                "min_samples_split": "min_samples_split", "min_samples_leaf": "min_samples_leaf",
                "max_features": "max_features", "max_depth": "max_depth", "learning_rate": "model__learning_rate",
                "hidden": "model__hidden_units", "dropout_rate": "model__dropout_rate", "epochs": "epochs",
                "batch_size": "batch_size"}
FALLBACK_FOREST = {"n_estimators": 200, "max_depth": None, "min_samples_split": 5, "min_samples_leaf": 2,
                   "max_features": "sqrt", "class_weight": None}

PARAM_TYPES = {"solver": "string", "class_weight": "string", "C": "double", "n_estimators": "int", "min_samples_split": "int",
               "min_samples_leaf": "int", "max_features": "string", "max_depth": "int", "learning_rate": "double",
               "hidden": "array<int>", "dropout_rate": "double", "epochs": "int", "batch_size": "int"}


def _typed(text: Column, name: str, kind: str) -> Column:
    """Text of a parameter as its type.  'None', 'nan' and blank are NULL; '12.0' is the
    integer 12; text that isn't of the type raises instead of becoming NULL."""
    text = none_text_to_null(text)
    if kind == "string":
        return text
    if kind == "array<int>":
        numbers = parse_int_tuple(text)
        good, value = F.size(numbers) > 0, numbers
    else:
        number = text.try_cast("double")
        good = number.isNotNull() if kind == "double" else number.isNotNull() & (number == F.floor(number))
        value = number.cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"parameter {name} is no {kind}: "), text))
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(good, value).otherwise(wrong.cast(kind))


def params_wide(params: DataFrame) -> DataFrame:
    """(model, param, value) -> one row per model with a text column per parameter, named as
    in the export; a parameter that a model hasn't is NULL."""
    cells = [F.max(F.when(F.col("param") == p, F.col("value"))).alias(f"classifier__{n}") for p, n in EXPORT_NAMES.items()]
    return params.groupBy("model").agg(*cells)


def export_params(params: DataFrame, path: str) -> str:
    """SNK-5: the wide table as CSV with header, one row per model."""
    from ..sources.io import write_table
    return write_table(params_wide(params), path, fmt="csv")


def typed_params(wide: DataFrame) -> DataFrame:
    """An export, its columns as text: one row per model, typed columns.  Prefixes go; a
    parameter without a column is NULL; columns that are no parameter are left out."""
    plain = {}
    for c in wide.columns:
        short = c
        for prefix in EXPORT_PREFIXES:
            short = short.removeprefix(prefix)
        plain["hidden" if short == "hidden_units" else short] = c
    return wide.select("model", *[
        (_typed(F.col(f"`{plain[p]}`").cast("string"), p, t) if p in plain else F.lit(None).cast(t)).alias(p)
        for p, t in PARAM_TYPES.items()])


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """ML-19: the exported CSV read back with types."""
    return typed_params(spark.read.option("header", True).csv(path))


def chosen_params(typed: DataFrame, model: str, names: Sequence[str],
                  fallback: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """One model's parameters as arguments of :func:`.ml.classifier`.  Without a row the
    fallback is taken, or it raises if there is none; two rows raise."""
    rows = typed.where(F.col("model") == model).limit(2).collect()
    if len(rows) > 1:
        raise ValueError(f"several rows of parameters for {model}")
    if not rows:
        if fallback is None:
            raise ValueError(f"no parameters for {model}")
        return dict(fallback)
    return {n: tuple(rows[0][n]) if isinstance(rows[0][n], list) else rows[0][n] for n in names}
