"""Helpers shared by the training-data operators.

Row handling used by all of them: input columns are picked by name under
internal aliases first, so extra columns (whatever their names) never clash;
a NULL text is the empty text; rows are addressed by ``(doc_id, text)``, so
repeated rows stay repeated rows of the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.io import read_table

# FIXED VALUES: the ASCII white space of the contracts, [\x20\x09-\x0D]
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text bytes handled at once inside a task; bounds a worker's memory.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (spark.checkpoint.dir)."""
    folder = shared_path(spark)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def picked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and non-null ``text`` of any table."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else kept (``lower`` where all is ASCII)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def replaced(columns: list[tuple[str, str]], source: str, text: Column, text_col: str = "text") -> list[Column]:
    """The named and typed columns of struct ``source`` with the text (and its ``n_chars``) replaced."""
    out = []
    for c, kind in columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.char_length(text).cast(kind).alias(c))
        else:
            out.append(F.col(f"{source}.`{c}`").alias(c))
    return out


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes."""
    start, held = 0, 0
    for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
