"""Corpus preparation: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, with the text (and ``n_chars``) as the stage
leaves it.  ``run`` writes every stage's result to the shared checkpoint folder
and reads it again, which cuts the lineage: a lost executor costs a stage's
tasks, not the stages before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import language_id, line_dedup, packing, simhash, substring_dedup
from attrix.llm.common import documents, replaced, shared_folder


#: A score below this many times chance (1 / number of languages) is no decision.
UNDECIDED = 1.01


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose language can't be told go.  These are texts without
    a letter, and texts of at least one whole window of the network between whose
    languages it does not decide: the score is below ``UNDECIDED`` times chance.
    Shorter texts are kept whatever their score, and where no row has a label to learn
    from, every text with a letter is."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs, model)
    undecided = (F.col("score") < UNDECIDED / len(model.languages)) & (F.char_length("row.text") >= language_id.WINDOW)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (~undecided | F.lit(len(model.languages) < 2))).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines that documents of larger id repeat go."""
    kept = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    return kept.select(*replaced(docs.dtypes, "row", text))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each near-duplicate group stays, as it is."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: words of passages that documents of smaller id hold go; a
    text that loses none keeps its white space."""
    cut = substring_dedup.dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    row = cut.select(F.struct(*[F.col("doc_id" if c == "doc_id" else f"rest.`{c}`").alias(c)
                                for c in docs.columns if c != "text"]).alias("row"), text.alias("kept"))
    return row.select(*replaced(docs.dtypes, "row", F.col("kept")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all documents in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Tokens, a trained classifier and XXH64 have no SQL form; the tests hold
#: ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
