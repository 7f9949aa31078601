"""Line deduplication with DataFrame functions only.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys long enough and held by enough documents lose all their lines except in
the document with the largest id.

1. Lines become rows (128-bit key hash, document, position): no text is moved.
2. They are dealt by ranges: the hash space is cut into equal ranges (hashes are
   uniform, so no sampling pass is needed), each cut again by document, so that a
   hash that a third of all lines share spreads over many tasks.  Inside, rows are
   sorted by hash, document (descending) and position, and streaming over them
   makes one row per (hash, document).
3. Per hash, the first occurrence (largest document) and the number of
   documents: partial sums in each range leave one row per hash and range.
4. Hashes with enough documents meet the (hash, document) rows again; the rows
   that aren't the first occurrence are dropped.  This join's hot keys are
   split by adaptive execution, as the verdict side has one row per hash.
5. Per document, the dropped positions become a compressed bitmap: words of 64
   lines, only those that drop any.  The text is touched again only by
   ``kept_text``.

Defined cases: NULL or empty text is one empty line.  Documents are counted by
``doc_id``: rows of equal id are one document, and so are rows without an id;
rows that share the largest id all keep their lines.  A NULL ``doc_id`` ranks
below every id.  Rows with equal id and text have equal
bitmaps.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, picked

MIN_CHARS = 20
MIN_DOCS = 3
#: the hash space has 2^RANGE_BITS ranges, each with as many parts by document
RANGE_BITS = 14


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash`` (the document) and ``dropped``: array of (word,
    bits), bit i of word w set when line 64 w + i goes.  Documents that lose
    nothing have no row."""
    lines = (picked(docs, id_col, text_col)
             .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
             .where(F.char_length("line") >= min_chars)
             .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
             .where(F.char_length("key") >= min_chars)
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                     "doc_id", "text_hash", "pos"))
    order = ["h1", "h2", F.desc("doc_id"), "text_hash", "pos"]
    ranges = lines.withColumn("range", F.shiftright("h1", 64 - RANGE_BITS)) \
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(1 << RANGE_BITS)))
    held = (ranges.repartition("range", "part")
            .sortWithinPartitions(*order)
            .groupBy("range", "part", "h1", "h2", "doc_id")
            .agg(F.collect_list(F.struct("text_hash", "pos")).alias("at"))
            .drop("range", "part")
            .checkpoint())      # read twice below; the lines are split and hashed once
    first = (held.groupBy("h1", "h2")
             .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
             .where((F.col("n_docs") >= min_docs) & F.col("keeper").isNotNull())
             # computed keys, so that the join below shuffles both of its sides itself: only
             # then does adaptive execution split a hash that very many documents hold
             .select(*[F.col(h).bitwiseXOR(F.lit(0).cast("long")).alias(h) for h in ("h1", "h2")], "keeper"))
    gone = (held.join(first, ["h1", "h2"])
            .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
            .select("doc_id", F.inline("at")))
    words = (gone.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))")).alias("bits")))
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dropped_positions(dropped: Column) -> Column:
    """Positions (from 0, ascending) of a bitmap's set bits."""
    return F.flatten(F.transform(dropped, lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)),
                    lambda b: F.when(F.getbit(w["bits"], b) == 1, w["word"] * 64 + b)),
        lambda p: p.isNotNull())))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """Lines that a bitmap keeps, in order; all of them where it is NULL."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped_positions(dropped))
    return F.when(dropped.isNull(), lines).otherwise(F.transform(kept, lambda i: F.get(lines, i)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (as struct ``row``) with ``n_lines``,
    ``n_dropped``, the bitmap ``dropped`` and ``kept_text``."""
    marks = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).alias("m")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                        docs[id_col].cast("long").alias("doc_id"),
                        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    whole = whole.withColumn("text_hash", F.xxhash64("text")).alias("d")
    joined = whole.join(marks, F.expr("d.doc_id <=> m.doc_id and d.text_hash = m.text_hash"), "left")
    text, dropped = F.col("d.text"), F.col("m.dropped")
    n_dropped = F.coalesce(F.aggregate(dropped, F.lit(0), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0))
    return joined.select(
        "row", F.col("d.doc_id").alias("doc_id"), F.size(lines_of(text)).cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"), dropped.alias("dropped"),
        F.when(dropped.isNull(), text).otherwise(F.array_join(kept_lines(lines_of(text), dropped), "\n")).alias("kept_text"))
