"""Token ids in training order: fixed-stride binary shards.

Documents (ids and one end id each) are cut into sequences of fixed length
within each input partition; only a partition's last sequence is padded.  The
sequences are written, compressed, to the shared folder, so that their numbers
are settled: partition by partition, 0 ... N-1.  A keyed Feistel permutation over
the next even number of bits, walked until it falls below N, gives each number
its global slot in the training order, without sorting or gathering anything.
Range partitions by slot then write the shards: every sequence takes the same
number of bytes, so slot s is at byte (s % shard_sequences) * stride of shard
s // shard_sequences.  A reader goes through them sequentially and resumes at
any slot by arithmetic alone.

A shard is written under a name of its attempt and renamed when complete, so a
lost or repeated task leaves whole shards only, with the same bytes.

Defined cases: NULL or empty text is the end id alone; an empty table makes no
shard; repeated rows are repeated.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import picked, text_slices, tokenizer_path

SEQUENCE = 1024
END_ID = 50256
SHARD_SEQUENCES = 4096
ROUNDS = 4
#: The payloads' compression dictionary is trained on the beginnings of at most
#: so many documents.  It bears on the size of what is moved, on no result.
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES = 1500, 8192, 1 << 18
LEVEL = 9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """Keyed permutation of 0 ... size-1: balanced Feistel rounds, walking the
    cycle of a number until it is below ``size`` again."""
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (2 ** 64 - 1)))
    out = np.asarray(numbers, np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        x = (left << shift) | right
        out[walk] = x
        walk = walk[x >= np.uint64(size)]
    return out.astype(np.int64)


class SequenceCutter:
    """Cuts one task's documents into sequences of ``length`` ids."""

    def __init__(self, length: int):
        self.length, self.held, self.size, self.ids = length, [], 0, []
        self.number = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            take = min(self.length - self.size, len(ids) - at)
            self.held.append(ids[at:at + take])
            self.ids.append(doc_id)
            self.size += take
            at += take
            if self.size == self.length:
                yield self.cut()

    def cut(self) -> tuple:
        out = (self.number, np.concatenate(self.held), self.ids)
        self.number, self.held, self.size, self.ids = self.number + 1, [], 0, []
        return out


def train_dictionary(docs: DataFrame, path: str | None = None, length: int = SEQUENCE,
                     id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Compression dictionary from a bounded sample; empty if that is too small."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    some = picked(docs, id_col, text_col).where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0) \
        .select(F.substring("text", 1, DICTIONARY_CHARS)).limit(DICTIONARY_DOCS).collect()
    encoder = byte_bpe.encoder(path)
    kind = _kind(encoder.tokenizer.get_vocab_size())
    ids = [np.frombuffer(encoder.encode(r[0]), "<u4").astype(kind) for r in some]
    samples = [x[i:i + length].tobytes() for x in ids for i in range(0, len(x), length)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def sequences(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text", dictionary: bytes = b"") -> DataFrame:
    """``part, number, n_tokens, doc_ids, payload``: sequences in the order of
    each partition; the payload is the padded ids, 16 bits each where they fit
    (else 32), compressed."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.encoder(path)
        part = TaskContext.get().partitionId()
        kind = _kind(encoder.tokenizer.get_vocab_size())
        pack = zstandard.ZstdCompressor(level=LEVEL, **_with(dictionary))
        cutter = SequenceCutter(length)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            padded = [np.concatenate([ids, np.full(length - len(ids), end_id)]).astype(kind).tobytes() for _, ids, _ in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part, np.int32)), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                 pa.array([pack.compress(p) for p in padded], pa.binary())],
                ["part", "number", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            for some in text_slices(batch):
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.append(np.frombuffer(encoder.encode(text), "<u4"), np.uint32(end_id))
                    rows += cutter.add(doc_id, ids)
                if rows:
                    yield batch_of(rows)
        if cutter.size:
            yield batch_of([cutter.cut()])

    return picked(docs, id_col, text_col).mapInArrow(
        run, "part int, number long, n_tokens int, doc_ids array<long>, payload binary")


def _with(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, folder: str, key: int = 1, path: str | None = None, length: int = SEQUENCE,
                 end_id: int = END_ID, shard_sequences: int = SHARD_SEQUENCES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of all documents under ``folder`` (a URI that all
    executors share) and return their index: one row per sequence with ``slot,
    sequence, shard, byte_offset, n_tokens, crc32, doc_ids``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, length, id_col, text_col)
    sequences(docs, path, length, end_id, id_col, text_col, dictionary).write.option("compression", "none") \
        .parquet(f"{folder}/sequences")
    cut = spark.read.parquet(f"{folder}/sequences")
    # one row for each input partition: how many sequences lie before it
    parts = cut.groupBy("part").agg((F.max("number") + 1).alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    size = parts.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), size, key))

    placed = (cut.join(F.broadcast(before), "part").withColumn("sequence", F.col("number") + F.col("before"))
              .withColumn("slot", slot_of("sequence"))
              .withColumn("shard", F.floor(F.col("slot") / shard_sequences).cast("int")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_with(dictionary))
        store, root = fs.FileSystem.from_uri(folder)
        open_shard, out, temporary = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/{shard_name(open_shard)}")

        for batch in batches:
            shards, offsets, crcs = batch.column("shard").to_pylist(), [], []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                ids = unpack.decompress(payload)
                if shards[i] != open_shard:
                    close()
                    open_shard, temporary = shards[i], f"{root}/{shard_name(shards[i])}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                offsets.append(out.tell())
                crcs.append(zlib.crc32(ids))
                out.write(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("slot", "sequence", "shard")] + [pa.array(offsets, pa.int64())]
                + [batch.column("n_tokens"), pa.array(crcs, pa.int64()), batch.column("doc_ids")],
                ["slot", "sequence", "shard", "byte_offset", "n_tokens", "crc32", "doc_ids"])
        close()

    (placed.select("slot", "sequence", "shard", "n_tokens", "doc_ids", "payload")
     .repartitionByRange("shard").sortWithinPartitions("slot")
     .mapInArrow(write, "slot long, sequence long, shard int, byte_offset long, n_tokens int, crc32 long, doc_ids array<long>")
     .write.parquet(f"{folder}/index"))
    return spark.read.parquet(f"{folder}/index")


def read_sequences(folder: str, start: int, count: int, length: int = SEQUENCE, kind: str = "<u2",
                   shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """Sequences of the slots ``start`` ... in training order, read one after
    another; a reader that stopped resumes with the next slot."""
    store, root = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(kind).itemsize
    slot, end = start, start + count
    while slot < end:
        shard, inside = divmod(slot, shard_sequences)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(inside * stride)
            while slot < end and slot // shard_sequences == shard:
                yield np.frombuffer(f.read(stride), kind)
                slot += 1
