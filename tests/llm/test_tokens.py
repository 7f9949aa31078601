"""Operators 3, 4, 6 and 9 against the tokenizer libraries."""

import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.llm import byte_bpe, packing, sentencepiece_bpe, token_counts, token_shards
from attrix.llm.common import tokenizer_path
from tests.conftest import SF_SMALL

from . import edge

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def random_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "the", "e", " ", "  ", "in", "é", "\n", "😀", "▁", "t", "h", "n", "0", "$$$", "-", "ation", "'s", "\t", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return edge.table(spark).cache()


@pytest.fixture(scope="module")
def real(spark):
    return [r[0] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


# ---- 3 ------------------------------------------------------------------------
def test_encoding_is_the_librarys(pieces, real):
    words = sentencepiece_bpe.WordCache(sentencepiece_bpe.PieceTable(PIECES))
    texts = random_texts(1500) + real + [t or "" for t in edge.texts()] + ["a" * 999, "the" * 99, " " * 333 + "x"]
    for t, ids in zip(texts, words.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == pieces.encode(t)
        assert words.table.decode(ids) == pieces.decode(ids.tolist())


def test_words_that_need_the_exact_queue():
    """Merging all occurrences at once must equal the queue, word by word."""
    table = sentencepiece_bpe.PieceTable(PIECES)
    rng = random.Random(4)
    words = [" " * rng.randint(0, 9) + "".join(rng.choice("theinoat$") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    words = [w for w in words if w]
    for w, ids in zip(words, table.encode_words(words), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == table.merge_in_order(w.replace(" ", "▁"))


def test_decoding_stray_bytes(pieces):
    table = sentencepiece_bpe.PieceTable(PIECES)
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.randint(259, 31999) if rng.random() < .4 else rng.randint(3, 258) for _ in range(20)]
        ids[0] = 264
        assert table.decode(np.array(ids)) == pieces.decode(ids)


def test_encode_decode_table(spark, docs, pieces):
    out = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs))
    got = Counter((r[0], tuple(r[1]), r[2]) for r in out.collect())
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        ids = pieces.encode(t or "")
        want[d, tuple(ids), pieces.decode(ids)] += 1
    assert got == want
    assert sentencepiece_bpe.decode(sentencepiece_bpe.encode(edge.empty(spark))).count() == 0


# ---- 9 ------------------------------------------------------------------------
def unigram(pieces):
    """The library's unigram model over the same pieces and scores."""
    from tokenizers import Tokenizer, models, normalizers
    scores = token_counts.unigram_scores(PIECES)
    least = min(scores.values())
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    model = Tokenizer(models.Unigram([(p, scores.get(p, least)) for p in names], unk_id=0, byte_fallback=True))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return model


def test_counts_are_the_librarys(pieces, real):
    model, count = unigram(pieces), token_counts.counter(PIECES)
    for t in random_texts(1500, 2) + real[:100] + [t or "" for t in edge.texts()]:
        assert count.text(t)[0] == len(model.encode(t, add_special_tokens=False).ids)


def test_best_path_and_ties():
    """Small vocabulary with ties, against all segmentations: of equal scores the
    path whose last piece is longest, from the end backwards."""
    vocab = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "▁a": -2.0, "aba": -3.0, "bb": -1.5}
    counter = token_counts.UnigramCounter(vocab)

    def best(w):
        if not w:
            return 0, 0.0
        found = None
        for start in range(len(w)):             # ascending start: a later one must be strictly better
            if w[start:] in vocab:
                n, s = best(w[:start])
                if found is None or s + vocab[w[start:]] > found[1]:
                    found = (n + 1, s + vocab[w[start:]])
        return found

    rng = random.Random(1)
    for _ in range(300):
        w = "▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        assert counter.best(w) == best(w)


def test_count_table(spark, docs, pieces):
    model = unigram(pieces)
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs).select("doc_id", "n_tokens").collect())
    want = Counter((d, len(model.encode(t, add_special_tokens=False).ids) if t else 0)
                   for d, t in docs.select("doc_id", "text").collect())
    assert got == want
    assert token_counts.count_tokens(edge.empty(spark)).count() == 0


# ---- byte-level ids, 4, 6 --------------------------------------------------------
def test_byte_ids_are_the_tokenizers(tokenizer, real):
    encoder = byte_bpe.encoder(BYTES)
    for t in random_texts(1500, 3) + real[:100] + ["x<|endoftext|> y", "<|endoftext|>", "", "\xa0 x   y"]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\u3000", " \r\n\t"])
def test_byte_ids_of_a_long_run_of_white_space(tokenizer, space):
    """A million characters and more in a row, at the end and between words."""
    run = space * (1_200_000 // len(space))
    for t in (run, f"before{run}behind it"):
        got = np.frombuffer(byte_bpe.encoder(BYTES).encode(t), "<u4").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids


def check_pieces(rows, want: dict, window: int) -> int:
    """Every id in exactly one piece, sequences gapless and not too long; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc_id, start, length, ids, total, sequence, offset in rows:
        assert len(ids) == 4 * length and length > 0
        by_doc[doc_id].append((start, ids, total))
        by_sequence[sequence].append((offset, length))
    padding = 0
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    for doc_id, copies in want.items():
        parts = sorted(by_doc[doc_id])
        assert sum(len(p[1]) // 4 for p in parts) == sum(map(len, copies))
        if len(copies) == 1:
            ids = np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist()
            assert ids == copies[0] and {p[2] for p in parts} == {len(ids)}
            assert [p[0] for p in parts] == np.cumsum([0] + [len(p[1]) // 4 for p in parts])[:-1].tolist()
    return padding


def test_packing(spark, docs, tokenizer):
    want = defaultdict(list)
    for d, t in docs.select("doc_id", "text").collect():
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    rows = packing.pack(docs).collect()
    assert set(r[0] for r in rows) == set(want)
    padding = check_pieces(rows, want, 1024)
    assert padding == 0
    assert packing.pack(edge.empty(spark)).count() == 0


def test_packing_rule():
    """The level array follows the sum-of-squares rule, step by step."""
    rng = random.Random(6)
    window = 16
    packer = packing.SumOfSquaresPacker(window)
    count = [0] * (window + 1)
    for i in range(600):
        size = rng.randint(1, 15)
        best = None
        for level in [0] + [g for g in range(1, window - size + 1) if count[g]]:
            after = count.copy()
            if level:
                after[level] -= 1
            if level + size < window:
                after[level + size] += 1
            cost = sum(c * c for c in after[1:window])
            if best is None or cost < best:
                best = cost
        packer.add(i, b"\1\0\0\0" * size)
        count = packer.count.tolist()
        assert sum(c * c for c in count[1:window]) == best and count[0] == count[window] == 0
        assert [len(x) for x in packer.open] == count
    packer.finish()
    fill = defaultdict(int)
    for _, _, n, _, _, s, _ in packer.done:
        fill[s] += n
    assert sum(1 for v in fill.values() if v < window) <= 5


def test_open_windows_are_bounded():
    """Pieces that never add up to a window: most are written before the end, none is lost, nothing is padded."""
    packer = packing.SumOfSquaresPacker()
    for i in range(9000):
        packer.add(i, b"\1\0\0\0" * 700)
        assert packer.n_open == sum(map(len, packer.open)) <= packing.OPEN
        assert [len(x) for x in packer.open] == packer.count.tolist()
    assert sum(n for _, _, n, *_ in packer.done) > 6000 * 700
    packer.finish()
    pieces, fill = defaultdict(list), defaultdict(int)
    for doc, start, n, ids, total, sequence, offset in packer.done:
        assert offset == fill[sequence] and len(ids) == 4 * n and total == 700
        pieces[doc].append((start, n))
        fill[sequence] += n
    for doc in range(9000):
        at = 0
        for start, n in sorted(pieces[doc]):
            assert start == at
            at += n
        assert at == 700
    assert all(v == 1024 or v & (v - 1) == 0 for v in fill.values())


def test_permutation():
    for n in (1, 2, 3, 10, 64, 1000, 4097):
        p = token_shards.permuted(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
    a, b = (token_shards.permuted(np.arange(5000), 5000, k) for k in (1, 2))
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


@pytest.mark.parametrize("per_shard", [3, 4096])
def test_shards(spark, docs, tokenizer, per_shard):
    folder = "file://" + tempfile.mkdtemp(prefix="attrix-shards-") + "/x"
    index = token_shards.write_shards(docs, folder, length=64, shard_sequences=per_shard).orderBy("slot").collect()
    got = list(token_shards.read_sequences(folder, 0, len(index), 64, shard_sequences=per_shard))
    assert [r["slot"] for r in index] == list(range(len(index)))
    assert [r["byte_offset"] for r in index] == [r["slot"] % per_shard * 128 for r in index]
    assert [r["crc32"] for r in index] == [zlib.crc32(x.tobytes()) for x in got]
    resumed = list(token_shards.read_sequences(folder, 5, 4, 64, shard_sequences=per_shard))
    assert [x.tolist() for x in resumed] == [x.tolist() for x in got[5:9]]
    # the sequences of a part, in order, are its documents' ids one after another
    ids = Counter()
    for r, x in zip(index, got, strict=True):
        ids.update(x[:r["n_tokens"]].tolist())
        assert (x[r["n_tokens"]:] == token_shards.END_ID).all()
    want, seen = Counter(), Counter()
    for d, t in docs.select("doc_id", "text").collect():
        want.update(tokenizer.encode(t or "", add_special_tokens=False).ids + [token_shards.END_ID])
        seen[d] += 1
    assert ids == want
    held = {d for r in index for d in r["doc_ids"]}
    assert held == set(seen)


def test_shards_of_an_empty_table(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="attrix-shards-") + "/x"
    assert token_shards.write_shards(edge.empty(spark), folder).count() == 0


def test_query_columns(spark):
    from attrix.llm import queries
    got = queries.QUERIES["op4_packing"](spark, SF_SMALL)
    assert got.agg(F.sum("length")).first()[0] == got.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
