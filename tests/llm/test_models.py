"""Operators 2, 7 and 10 and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attrix.llm import ann, fingerprints, language_id, queries
from attrix.llm.common import tokenizer_path
from tests.conftest import SF_MID, SF_SMALL

from . import brute, edge


@pytest.fixture(scope="module")
def docs(spark):
    return edge.table(spark, clashing=True).cache()


# ---- 2 ------------------------------------------------------------------------
def paragraphs(t):
    return set(re.split(fingerprints.PARAGRAPH_END, t))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_edited_versions(spark, docs):
    rows = sorted({(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()},
                  key=lambda r: (r[0] is None, -(r[0] or 0)))
    hashes = {r["text"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"))
              .withColumn("h", F.xxhash64("text")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    copies = Counter((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect())
    want = Counter()
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        e = t[:len(t) - k] + nxt[:k]
        want[d, len(t), e, round(jaccard(paragraphs(t), paragraphs(e)), 12),
             round(jaccard(paragraphs(t), paragraphs(nxt)), 12)] += copies[d, t]
    out = fingerprints.edited_versions(docs).collect()
    got = Counter((r["doc_id"], r["n_chars"], r["edited_text"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in out)
    assert got == want
    prints = defaultdict(set)
    for r in fingerprints.edited_versions(docs).collect():
        prints[r["fingerprint"]].add(r["n_chars"])
    assert len(prints) == len({frozenset(paragraphs(t)) for _, t in rows})


def test_texts_of_one_line_keep_their_likeness(spark):
    """Two thirds of an edited text are unchanged, also when it has no line feed."""
    t, o = (" ".join(f"{w} sentence number {i}{'.!?'[i % 3]}" for i in range(30)) for w in ("First", "Other"))
    sentences = lambda x: set(re.split(r"\n|(?<=[.!?]) ", x))
    df = spark.createDataFrame([(2, t), (1, o)], "doc_id long, text string")
    r = next(r for r in fingerprints.edited_versions(df).collect() if r["doc_id"] == 2)
    assert "\n" not in r["edited_text"] and r["near_next"] == 0
    assert r["near_edited"] == pytest.approx(jaccard(sentences(t), sentences(r["edited_text"]))) and r["near_edited"] > 0.4


def test_single_document_and_empty_table(spark):
    one = spark.createDataFrame([(4, "a\nb\nc")], "doc_id long, text string")
    r = fingerprints.edited_versions(one).first()
    assert (r["edited_text"], r["near_next"], r["n_chars"]) == ("a\nb\na", 1.0, 5)
    assert fingerprints.edited_versions(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("n_a,n_b,shared", [(0, 0, 0), (1, 1, 1), (3, 4, 2), (30, 20, 10), (900, 800, 700), (3000, 1, 0)])
def test_peeling_recovers_differences(spark, n_a, n_b, shared):
    rng = random.Random(n_a)
    common = [rng.getrandbits(64) - (1 << 63) for _ in range(shared)]
    only = lambda n: [rng.getrandbits(64) - (1 << 63) for _ in range(n - shared)]
    a, b = common + only(max(n_a, shared)), common + only(max(n_b, shared))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    found = fingerprints.with_difference(df, "d", "a", "b", fingerprints.retries_for(max(n_a, n_b))).first()["d"]
    assert found == len(set(a) ^ set(b))
    if len(set(a) ^ set(b)) < 6:
        peeled = df.select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))))
                           .alias("p")).first()["p"]
        assert peeled["ok"] and set(peeled["only_a"]) == set(a) - set(b) and set(peeled["only_b"]) == set(b) - set(a)


# ---- 7 ------------------------------------------------------------------------
def exact_nearest(ids, v, k=5):
    u = v / np.sqrt((v ** 2).sum(1))[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (v * v[i]).sum(1) / (np.sqrt((v ** 2).sum(1)) * np.sqrt((v[i] ** 2).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    del u
    return out


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact_nearest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64))
    got = defaultdict(list)
    for r in queries.QUERIES["op7_ann"](spark, SF_MID).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    scores = {(q, i): s for q, x in want.items() for i, s in x}
    assert all(abs(s - scores[q, i]) < 1e-12 for q, x in got.items() for i, s in x if (q, i) in scores)


def test_recall_over_shards_and_a_hot_vector(spark):
    """Several small shards; a third of all rows share one vector."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    v[rng.permutation(1500)[:500]] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    vectors = ann.usable(df, "vec_id", "embedding")
    got = defaultdict(list)
    index = ann.build_index(vectors, shard_rows=300).checkpoint()
    assert index.count() == 5
    for r in ann.search(index, vectors.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = exact_nearest(np.arange(1500), v)
    assert got[0] == [(i, pytest.approx(1.0)) for i, _ in want[0]]     # ties go to the smaller ids
    hits = sum(sum(s >= want[q][-1][1] - 1e-12 for _, s in got[q]) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [nan, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]),
            (None, [1.0, 2.0]), (100, [0.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, v int, shard int")
    vectors = ann.usable(df, "vec_id", "embedding")
    assert {r[0] for r in vectors.select("vec_id").collect()} == {0, 50, 7, 8}
    got = ann.search(ann.build_index(vectors), vectors.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [
        (0, 1, 7), (0, 2, 8), (0, 3, 50), (50, 1, 0), (50, 2, 7), (50, 3, 8)]
    none = vectors.where("vec_id < 0")
    assert ann.search(ann.build_index(none), none, 5).count() == 0


def test_vectors_of_extreme_size_and_odd_length(spark):
    """Finite vectors take part whatever their size; those of another length than the commonest don't."""
    rows = [(0, [1.0, 1.0]), (50, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [2.0, 1.0]), (3, [-1e308, 1e308]), (4, [5e-324, 0.0]),
            (5, [1.0]), (6, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = ann.build_index(df).checkpoint()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in
           ann.search(index, df.where("vec_id % 50 = 0"), k=5).collect()}
    assert {q for q, _ in got} == {0, 50} and len(got) == 10
    want = [(50, 1.0), (1, 3 / 10 ** 0.5), (2, 3 / 10 ** 0.5), (4, 0.5 ** 0.5), (3, 0.0)]
    assert sorted(got[0, i][0] for i in range(2, 4)) == [1, 2]
    assert [got[0, i][1] for i in range(1, 6)] == pytest.approx([s for _, s in want], abs=1e-12)
    assert got[50, 1][0] == 0 and got[50, 1][1] == pytest.approx(1.0)


# ---- 10 -----------------------------------------------------------------------
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    out = queries.QUERIES["op10_language_id"](spark, SF_MID).join(labels, "doc_id")
    r = out.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("acc"),
                                  F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r["n"] > 300 and r["acc"] > 0.97 and 0 <= r["lo"] <= r["hi"] <= 1


def test_predictions_on_awkward_rows(spark, docs):
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    out = language_id.predict(docs, model)
    assert out.count() == docs.count() and out.select("row.*").columns == docs.columns
    for r in out.select("row.text", "lang_pred", "score").collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and language_id.predict(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(edge.empty(spark), model).count() == 0
    assert language_id.fit(edge.empty(spark)) is None


def test_prediction_sees_the_whole_text():
    model = language_id.ByteCnn.new(["a", "b"])
    x, y = b"xyz " * 200, b"qqq " * 5000
    one, _ = model.predict([x + y])
    p = model.probabilities(language_id.windows_of(x + y))
    w = (language_id.windows_of(x + y) > 0).sum(1)
    assert one[0] == (p * w[:, None]).sum(0).argmax()


def test_gradient_and_pooling():
    """Training lowers the loss, and pooled values equal a direct convolution."""
    rng = np.random.default_rng(0)
    model = language_id.ByteCnn.new(["a", "b"])
    x = language_id.windows_of(bytes(rng.integers(97, 123, 512 * 3).astype(np.uint8)))
    pooled, _ = model.pooled(x, model.tables())
    direct = []
    for w in model.conv:
        y = sum(w[j][x[:, j:x.shape[1] - len(w) + 1 + j]] for j in range(len(w)))
        direct.append(y.max(1))
    assert np.allclose(pooled, np.concatenate(direct, 1) + model.bias, atol=1e-5)
    texts = [b"le la les des une " * 30, b"the of and that is " * 30]
    x = np.concatenate([language_id.windows_of(t)[:1] for t in texts * 20])
    model.train(x, np.array([0, 1] * 20), epochs=5)
    assert model.predict(texts)[0].tolist() == [0, 1]


# ---- pipeline -----------------------------------------------------------------
def test_pipeline_stages(spark, docs):
    """Every stage against brute force on its own input."""
    stages, have = dict(corpus_pipeline.STAGES), docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "substring_dedup", "packing"]
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    out = stages["language_id"](spark, have, "").checkpoint()
    assert Counter(rows(out)) == Counter(r for r in rows(have) if any(c.isalpha() for c in r[1] or ""))
    have, before = out, rows(out)
    out = stages["line_dedup"](spark, have, "").checkpoint()
    assert Counter(rows(out)) == Counter((d, x[2]) for (d, _), x in zip(before, brute.line_dedup(before), strict=True))
    have, before = out, rows(out)
    out = stages["simhash_near_dedup"](spark, have, "").checkpoint()
    comp = brute.components([brute.simhash(t) for _, t in before])
    assert len(rows(out)) == len(set(comp)) and set(rows(out)) <= set(before)
    have, before = out, rows(out)
    out = stages["substring_dedup"](spark, have, "").checkpoint()
    assert Counter(rows(out)) == Counter((d, x[2] if x[1] else t) for (d, t), x in
                                         zip(before, brute.substring_dedup(before), strict=True))
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert out.where("n_chars <> char_length(text)").count() == 0
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    n = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows(out))
    assert stages["packing"](spark, out, "").agg(F.sum("length")).first()[0] == n


def test_pipeline_keeps_documents_without_any_label(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "12 !", None), (3, None, None), (4, "语言", None)],
                                 "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_pipeline_rejects_long_undecided_texts_only(spark, monkeypatch):
    scores = {1: 0.251, 2: 0.254, 3: 0.251, 4: 0.99}
    docs = spark.createDataFrame([(1, "a" * 600, "x"), (2, "b" * 600, "y"), (3, "short", "z"), (4, "d" * 600, "w")],
                                 "doc_id long, text string, lang string")
    def predict(rows, model):
        found = F.create_map(*[F.lit(v) for kv in scores.items() for v in kv])[F.col("doc_id")]
        return rows.select(F.struct("*").alias("row"), F.lit("x").alias("lang_pred"), found.alias("score"))
    monkeypatch.setattr(corpus_pipeline.language_id, "predict", predict)
    assert sorted(r[0] for r in corpus_pipeline.identify_language(spark, docs, "").select("doc_id").collect()) == [2, 3, 4]


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_stages_on_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge.empty(spark), "").count() == 0, name


def test_op2_query(spark):
    out = queries.QUERIES["op2_fingerprints"](spark, SF_SMALL).toPandas()
    texts = sorted(((r[0], r[1]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    edited = {}
    for i, (d, t) in enumerate(texts):
        k = len(t) // 3
        edited[d] = hashlib.sha256((t[:len(t) - k] + texts[(i + 1) % len(texts)][1][:k]).encode()).hexdigest()
    assert dict(zip(out.doc_id, out.edited_sha256, strict=True)) == edited
