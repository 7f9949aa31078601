"""Operators 11, 12 and 13 against brute force on awkward tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attrix.llm import licenses, license_texts, merkle, periodic, queries

from . import brute, edge


@pytest.fixture(scope="module")
def docs(spark):
    return edge.table(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture()
def over(monkeypatch):
    """Run a registered query on a given table."""
    def run(spark, name, df):
        monkeypatch.setattr(queries, "documents", lambda _spark, _dir: df)
        return queries.QUERIES[name](spark, "")
    return run


def sql_rows(name, pdf):
    con = duckdb.connect()
    con.register("documents", pdf)
    df = con.sql(queries.ORACLE_SQL[name])
    return df.columns, df.fetchall()


# -- 12 ---------------------------------------------------------------------------------------

def brute_runs(words, least=12):
    """(start, length, smallest period) of all runs, by trying every period at every start."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cases(rng):
    for n in (0, 1, 11, 12, 13, 40, 90, 200):
        for vocabulary in (1, 2, 3, 30):
            yield [str(rng.randrange(vocabulary)) for _ in range(n)]
    for _ in range(60):                                       # runs of many periods beside and inside each other
        out = []
        for _ in range(rng.randint(1, 5)):
            period = [str(rng.randrange(4)) for _ in range(rng.randint(1, 15))]
            out += (period * rng.randint(1, 9))[:rng.randint(1, 70)] + [str(rng.randrange(50)) for _ in range(rng.randint(0, 5))]
        yield out


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [" ".join(w).encode() for w in cases(rng)]
    found = list(periodic._of_slice(texts, 12))
    for text, (n, runs, kept) in zip(texts, found, strict=True):
        words = text.decode().split()
        assert n == len(words)
        assert runs == brute_runs(words), text
        assert kept.decode() == brute_collapsed(words, runs)
    assert sum(len(r) for _, r, _ in found) > 50


def test_runs_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(w).encode() for w in cases(rng)]
    whole = list(periodic._of_slice(texts, 12))
    monkeypatch.setattr(periodic, "PLACES", 7)
    assert list(periodic._of_slice(texts, 12)) == whole
    assert [x for t in texts for x in periodic._of_slice([t], 12)] == whole


def test_splitting_keeps_runs_only():
    words = np.array([0, 1] * 8 + [2, 3, 4] + [5, 6, 0] * 5 + [7])
    assert periodic.split_segments(words, np.array([0, len(words)])) == [(0, 16), (19, 34)]
    assert periodic.split_segments(np.zeros(0, int), np.array([0, 0, 0])) == []


def test_one_word_many_times():
    """A text of one word: every lag matches everywhere, one run is found, quickly."""
    n, runs, kept = next(periodic._of_slice([b"w " * 200_000], 12))
    assert (n, runs, kept) == (200_000, [(0, 200_000, 1)], b"w")


def test_periodic_runs(docs, plain, spark):
    got = [(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.kept_text) for r in periodic.periodic_runs(docs).collect()]
    want = []
    for d, t in plain:
        w = brute.words(t)
        runs = brute_runs(w) if len(w) < 3500 else None
        want.append((d, w, runs))
    assert len(got) == len(want)
    key = Counter((d, len(w), tuple(r), brute_collapsed(w, r)) for d, w, r in want if r is not None)
    assert key <= Counter(got)
    assert periodic.periodic_runs(edge.empty(spark)).count() == 0


def test_op12_equals_its_sql_on_awkward_rows(spark, docs, over):
    """The table's rows with ids of their own (the SQL joins by id): nulls, odd spaces, planted runs."""
    rows = docs.where("length(text) < 9000 or text is null").toPandas()[["text"]]
    rows = rows[[t is None or "\x00" not in t for t in rows.text]].reset_index(drop=True)
    rows["doc_id"] = np.arange(len(rows)) * 3
    df = spark.createDataFrame(rows[["doc_id", "text"]].astype(object).where(rows.notna(), None), "doc_id long, text string")
    got = over(spark, "op12_periodic_runs", df)
    columns, want = sql_rows("op12_periodic_runs", rows)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d in rows.doc_id)


# -- 11 ---------------------------------------------------------------------------------------

def brute_places(words):
    out = []
    for phrase, label in license_texts.PHRASES.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(words)) if words[i:i + len(p)] == p]
    return out


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t or ""))


def license_cases():
    rng = random.Random(2)
    body = {k: " ".join(v.split()) for k, v in license_texts.TEMPLATES.items()}
    texts = [None, "", "MIT License", "the mit license, mit  LICENSE mit-license mit", "cc by cc by-nc CC_BY ccby cc bý",
             "gnu gnu general public license general public license", "apache\nlicense apache license. Apache/LICENSE",
             "apache license gnu general public license mit license cc by"]
    for b in body.values():
        words = b.split()
        texts += [b, "x " + b.upper() + " y " + b, " ".join(words[: len(words) // 2])]
        cut = rng.randrange(len(words))
        texts.append(" ".join(words[:cut] + ["Someone", "Else"] + words[cut:]))
    vocabulary = sorted({w for b in body.values() for w in b.split()})
    for n in (5, 50, 400):
        texts += [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(5)]
    return texts


def test_license_places_equal_brute_force(spark, docs, plain):
    rows = [(i, t) for i, t in enumerate(license_cases())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for table, texts in ((df, rows), (docs, plain)):
        got = Counter((r.doc_id, r.n_words, tuple(sorted(tuple(p) for p in r.places))) for r in licenses.scan(table).collect())
        assert got == Counter((d, len(plain_words(t)), tuple(sorted(brute_places(plain_words(t))))) for d, t in texts)
    assert licenses.scan(edge.empty(spark)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(4)
    letters = [b"a", b"b", b"c"]
    sequences = [[rng.choice(letters) for _ in range(rng.randint(1, 14))] for _ in range(6)]
    a = licenses.Automaton(sequences)
    parts = defaultdict(set)
    for number, s in enumerate(sequences):
        for i, j in itertools.combinations(range(len(s) + 1), 2):
            parts[tuple(s[i:j])].add((number, j))
    for _ in range(40):
        words = [rng.choice([*letters, b"d"]) for _ in range(30)]
        found = {i: (v, n) for i, v, n in a.statistics(words)}
        for i in range(len(words)):
            n = max((k for k in range(1, i + 2) if tuple(words[i + 1 - k:i + 1]) in parts), default=0)
            assert found.get(i, (0, 0))[1] == n
            if n:
                assert set(a.ends[found[i][0]]) == parts[tuple(words[i + 1 - n:i + 1])]


def test_chains_equal_brute_force():
    """The best chain against trying all subsets of matches."""
    rng = random.Random(9)
    for _ in range(60):
        matches = sorted({(rng.randrange(60), rng.randrange(40), rng.randint(5, 9)) for _ in range(7)})
        best = 0
        for size in range(1, len(matches) + 1):
            for picked in itertools.combinations(matches, size):
                total = picked[0][2]
                for (f, t, n), (g, u, m) in zip(picked, picked[1:]):
                    if not (f < g and t < u and f + n < g + m and t + n < u + m and g - f - n <= 20 and u - t - n <= 20):
                        break
                    total += m - max(0, f + n - g, t + n - u)
                else:
                    best = max(best, total)
        assert licenses._chain(matches)[0] == best


def test_license_labels(spark, over):
    body = {k: " ".join(v.split()) for k, v in license_texts.TEMPLATES.items()}
    gap = body["mit-text"].replace("substantial portions", "substantial and large portions")
    rows = [(1, body["mit-text"]), (2, "x " * 50 + gap + " y" * 50), (3, body["mit-text"][:200]), (4, None), (5, "released under the MIT License"),
            (6, body["gpl-notice"] + " " + body["bsd-text"]), (7, "the software is provided as is " * 300)]
    out = {r.doc_id: r for r in over(spark, "op11_license_scan",
                                     spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].labels == out[2].labels == "mit-text" and out[1].score == 1.0 and 0.95 < out[2].score <= 1.0
    assert out[3].labels == "" and 0 < out[3].score < 0.8
    assert (out[4].n_words, out[4].n_base, out[4].first_word, out[4].labels, out[4].score) == (0, 0, None, "", 0.0)
    assert out[5].base_labels == "mit" and out[5].labels == "mit,mit-line" and out[5].first_word == 3
    assert out[6].labels == "bsd-text,gpl,gpl-notice" and out[6].n_base == 3
    assert out[7].labels == ""
    spans = licenses.scan(spark.createDataFrame([(1, "a b " + gap + " c " + body["mit-text"])], "doc_id long, text string")).first().spans
    assert [(s.label, s.start) for s in spans] == [("mit-text", 2), ("mit-text", 2 + len(plain_words(gap)) + 1)]


# -- 13 ---------------------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def brute_tree(leaves):
    """(top, [(siblings and sides) of each leaf])."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append((None, "-") if j >= len(level) else (level[j], "L" if j < i else "R"))
            at[k] = i >> 1
        level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute_manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, path) of (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0), brute_leaf(*r), r[0]))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [brute_tree([leaf for _, leaf, _ in sorted(groups[x])]) for x in langs]
    root, above = brute_tree([t[0] for t in trees])
    return Counter((d, leaf, top, root, tuple(own + up)) for x, (top, paths), up in zip(langs, trees, above, strict=True)
                   for (_, leaf, d), own in zip(sorted(groups[x]), paths, strict=True))


def manifest_rows(df):
    leaf = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return df.select("doc_id", "lang", leaf.alias("leaf"))


@pytest.mark.parametrize("span", [1, 2, 8])
def test_manifest_equals_brute_force(spark, docs, span):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = Counter((r.order, r.digest, r.subroot, r.root, tuple((s.digest, s.side) for s in r.path))
                  for r in merkle.manifest(manifest_rows(docs), span=span).collect())
    assert got == brute_manifest(rows)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 1, 1], [3], [5, 16, 17, 1, 33], [1] * 9, [300]])
def test_manifest_of_trees_of_many_sizes(spark, sizes):
    rows = [(i, "s", f"l{k}" if k else None, i if i % 5 else None, f"text {i}") for k, n in enumerate(sizes)
            for i in range(1000 * k, 1000 * k + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    found = merkle.manifest(manifest_rows(df), span=2)
    got = Counter((r.order, r.digest, r.subroot, r.root, tuple((s.digest, s.side) for s in r.path)) for r in found.collect())
    assert got == brute_manifest(rows)
    proved = found.select((merkle.folded(F.col("digest"), F.col("path")) == F.col("root")).alias("ok"),
                          (merkle.folded(F.sha2(F.col("digest"), 256), F.col("path")) == F.col("root")).alias("bad")).collect()
    assert all(r.ok and not r.bad for r in proved)


def test_manifest_of_repeated_rows(spark):
    """A third of all rows and more are one row: each copy is a leaf with a place of its own."""
    rows = [(7, "s", "en", 1, "same")] * 200 + [(i, "s", "en", 1, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = Counter((r.order, r.digest, r.subroot, r.root, tuple((s.digest, s.side) for s in r.path))
                  for r in merkle.manifest(manifest_rows(df)).collect())
    assert got == brute_manifest(rows)


def test_manifest_keeps_few_levels(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    merkle.manifest(df, folder=f"file://{tmp_path}", span=4).count()
    kept = {p.name for p in (tmp_path / "trees").iterdir() if p.name.startswith("level-")}
    assert kept == {"level-0", "level-4", "level-8", "level-12"}
    assert spark.read.parquet(f"file://{tmp_path}/trees/level-4").count() == 19


def test_manifest_of_an_empty_table(spark, over):
    assert merkle.manifest(manifest_rows(edge.empty(spark))).count() == 0
    assert over(spark, "op13_merkle_manifest", edge.empty(spark)).count() == 0


def test_op13_equals_its_sql_on_awkward_rows(spark, docs, over):
    pdf = docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas().drop_duplicates()
    pdf = pdf[[t is None or "\x00" not in t for t in pdf.text]]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "doc_id long, text string, lang string, source string, n_chars long")
    pdf["doc_id"], pdf["n_chars"] = pdf.doc_id.astype("Int64"), pdf.n_chars.astype("Int64")
    columns, want = sql_rows("op13_merkle_manifest", pdf)
    got = [tuple(r) for r in over(spark, "op13_merkle_manifest", df).select(*columns).collect()]
    assert Counter(got) == Counter(want)
    verified = columns.index("verified")
    assert {r[verified] for r in got} == {True, False}
