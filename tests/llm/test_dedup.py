"""Operators 1, 5 and 8 against brute force on awkward tables."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from attrix.llm import components, line_dedup, queries, simhash, substring_dedup
from tests.conftest import SF_SMALL

from . import brute, edge


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return edge.table(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return rows_of(docs, "doc_id", "text")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(rows_of(df, *want.columns)) == Counter(want.fetchall())


def test_line_dedup(docs, plain):
    got = rows_of(line_dedup.dedup_lines(docs), "row.doc_id", "row.text", "n_lines", "n_dropped", "kept_text")
    want = [(d, t, *x) for (d, t), x in zip(plain, brute.line_dedup(plain), strict=True)]
    assert Counter(got) == Counter(want)
    assert any(x[3] for x in want)


def test_line_bitmaps(docs, plain):
    """The bitmap alone restores the dropped positions; rows that keep everything have none."""
    marks = line_dedup.keep_bitmaps(docs)
    got = rows_of(marks.select("doc_id", line_dedup.dropped_positions(F.col("dropped")).alias("p")), "doc_id", "p")
    want = {d: x[1] for (d, _), x in zip(plain, brute.line_dedup(plain), strict=True) if x[1]}
    assert {d: len(p) for d, p in got} == want
    assert all(p == sorted(set(p)) for _, p in got)


def test_line_dedup_ties_and_null_ids(spark):
    line = "exactly the same line of text"
    same = [(5, line), (5, line), (5, line)]
    null = [(None, line), (None, line), (None, line)]
    other = [(5, line + "\nx"), (5, line + "\ny")]             # one document in two versions
    for rows, dropped in ((same, 0), (null, 0), (same + [(None, line), (4, line + "  ")], 2), ([(1, line), (2, line)], 0),
                          (same[:2] + [(4, line)], 0), (other + [(4, line)], 0), (other + [(4, line), (3, line)], 2),
                          (other + [(4, line), (4, line + " ")], 0), (same + null + [(4, line)], 4)):
        assert sum(x[1] for x in brute.line_dedup(rows)) == dropped
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar)")
        con.executemany("insert into documents values (?, ?)", rows)
        assert sum(r[2] for r in con.sql(queries.ORACLE_SQL["op1_line_dedup"]).fetchall()) == dropped
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sum(r[0] for r in rows_of(line_dedup.dedup_lines(df), "n_dropped")) == dropped


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(edge.empty(spark)).count() == 0


def test_line_dedup_of_a_hot_line(spark):
    """A line that a third of all rows hold, and a document with thousands of lines."""
    line = "a very common line of every document"
    rows = [(i, f"{line}\nown line of document number {i}" if i % 3 == 0 else f"other text of document number {i}")
            for i in range(900)] + [(10_000, "\n".join([line] + [f"line number {i} of the long one" for i in range(4000)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(rows_of(line_dedup.dedup_lines(df), "doc_id", "n_dropped"))
    assert sum(got.values()) == 300 and got[10_000] == 0


def test_substring_dedup(docs, plain):
    cut = substring_dedup.dedup_substrings(docs, block_bytes=2000)
    got = rows_of(cut, "doc_id", "text", "n_words", "n_removed", "kept_text")
    want = [(d, t or "", *x) for (d, t), x in zip(plain, brute.substring_dedup(plain), strict=True)]
    assert Counter(got) == Counter(want)
    assert any(0 < x[3] < x[2] for x in want)
    assert cut.select("rest.*").columns[1:] == [c for c in docs.columns if c not in ("doc_id", "text")]


def test_substring_spans(docs):
    for text, n, spans, kept in rows_of(substring_dedup.dedup_substrings(docs), "text", "n_removed", "spans", "kept_text"):
        w, left, at = brute.words(text), [], 0
        for s in spans:
            assert s["end"] - s["start"] >= 13 and s["start"] >= at
            left += w[at:s["start"]]
            at = s["end"]
        assert " ".join(left + w[at:]) == kept and sum(s["end"] - s["start"] for s in spans) == n


def test_substring_dedup_empty_and_short(spark):
    assert substring_dedup.dedup_substrings(edge.empty(spark)).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert sorted(rows_of(substring_dedup.dedup_substrings(df), "n_words", "n_removed")) == [(0, 0), (3, 0), (3, 0)]


def test_substring_boundary_windows(spark):
    """Two factors that overlap by less than a window, and copies that differ in the 13th word."""
    rng = random.Random(5)
    w = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
    rows = [(1, " ".join(w[:25])), (2, " ".join(w[13:40])), (3, " ".join(w)), (4, " ".join(w[:12] + ["x"])),
            (5, " ".join(w[:13]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(substring_dedup.dedup_substrings(df).orderBy("doc_id"), "n_words", "n_removed", "kept_text")
    assert got == brute.substring_dedup(rows)


def test_simhash(docs, plain):
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    fps = [brute.simhash(t) for _, t in plain]
    comp = brute.components(fps)
    lowest = {}
    for (d, _), c in zip(plain, comp, strict=True):
        if d is not None:
            lowest[c] = min(lowest.get(c, d), d)
    want = [(d, f - (1 << 64) if f >= 1 << 63 else f, lowest.get(c)) for (d, _), f, c in zip(plain, fps, comp, strict=True)]
    assert Counter(got) == Counter(want)


def test_simhash_stage_keeps_one_of_each(docs, plain):
    kept = rows_of(simhash.one_of_each(docs), *docs.columns)
    comp = brute.components([brute.simhash(t) for _, t in plain])
    assert len(kept) == len(set(comp))
    first = {}
    for (d, t), c in zip(plain, comp, strict=True):
        first[c] = min(first.get(c, (True, 0)), (d is None, d or 0))
    assert Counter(r[0] for r in kept) == Counter(None if n else d for n, d in first.values())


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0
    assert simhash.one_of_each(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("part", [40, 2048])
def test_links_of_a_dense_group(spark, part):
    """A chain and a dense ball of fingerprints, in one hot shard that is dealt in parts."""
    rng = random.Random(2)
    ball = {0x0123456789ABCDEF ^ (1 << rng.randint(0, 40)) ^ (1 << rng.randint(0, 40)) for _ in range(300)}
    chain = [0xF0F0F0F0F0F0F0F0]
    for _ in range(40):
        chain.append(chain[-1] ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)))
    fps = sorted(ball | set(chain) | {rng.getrandbits(64) for _ in range(200)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = dict(rows_of(components.components(simhash.links(df, part=part)), "node", "root"))
    comp = brute.components(fps)
    groups = {}
    for f, c in zip(signed, comp, strict=True):
        groups.setdefault(c, []).append(f)
    want = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert got == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == ({i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200})


def test_query_digests(spark):
    """The query's columns follow from the operator's text."""
    got = dict(rows_of(queries.QUERIES["op1_line_dedup"](spark, SF_SMALL), "doc_id", "kept_sha256"))
    docs = rows_of(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id", "text")
    want = brute.line_dedup(docs)
    assert got == {d: hashlib.sha256(x[2].encode()).hexdigest() for (d, _), x in zip(docs, want, strict=True)}
