"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, fingerprints, language_id, licenses, line_dedup, merkle, packing, periodic, sentencepiece_bpe, simhash,
               substring_dedup, token_counts, token_shards)
from .common import documents, embeddings, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return put


@query("op1_line_dedup", """
    with lines as (
        select n, doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from (select n, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos
              from (select row_number() over () as n, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
    first as (
        select key, max(doc_id) as keeper from lines where length(key) >= 20
        group by key having count(distinct coalesce(cast(doc_id as varchar), '')) >= 3)
    select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
    from (select l.*, f.keeper is not null and coalesce(l.doc_id < f.keeper, true) as gone
          from lines l left join first f on l.key = f.key)
    group by n""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents keep once repeated lines are dropped."""
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every whole document and its edited text, and their likeness."""
    found = fingerprints.edited_versions(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and the text decoded from them."""
    decoded = sentencepiece_bpe.decode(sentencepiece_bpe.encode(documents(spark, sf_dir)))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 1024 tokens."""
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op5_substring_dedup", """
    with words as (
        select doc_id, unnest(ws) as w, unnest(range(len(ws))) as pos, len(ws) as n
        from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents)),
    windows as (
        select doc_id, pos, w, n,
               case when pos + 13 <= n then string_agg(w, ' ') over (
                   partition by doc_id order by pos rows between current row and 12 following) end as win
        from words),
    seen as (select win, min(doc_id) as first_doc from windows where win is not null group by win),
    marked as (
        select a.doc_id, a.pos, a.w, coalesce(s.first_doc < a.doc_id, false) as starts
        from windows a left join seen s on a.win = s.win),
    covered as (
        select doc_id, pos, w, bool_or(starts) over (
            partition by doc_id order by pos rows between 12 preceding and current row) as gone
        from marked),
    per_doc as (
        select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
               coalesce(string_agg(w, ' ' order by pos) filter (where not gone), '') as kept
        from covered group by doc_id)
    select d.doc_id, coalesce(p.n_words, 0) as n_words, coalesce(p.n_removed, 0) as n_removed,
           sha256(coalesce(p.kept, '')) as kept_sha256
    from documents d left join per_doc p on d.doc_id = p.doc_id""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that documents keep once repeated passages are cut."""
    cut = substring_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_token_shards")
def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the binary shards that hold all documents in training order."""
    return token_shards.write_shards(documents(spark, sf_dir), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


@query("op7_ann")
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every 50th, found in the shards' graphs."""
    vectors = ann.usable(embeddings(spark, sf_dir), "vec_id", "embedding")
    index = ann.build_index(vectors).checkpoint()
    return ann.search(index, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count and best path score of every whole document."""
    return token_counts.count_tokens(documents(spark, sf_dir))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from two thirds of them."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return (language_id.predict(docs.select("doc_id", "text"), model)
            .select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out))


def _crc32(s: str) -> str:
    """CRC-32 of an ASCII SQL expression, bit by bit."""
    return f"""xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, y:
            CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')"
                                   for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


@query("op13_merkle_manifest", f"""
    with recursive base as (
        select *, coalesce({_crc32("cast(doc_id as varchar)")} % 7 = 0, false) as hit from documents),
    rows as (
        select doc_id, lang, {_leaf_sql("n_chars")} as leaf,
               case when hit then {_leaf_sql("(n_chars + 1)")} else {_leaf_sql("n_chars")} end as now from base),
    placed as (
        select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos,
               count(*) over (partition by lang) as n from rows),
    nodes as (
        select lang, 0 as lvl, pos, leaf as h, n as m from placed
        union all
        select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (m + 1) // 2
        from nodes where m > 1 group by lang, lvl, pos // 2, m),
    tops as (
        select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n
        from nodes where m = 1),
    upper_nodes as (
        select 0 as lvl, pos, h, n as m from tops
        union all
        select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (m + 1) // 2
        from upper_nodes where m > 1 group by lvl, pos // 2, m),
    steps as (
        select p.lang, p.pos as leaf_pos, s.lvl, x.h as sibling, x.pos < s.pos as on_left
        from placed p join nodes s on s.lang is not distinct from p.lang and s.pos = p.pos >> s.lvl and s.m > 1
        left join nodes x on x.lang is not distinct from s.lang and x.lvl = s.lvl and x.pos = xor(s.pos, 1)
        union all
        select p.lang, p.pos, 1000 + s.lvl, x.h, x.pos < s.pos
        from placed p join tops t on t.lang is not distinct from p.lang
        join upper_nodes s on s.pos = t.pos >> s.lvl and s.m > 1
        left join upper_nodes x on x.lvl = s.lvl and x.pos = xor(s.pos, 1)),
    numbered as (
        select *, row_number() over (partition by lang, leaf_pos order by lvl) as k from steps),
    proofs as (
        select lang, leaf_pos, sha256(coalesce(string_agg(sibling, '' order by lvl), '')) as proof
        from steps group by lang, leaf_pos),
    fold as (
        select lang, pos as leaf_pos, 0 as k, now as h from placed
        union all
        select f.lang, f.leaf_pos, s.k, sha256(case when s.sibling is null then f.h
                   when s.on_left then s.sibling || f.h else f.h || s.sibling end)
        from fold f join numbered s on s.lang is not distinct from f.lang and s.leaf_pos = f.leaf_pos and s.k = f.k + 1),
    ended as (
        select lang, leaf_pos, arg_max(h, k) as folded_root from fold group by lang, leaf_pos)
    select p.doc_id, p.leaf, t.h as subroot, r.h as root, coalesce(q.proof, sha256('')) as proof_sha256,
           e.folded_root, e.folded_root = r.h as verified
    from placed p join tops t on t.lang is not distinct from p.lang
    cross join (select h from upper_nodes where m = 1) r
    join ended e on e.lang is not distinct from p.lang and e.leaf_pos = p.pos
    left join proofs q on q.lang is not distinct from p.lang and q.leaf_pos = p.pos""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proofs of all documents, checked against rows of which every seventh or so is tampered with."""
    docs = documents(spark, sf_dir)
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    altered = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select("doc_id", "lang", merkle.leaf(*fields).alias("leaf"),
                       F.when(hit, merkle.leaf(*altered)).alias("altered"))
    found = merkle.manifest(rows, carry=["altered"])
    now = merkle.folded(F.coalesce("altered", "digest"), F.col("path"))
    return (found.select(F.col("order").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
                         merkle.proof_digest(F.col("path")).alias("proof_sha256"), now.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


_WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; where CRC-32 of the id is divisible by ten, the words from
    one on repeat with a period, both taken from the CRC."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
                       .alias("words")).withColumn("n", F.size("words"))
    start = (F.col("g") % F.col("n")).cast("int")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, start))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p, n = F.col("a"), F.col("p"), F.col("n")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), times)), F.lit(1), n - a)
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", f"""
    with cut as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
               coalesce({_crc32("cast(doc_id as varchar)")}, 1) as h from documents),
    sized as (select *, len(ws) as n, h // 10 as g from cut),
    started as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from sized),
    periodic as (select *, 1 + (n - a) // (3 + g % 8) as p from started),
    words as (
        select doc_id, i, n, ws[case when a is null or i < a then i else a + (i - a) % p end + 1] as w
        from (select *, unnest(range(n)) as i from periodic)),
    grams as (
        select doc_id, i, n, case when i + 6 <= n then hash(string_agg(w, ' ') over (
                   partition by doc_id order by i rows between current row and 5 following)) end as gram
        from words),
    lags as (
        select distinct x.doc_id, y.i - x.i as q from grams x join grams y
        on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i and y.i - x.i <= x.n // 2),
    same as (
        select l.doc_id, l.q, x.i, x.i - row_number() over (partition by l.doc_id, l.q order by x.i) as island
        from lags l join words x on x.doc_id = l.doc_id
        join words y on y.doc_id = l.doc_id and y.i = x.i + l.q and y.w = x.w),
    stretches as (
        select doc_id, q, min(i) as s, count(*) + q as len from same group by doc_id, q, island),
    runs as (
        select doc_id, s, len, min(q) as q from stretches where len >= greatest(12, 2 * q) group by doc_id, s, len),
    summed as (
        select doc_id, count(*) as n_runs,
               sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q)) as runs_sha256,
               arg_min(struct_pack(s := s, len := len, q := q), struct_pack(x := -len, y := s, z := q)) as top
        from runs group by doc_id),
    gone as (
        select distinct doc_id, unnest(range(s + q, s + len)) as i from runs),
    kept as (
        select w.doc_id, string_agg(w.w, ' ' order by w.i) as text
        from words w anti join gone g on w.doc_id = g.doc_id and w.i = g.i group by w.doc_id)
    select d.doc_id, coalesce(r.n_runs, 0) as n_runs, r.top.s as start, r.top.len as length, r.top.q as period,
           1000 * r.top.len // r.top.q as exponent_milli, coalesce(r.runs_sha256, sha256('')) as runs_sha256,
           sha256(coalesce(k.text, '')) as collapsed_sha256
    from documents d left join summed r on r.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole document, a tenth of them with a planted one."""
    found = periodic.periodic_runs(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))
    top = periodic.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
                         F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                         F.sha2("kept_text", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                    F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of licence names and labels of covered licence notices in every whole document."""
    found = licenses.scan(documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(base, F.transform("spans", lambda s: s["label"])))
    at = F.transform("places", lambda p: p["word"])
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score")
