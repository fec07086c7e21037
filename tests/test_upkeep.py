"""Folders, artifacts, index upkeep, digests, matching blocks and exact rounding, each against plain Python."""

import difflib
import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import query as Q
from corpusloom.functions import text as T
from corpusloom.operators import chunking as K
from corpusloom.operators import index as I
from corpusloom.operators import matching as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import synthesis as S
from corpusloom.operators import trace as A
from corpusloom.operators import upkeep as U
from corpusloom.sources import files


def test_folders_are_scanned_one_level_deep(spark, tmp_path):
    for name, where in (("b.pdf", "fda"), ("A.pdf", "fda"), ("c +%20é.pdf", "Zoo"), ("n.txt", "fda"), ("d.pdf", "fda/old"), ("e.pdf", "."), ("f.pdf", "EU_GMP"), ("g.pdf", "Sops")):
        (tmp_path / where).mkdir(parents=True, exist_ok=True)
        (tmp_path / where / name).write_text("x" * len(name))
    rows = files.scan_folders(spark, str(tmp_path), "*.pdf").orderBy("folder_no", "file_no").collect()
    got = [(r.folder_no, r.folder, r.authority, r.file_no, r.file, r.size) for r in rows]
    assert got == [
        (1, "EU_GMP", "EU_GMP", 1, "f.pdf", 5), (2, "fda", "FDA", 1, "A.pdf", 5), (2, "fda", "FDA", 2, "b.pdf", 5), (3, "Sops", "SOP", 1, "g.pdf", 5), (4, "Zoo", "OTHER", 1, "c +%20é.pdf", len("c +%20é.pdf")),
    ]
    assert files.scan_folders(spark, str(tmp_path / "none")).collect() == []
    assert [r.authority for r in files.scan_folders(spark, str(tmp_path), "c*", {"zoo": "Z"}).collect()] == ["Z"]


def test_artifacts_are_json_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a / 1", ("q", [(0.2, None), (0.18, "x")])), ("b", ("é\n", []))], "id string, payload struct<question: string, tries: array<struct<least: double, why: string>>>")
    folder = files.write_artifacts(rows, str(tmp_path), "run 1")
    assert folder.endswith("/run 1")
    found = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "run 1").rglob("*.txt")}
    assert found["id=a_1"] == {"question": "q", "tries": [{"least": 0.2, "why": None}, {"least": 0.18, "why": "x"}]}
    back = files.read_artifacts(spark, folder, rows.schema["payload"].dataType.simpleString())
    assert {r.id: r.payload for r in back.collect()} == {"a_1": rows.first().payload, "b": rows.collect()[1].payload}
    (tmp_path / "run 1" / "id=c").mkdir()
    (tmp_path / "run 1" / "id=c" / "part.txt").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_artifacts(spark, folder, rows.schema["payload"].dataType.simpleString()).collect()


def test_content_hash_is_that_of_the_sorted_lines(spark):
    lines = [f"doc_{i % 97}:{i}" for i in range(3000)] + ["é:1", "", "a\nb"]
    df = spark.createDataFrame([(x,) for x in random.Random(2).sample(lines, len(lines))] + [(None,)], "line string").repartition(7)
    assert K.content_hash(df).first()[0] == hashlib.sha256("\n".join(sorted(lines, key=str.encode)).encode()).hexdigest()
    assert K.content_hash(df.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_an_index_is_brought_up_to_date_by_what_changed(spark):
    schema = "file string, text string"
    old = spark.createDataFrame([("same", "one two two"), ("changed", "two three"), ("removed", "four two"), ("parts", "x"), ("parts", "y")], schema)
    new = spark.createDataFrame([("same", "one two two"), ("changed", "three five"), ("added", "six one"), ("parts", "y"), ("parts", "x"), ("null", None)], schema)
    changed = U.changes(U.manifest(old, "text"), U.manifest(new, "text"))
    assert dict(map(tuple, changed.collect())) == {"same": "same", "changed": "changed", "removed": "removed", "added": "added", "parts": "same", "null": "added"}
    spaces = {"word": I.word_terms, "char": I.char_terms}
    chunks = lambda df: df.select("file", F.hash("text").alias("pdf_index"), F.lit("c1").alias("chunk_id"), "text")

    def fresh(df):
        c = chunks(df)
        tf = I.space_counts(c, R.KEY, spaces, "text")
        return {"chunks": c, "postings": tf, "vocabulary": I.space_vocabulary(tf, c.agg(F.count("*").alias("n")))}

    seen = []

    def chunks_of(names):
        seen.extend(r.file for r in names.collect())
        return chunks(new.join(names, "file", "left_semi"))

    got, want = U.refresh(fresh(old), changed, chunks_of, spaces), fresh(new)
    assert sorted(seen) == ["added", "changed", "null"]
    for name in want:
        assert sorted(map(str, got[name].select(want[name].columns).collect())) == sorted(map(str, want[name].collect()))


def test_matching_ratio_equals_the_library(spark):
    rng = random.Random(6)
    for t in range(900):
        letters = ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzéß")[t % 3]
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2))
        b = a[: rng.randint(0, len(a))] + b + a[rng.randint(0, len(a)) :] if t % 2 else b
        a, b = (a * 5, b * 6) if t % 5 == 0 else (a, b)  # long enough for popular letters
        want = difflib.SequenceMatcher(None, a, b).ratio()
        assert M.ratio(a, b) == want
        assert all(M.above(a, b, limit) == (want > limit) for limit in (0.3, 0.8, want))


def test_quote_dumps_of_all_turns(spark, small):
    from corpusloom.plans.catalog import QUERIES

    rows = pd.read_parquet(f"{small}/conversations.parquet").sort_values(["conv_id", "turn"])
    compact = spark.createDataFrame([(int(r.conv_id), int(r.turn), r.text) for r in rows.itertuples()], "c long, t long, s string").select("c", "t", F.regexp_replace(F.lower(F.coalesce("s", F.lit(""))), r"[^\p{L}\p{N}]+", "").alias("s"))
    by = {(r.c, r.t): r.s for r in compact.collect()}
    keys = sorted(by)
    has = {(int(r.conv_id), int(r.turn)) for r in rows.itertuples() if r.text is not None}
    want = {k: difflib.SequenceMatcher(None, by[k], by[p]).ratio() > 0.8 for p, k in zip(keys, keys[1:]) if p[0] == k[0] and p in has}
    got = {(r.conv_id, r.turn): r.dump for r in QUERIES["quote_dump"](spark, small).collect()}
    assert got == want and got


def test_numbers_are_rounded_as_python_rounds_them(spark):
    rng = random.Random(3)
    values = [6.25, 31.25, 0.15, 0.25, 0.35, 2.675, 1e9 + 0.05, 99.95, 99.949999, 0.0, 100.0, 5e-5] + [rng.random() * 10 ** rng.randint(-3, 6) for _ in range(300)] + [100.0 * a / b for a in range(30) for b in (16, 32, 40, 2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[T.fixed(F.col("v"), k).alias(f"d{k}") for k in (1, 2, 4)])
    for r in rows.collect():
        assert (r.d1, r.d2, r.d4) == (f"{r.v:.1f}", f"{r.v:.2f}", f"{r.v:.4f}")


def test_citations_take_the_line_in_their_place(spark):
    answer = "ANSWER:\n1) Requirement: First. (a | 1 | c1)\n2) Second (of two). (a | 1 | c1)\n3) Third. (b | 2 | c1)\nCONFIDENCE: High"
    answers = spark.createDataFrame([(1, answer), (2, S.REFUSAL), (3, "ANSWER:\n1) Only. (a | 1 | c1)\nCONFIDENCE: Low")], "qid int, answer string")
    cited = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "a"), (3, 2, "b")], "qid int, citation int, pdf string")
    got = {(r.qid, r.citation): r.sentence for r in S.cited_sentences(answers, cited).collect()}
    # The second line repeats the first one's citation, so that the next citation stands beside it.
    assert got == {(1, 1): "Requirement: First.", (1, 2): "Second (of two).", (3, 1): "Only.", (3, 2): ""}


def test_default_lexicons_and_profiles(spark):
    ask = ["What controls are expected for audit trails in computerized systems?", "What constitutes data integrity and what controls ensure ALCOA?", "What is quality risk management under ICH Q9?"]
    rows = spark.createDataFrame([(q,) for q in ask], "q string").select(Q.domain(F.col("q")).alias("d")).collect()
    assert [r.d for r in rows] == ["computerized_systems", "data_integrity", None]
    lex = C.LEXICONS["computerized_systems"]
    said = ["The computerized system must maintain an audit trail and access control.", "CAPA should be documented by the quality unit.", "Records must be kept in a backup with authentication."]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(Q.passes(F.col("s"), lex)).collect()] == [True, False, True]
    q = "use our internal sop for equipment qualification"
    prior = lambda authority, file, text: spark.range(1).select(R.prior(F.lit(q), F.lit(authority), F.lit(file), F.lit(text))).first()[0]
    sop, other = prior("SOP", "Manual-053-Laboratory-Equipment-Qualification.pdf", "internal procedure and records"), prior("FDA", "Q9.pdf", "regulatory guideline")
    assert sop > other and round(sop, 6) == round(0.30 + 0.12 + 0.22 - 0.04 - 0.03, 6)


def test_scores_of_many_blocks_and_rare_terms(spark, monkeypatch):
    """Questions in blocks of three, and all but the most frequent terms joined by sorting, score as one block with all terms broadcast."""
    rng = random.Random(5)
    words = ["validation", "of", "batch", "records", "review", "the", "data", "trail", "audit", "integrity"] + [f"rare{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, k=25))
    q = spark.createDataFrame([(i, text(), i % 4) for i in range(20)] + [(20, None, 0)], "qid long, q_aug string, bits int")
    c = spark.createDataFrame([(f"f{i % 7}", i, "c1", rng.choice(["SOP", "FDA"]), text()) for i in range(60)] + [("e", 0, "c1", "FDA", "")], "file string, pdf_index int, chunk_id string, authority string, text string")
    spaces = {"word": I.word_terms, "char": I.char_terms}
    vocab = I.space_vocabulary(I.space_counts(c, R.KEY, spaces, "text"), c.agg(F.count("*").alias("n")))
    parts = R.prior_parts(F.col("authority"), F.col("file"), F.col("text"), C.PROFILES[:2])

    def rows(**more):
        found = R.score_reaching(q, c, spaces, vocab, 0.15, parts, F.lit(2), F.col("qid") % 2 == 0, **more).collect()
        return {(r.qid, r.file, r.pdf_index): tuple(round(r[k], 9) for k in ("sim_word", "sim_char", "overlap", "base", "final")) for r in found}

    want = rows()
    assert want
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    assert rows(block=3) == want
    frequent = I.frequent
    monkeypatch.setattr(I, "frequent", lambda vocab: frequent(vocab, 40))
    assert rows(block=7) == want
    # Against the joins of both spaces.
    word = I.search_space(c, q.na.drop(), I.word_terms, R.KEY, ["qid"], "text", "q_aug")
    sims = {(r.qid, r.file, r.pdf_index): round(r.sim, 9) for r in word.collect()}
    assert all(v[0] == sims.get(k, 0.0) for k, v in want.items())


POOL = "qid long, domain string, text string, file string, pdf_index int, chunk_id string, authority string, base double, final double, hits int, pool_rank int, page_label string"


def test_attempts_count_what_the_filter_did(spark):
    lexicon = {"data_integrity": C.Lexicon(("strong",), ("sec", "ond"), ("bad",))}
    rows = [(1, "data_integrity", t, f"f{i}", i, f"p{i}_c1", "FDA", 0.5 - i / 10, 0.5 - i / 10, i, i + 1, " iv " if i else None) for i, t in enumerate(["strong", "sec ond", "none"])]
    rows += [(2, None, "strong", "f", 0, "p0_c1", None, 0.4, 0.4, 0, 1, None)]
    pool = spark.createDataFrame(rows, POOL)
    questions = spark.createDataFrame([(1, "data_integrity"), (2, None), (3, "data_integrity")], "qid long, domain string")
    out = {r.qid: r for r in A.attempt(questions, 1, pool, pool.where("text <> 'none'"), lexicon, 0.2, F.lit(True), F.lit("MIXED")).collect()}
    counters = lambda r: (r.chunks_before, r.chunks_after_level1_strict, r.chunks_after_level2_relaxed, r.chunks_after_domain_chunk_filter, r.domain_chunk_filter_used, r.domain_chunk_filter_level_used, r.fallback_used)
    assert counters(out[1]) == (3, 2, 3, 2, True, 1, False) and counters(out[2]) == (1, 1, 1, 1, False, 0, False) and counters(out[3]) == (0, 0, 0, 0, False, 0, True)
    first, second = out[1].top_results
    assert (first.pdf, first.page, first.display_page, first.req_boost, first.quote_preview) == ("f0", 1, "1", 0.0, "strong")
    assert (second.page_label, second.display_page, second.req_signal_hits, round(second.req_boost, 6)) == ("iv", "iv", 1, 0.005)
    assert out[2].top_results[0].authority == "OTHER" and out[3].top_results is None
    searches = questions.select("qid", F.array(F.lit("q")).alias("queries_used"), F.array().cast("array<string>").alias("anchor_terms_used"), F.lit("").alias("expanded_query_used"))
    again = A.attempt(questions.where("qid = 3"), 2, pool.where("false"), pool.where("false"), lexicon, 0.2, F.lit(False), F.lit("MIXED"), A.SCOPE_RETRY)
    every = A.attempt(questions, 1, pool, pool, lexicon, 0.2, F.lit(True), F.lit("MIXED")).unionByName(again)
    routed = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "qid long, doc string, rank int")
    gathered = pool.where("qid = 1")
    traces = {r.qid: r.trace for r in A.assemble(questions, every, searches, routed, gathered.limit(0), A.balancing(gathered, gathered.limit(1))).collect()}
    assert traces[1].candidate_docs == ["a", "b"] and traces[2].candidate_docs == [] and traces[3].thresholds_attempted == [0.2, 0.2]
    assert traces[3].empty_result_scope_retry_attempted and not traces[3].empty_result_scope_retry_used and not traces[1].empty_result_scope_retry_attempted
    assert (traces[1].balancing.input_count, traces[1].balancing.soft_floor_score) == (3, 0.28) and traces[2].balancing is None
