"""Operators on small frames, among them cases with a sequential rule restated in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.operators import chunking as K
from corpusloom.operators import evaluation as V
from corpusloom.operators import evidence as E
from corpusloom.operators import index as I
from corpusloom.operators import pages as P
from corpusloom.operators import replies as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import routing as G
from corpusloom.operators import synthesis as S
from corpusloom.sources import index_store


def smooth(labels):
    out = [*labels]
    for i in range(1, len(out) - 1):
        if out[i - 1] is not None and out[i + 1] == out[i - 1] + 2 and out[i] != out[i - 1] + 1 and (out[i] is None or abs(out[i] - out[i - 1] - 1) >= 10):
            out[i] = out[i - 1] + 1
    return out


def test_smoothing_equals_the_sequential_rule(spark):
    rng = random.Random(0)
    docs = [[2, 73, 4], [2, 73, 4, 75]] + [[rng.choice([i + 1, i + 1, i + 60, None]) for i in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(d, i, None if v is None else str(v), []) for d, x in enumerate(docs) for i, v in enumerate(x)]
    out = P.smooth_labels(spark.createDataFrame(rows, "doc int, i int, label string, candidates array<int>"), "doc", "i").collect()
    got = {(r.doc, r.i): r.label for r in out}
    for d, x in enumerate(docs):
        assert [got[d, i] for i in range(len(x))] == [None if v is None else str(v) for v in smooth(x)]


@pytest.mark.parametrize("lines,index,want", [
    (["a guideline", "3", "Glossary", *["text"] * 20, "137"], 0, "137"),
    (["ICH Q9 Guideline", "Step 4", "73", "3", "text"], 6, "3"),
    (["text", "iv"], 0, "iv"),
    (["only text"], 0, None),
])
def test_label_derivation(spark, lines, index, want):
    rows = [("d", index, i, x) for i, x in enumerate(lines)]
    assert P.derive_labels(spark.createDataFrame(rows, "doc string, idx int, pos int, line string"), ["doc"], "idx").first().label == want


def test_hyphen_merge(spark):
    rows = [("d", i, x) for i, x in enumerate(["quali-", "fica-", "tion of", "", "ANNEX-", "Upper"])]
    out = P.merge_hyphenated(spark.createDataFrame(rows, "doc string, line_no int, line string"), "doc").orderBy("line_no").collect()
    assert [r.line for r in out] == ["qualifica-", "tion of", "ANNEX-", "Upper"]


def test_chunking(spark):
    rows = [("d", 0, i, x) for i, x in enumerate(["Annex 1", "First sentence.", "Second one", "goes on.", "", "x" * 30 + ". " + "y" * 30 + ".", "Tail."])]
    blocks = K.build_blocks(spark.createDataFrame(rows, "doc string, page int, n int, line string"), ["doc", "page"], "n")
    assert [(r.section, r.text) for r in blocks.orderBy("block").collect()] == [("Annex 1", "First sentence."), ("Annex 1", "Second one goes on."), ("Annex 1", "x" * 30 + ". " + "y" * 30 + "."), ("Annex 1", "Tail.")]
    chunks = K.chunk(blocks, ["doc", "page"], 40, 10).orderBy("seq").collect()
    assert [r.text for r in chunks] == ["First sentence.\nSecond one goes on.", "x" * 30 + ".", "y" * 30 + ".\nTail."]
    assert [r.chunk_id for r in chunks] == ["p0_c1", "p0_c2", "p0_c3"]


def test_migration(spark):
    rows = [(None, 7, " ", "p7_c1"), (6, 7, "A", "p7_c3"), (-2, 1, None, "bad")]
    out = K.migrate(spark.createDataFrame(rows, "pdf_index int, page int, page_label string, chunk_id string")).collect()
    assert [(r.pdf_index, r.page, r.page_label, r.chunk_id) for r in out] == [(7, 8, None, "p7_c1"), (6, 7, "A", "p6_c3"), (0, 1, None, "p0_c1")]


CH = "qid int, file string, pdf_index int, chunk_id string, authority string, base double, final double, hits int"


def test_boost_reorders_near_ties_only(spark):
    rows = [(1, "a", 0, "c1", "OTHER", 0.45, 0.45, 0), (1, "b", 0, "c1", "FDA", 0.4437, 0.4537, 2), (1, "c", 0, "c1", "EU_GMP", 0.19, 0.205, 3)]
    out = R.rank(spark.createDataFrame(rows, CH), ["qid"], 2, 0.20).orderBy("rank").collect()
    assert [r.file for r in out] == ["b", "a"]


def test_balance_keeps_authorities_and_refills_by_hits(spark):
    rows = [(1, "f", i, "c1", "FDA", 0.50 - i / 100, 0.50 - i / 100, 0) for i in range(6)] + [(1, "e", 0, "c1", "EU_GMP", 0.44, 0.44, 0), (1, "i", 0, "c1", "ICH", 0.43, 0.43, 0)]
    out = R.balance(spark.createDataFrame(rows, CH), 8).collect()
    assert len(out) == 8 and {r.authority for r in out} == {"FDA", "EU_GMP", "ICH"}
    rows = [(1, "f", i, f"p{i}_c1", "FDA", b, b, h) for i, (b, h) in enumerate([(0.50, 0), (0.49, 0), (0.48, 0), (0.47, 0), (0.46, 3)])] + [(1, "e", 0, "c", "ICH", 0.45, 0.45, 0)]
    assert "p4_c1" in {r.chunk_id for r in R.balance(spark.createDataFrame(rows, CH), 5).collect()}


def test_mmr_equals_a_plain_loop(spark):
    rng = random.Random(4)
    ranked, posts, vec = [], [], {}
    for q in range(5):
        finals = sorted((rng.random() for _ in range(8)), reverse=True)
        for k, f in enumerate(finals):
            v = {t: rng.random() for t in rng.sample("abcdef", 3)}
            n = sum(x * x for x in v.values()) ** 0.5
            vec[q, k] = {t: x / n for t, x in v.items()}
            ranked.append((q, f"f{q}", k, "c", k + 1, f))
            posts += [(f"f{q}", k, "c", t, x) for t, x in vec[q, k].items()]
    out = R.mmr(spark.createDataFrame(ranked, "qid int, file string, pdf_index int, chunk_id string, rank int, final double"), spark.createDataFrame(posts, "file string, pdf_index int, chunk_id string, term string, weight double"), ["qid"], 5, 0.6)
    got = {}
    for r in out.orderBy("qid", "mmr_pos").collect():
        got.setdefault(r.qid, []).append(r.pdf_index)
    score = {(q, k): f for q, _, k, _, _, f in ranked}
    dot = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items())
    for q in range(5):
        chosen = [0]
        while len(chosen) < 5:
            chosen.append(max((k for k in range(8) if k not in chosen), key=lambda k: 0.6 * score[q, k] - 0.4 * max(dot(vec[q, k], vec[q, j]) for j in chosen)))
        assert got[q] == chosen


def test_tfidf_weights(spark):
    chunks = spark.createDataFrame([("d", 0, "a", "red fox"), ("d", 0, "b", "red dog")], "file string, pdf_index int, chunk_id string, text string")
    q = spark.createDataFrame([(1, "red fox zebra")], "qid int, q string")
    sims = {r.chunk_id: r.sim for r in I.search_space(chunks, q, I.word_terms, R.KEY, ["qid"], "text", "q").collect()}
    assert abs(sims["a"] - 1.0) < 1e-9 and 0 < sims["b"] < 0.5


def test_domain_filter_levels(spark):
    lex = {"d": C.Lexicon(("strong",), ("sec", "ond"), ("bad",))}
    rows = [(1, "d", "strong"), (1, "d", "sec ond"), (1, "d", "none"), (2, "d", "sec"), (2, "d", "ond"), (2, "d", "bad strong"), (3, "d", "none"), (4, None, "strong")]
    out = R.domain_filter(spark.createDataFrame(rows, "qid int, domain string, text string"), lex, relaxed=("d",)).collect()
    assert sorted((r.qid, r.level, r.text) for r in out) == [(1, 1, "sec ond"), (1, 1, "strong"), (2, 2, "ond"), (2, 2, "sec"), (3, 0, "none"), (4, 0, "strong")]


FACT = "qid int, question string, pdf string, pdf_index int, chunk_id string, quote string, score double"


def test_requirement_gate_adds_a_second_source(spark):
    q, good = "what does gmp require for validation?", "The validation protocol shall be approved before use of the line."
    facts = spark.createDataFrame([(1, q, "a", 0, "c1", good, 0.5), (1, q, "b", 0, "c1", good.replace("line", "plant"), 0.4), (2, q, "a", 0, "c1", "Introduction", 0.5), (2, q, "b", 0, "c1", "About validation in plain words here.", 0.3)], FACT)
    kept = facts.where("pdf = 'a'").withColumn("pos", F.lit(1))
    out = E.requirement_gate(kept, facts, F.col("qid") == 1)
    assert sorted((r.qid, r.pdf, r.how) for r in out.collect()) == [(1, "a", "kept"), (1, "b", "second source"), (2, "b", "stand-in")]


@pytest.mark.parametrize("question,quote,want", [
    ("gmp", "process validation is planned", True), ("gmp", "iq and oq are done", True), ("gmp", "acceptance criteria only", False),
    ("gmp", "validation of investigational medicinal products", False), ("adulteration?", "validation of investigational medicinal products", True),
])
def test_coherence(spark, question, quote, want):
    assert spark.range(1).select(E.coherent(F.lit(question), F.lit(quote)).alias("v")).first().v is want


def test_synthesis_refuses_and_answers(spark):
    rows = [(1, "q", "a.pdf", 0, "c1", "SCOPE AND PURPOSE OF THE MANUAL.", 0.5)]
    rows += [(2, "q", p, 0, "c1", f"Operators must record every {w} in the batch log. They shall review each {w} before release of goods.", 0.5) for p, w in (("a.pdf", "step"), ("b.pdf", "event"))]
    facts = spark.createDataFrame(rows, FACT)
    found = S.sentences(facts, ["qid", *E.KEY])
    chosen = S.choose_lines(S.candidates(S.select_facts(facts, found).withColumn("domain", F.lit(None).cast("string")), found))
    out = {r.qid: r for r in S.render(chosen, facts.select("qid").distinct()).collect()}
    assert out[1].answer == S.REFUSAL and out[1].n_lines == 0
    assert out[2].n_lines == 4 and out[2].confidence == "High" and out[2].answer.startswith("ANSWER:\n1) Requirement: ")


def test_routing(spark):
    sim = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4), (1, "c", 0.0)], "qid int, doc string, sim double")
    hits = spark.createDataFrame([(1, "c", 3.0)], "qid int, doc string, hits double")
    none = spark.createDataFrame([], "qid int, doc string, overlap double")
    assert [r.doc for r in G.route(sim, none, hits).orderBy("rank").collect()] == ["c", "a", "b"]


def test_evaluation_metrics(spark):
    rows = [(i, False, i == 0, True, False) for i in range(10)] + [(10, True, True, True, True)]
    out = V.metrics(spark.createDataFrame(rows, "id int, expected_not_found boolean, fallback boolean, ok boolean, refused boolean")).first()
    assert (round(out.fallback_rate, 6), out.fallback_answerable, out.ci_fail) == (round(2 / 11, 6), 0.1, False)


def test_verdicts_keep_the_last_and_drop_invalid(spark):
    results = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    old = spark.createDataFrame([("a", "partial", "x", 1), ("a", "incorrect", "y", 2), ("b", "odd", None, 3)], "id string, verdict string, notes string, row int")
    assert sorted(map(tuple, V.init_verdicts(results, old).collect())) == [("a", "incorrect", "y"), ("b", "unknown", ""), ("c", "unknown", "")]


def test_replies(spark):
    src = spark.createDataFrame([(1, "what about batch records and review", "a", 0, "c1", "Batch records and their review are kept for years.", 0.4)], FACT)
    reply = spark.createDataFrame([(1, 1, "Batch records need a timely review.", "a", 1, "c1"), (1, 2, "Unknown source sentence about batch review.", "z", 1, "c1"), (1, 3, "Batch records and their review are kept for years.", "a", 1, "c1")], "qid int, n int, sentence string, pdf string, page int, chunk_id string")
    assert [r.n for r in L.validate_synthesis(reply, src).collect()] == [1]
    asked = L.ask(spark.createDataFrame([("x",)], "prompt string"), lambda p: p.upper(), "prompt", "prompt string, reply string")
    assert asked.first().reply == "X"


def test_index_store(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.save(path, {"version": "1"}, {"t": spark.range(3)})
    assert index_store.load(spark, path, {"version": "1"})["t"].count() == 3
    with pytest.raises(ValueError):
        index_store.load(spark, path, {"version": "2"})
