"""Searches see every pair of a question and a chunk, as a cross join of both does."""

from pyspark.sql import functions as F

from corpusloom.operators import index as I
from corpusloom.operators import retrieval as R
from corpusloom.plans import search_plans as S
from corpusloom.plans.catalog import QUERIES


def test_scored_rows_equal_a_cross_join(spark, small):
    c, q = S.chunks(spark, small), S.asked(spark, small)
    word = I.search_space(c, q, S.word_terms, R.KEY, ["qid"], "text", "q_aug")
    char = I.search_space(c, q, I.char_terms, R.KEY, ["qid"], "text", "q_aug")
    pairs = q.crossJoin(c.select(*R.KEY, "authority", "text"))
    every = R.score_pairs(pairs, word, char, R.token_overlap(q, c), ["qid"], S.prior_column(), R.requirement_hits(F.col("text"), S.SIGNALS), S.broad(F.col("q_aug")))
    rows = lambda x: {(r.qid, r.file, r.pdf_index, r.chunk_id): (round(r.base, 9), round(r.final, 9)) for r in x.where(F.col("base") >= 0.19).collect()}
    want = rows(every)
    assert want and rows(S.scored(spark, small)) == want
    n = c.count()
    stats = QUERIES["empty_retrieval_stats"](spark, small).collect()
    assert {r.total for r in stats} == {n} and len(stats) == q.count()
    assert all(r.scope_removed + r.docs_removed + r.similarity_removed + r.eligible == n for r in stats)
    assert {r.total for r in QUERIES["similarity_threshold"](spark, small).collect()} == {n}


def test_pairs_carried_by_their_prior_alone_are_found(spark):
    q = spark.createDataFrame([(1, "xyz", 1), (2, "abc", 0)], "qid long, q_aug string, bits int")
    c = spark.createDataFrame([("f", 0, "c1", "SOP", "mno " * 30), ("g", 0, "c1", "FDA", "mno " * 30)], "file string, pdf_index int, chunk_id string, authority string, text string")
    spaces = {"word": I.word_terms, "char": I.char_terms}
    vocab = I.space_vocabulary(I.space_counts(c, R.KEY, spaces, "text"), c.agg(F.count("*").alias("n")))
    parts = R.prior_parts(F.col("authority"), F.col("file"), F.col("text"), ())
    for block in (1024, 1):
        out = R.score_reaching(q, c, spaces, vocab, 0.2, parts, F.lit(0), F.lit(False), block=block).collect()
        assert [(r.qid, r.file, round(r.base, 6)) for r in out] == [(1, "f", 0.22)]


def test_every_form_is_searched_and_routed_documents_are_ranked_alone(spark, small):
    assert S.asks(spark, small).where("variant_no > 0").count() > 0
    best, mine = {}, {}
    for r in S.searched(spark, small).where("admitted and base >= 0.2").collect():
        for into in (best, mine) if r.allowed else (best,):
            into.setdefault((r.qid, r.variant_no), []).append((-round(r.final, 12), -round(r.base, 12), r.file, r.pdf_index, r.chunk_id))
    top = lambda x, k: {(q, *row[2:]) for (q, _), rows in x.items() for row in sorted(rows)[:k]}
    got = {(r.qid, r.file, r.pdf_index, r.chunk_id) for r in S.pool(spark, small).collect()}
    assert top(mine, 1) <= got <= top(mine, 12)
    more = {(r.qid, r.file, r.pdf_index, r.chunk_id) for r in S.retried(spark, small).collect()}
    assert got <= more and more - got <= top(best, 12)


def test_facts_are_the_balanced_rows_with_their_final_scores(spark, small):
    from corpusloom.plans.phase_plans import facts

    final = {(r.qid, r.file, r.pdf_index, r.chunk_id): round(r.final, 6) for r in S.gathered(spark, small).collect()}
    found = {(r.qid, r.pdf, r.pdf_index, r.chunk_id): r.score for r in facts(spark, small).collect()}
    assert found and all(final[k] == v for k, v in found.items()) and {k[0] for k in found} == {k[0] for k in final}
    assert QUERIES["answer"](spark, small).count() == S.asked(spark, small).count()


def test_no_question_or_document_is_left_out_by_its_number(spark, small):
    c = S.chunks(spark, small)
    assert QUERIES["query_prior"](spark, small).count() == c.count() * S.asked(spark, small).count()
    pairs = c.crossJoin(S.asked(spark, small)).groupBy("qid").agg(F.round(F.sum(S.prior_column()), 3).alias("s"))
    got = QUERIES["query_prior"](spark, small).groupBy("qid").agg(F.round(F.sum("prior"), 3).alias("s"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in pairs.collect()}
    from corpusloom.plans.page_plans import chunk_table

    every = chunk_table(spark, small)
    assert QUERIES["index_integrity"](spark, small).first().total_chunks == every.count()
    assert QUERIES["zero_chunk_docs"](spark, small).join(every, "file", "left_semi").count() == 0
