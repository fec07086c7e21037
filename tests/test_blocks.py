"""Terms counted by blocks, and questions that meet documents where those are."""

from pyspark.sql import functions as F

from corpusloom.operators import index as I


def test_a_vocabulary_counted_by_blocks_is_that_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 3)
    texts = ["one two two", "two  a aa\taaaaaaaa", "", None, "Straße ß ÉÉ 12", "one two", "one", "aaa aaa aaa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spaces = {"word": I.word_terms, "char": I.char_terms}
    want = I.space_vocabulary(I.space_counts(rows, ["id"], spaces, "text"), rows.agg(F.count("*").alias("n")))
    got = I.counted_vocabulary(rows, ["id"], spaces, "text")
    values = lambda x: {(r.space, r.term): (r.df, r.idf) for r in x.collect()}
    assert values(got) == values(want) and len(values(got)) > 40


def test_pairs_of_questions_and_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([("d", "one two"), ("e", "two three"), ("f", "four")], "doc string, text string")
    asks = spark.createDataFrame([(1, "two four"), (2, "six")], "qid long, q string")
    sims = I.search_space(docs, asks, I.word_terms, ["doc"], ["qid"], "text", "q")
    plan = sims._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan and "BroadcastHashJoin" in plan
    assert {(r.qid, r.doc) for r in sims.collect()} == {(1, "d"), (1, "e"), (1, "f")}
