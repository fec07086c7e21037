"""Blocks of chunks that weigh their own terms, ranking of few rows, and the best similarity over a question's forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import index as I
from corpusloom.operators import retrieval as R

SPACES = {"word": I.word_terms, "char": I.char_terms}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["audit", "trail", "of", "records", "Straße", "É", "validation", "a"] + [f"rare{i}" for i in range(60)]
    return [" ".join(rng.choices(words, k=12)) for _ in range(40)] + ["", None]


def test_blocks_are_told_the_frequencies_that_they_share(spark, texts):
    """Of each block's terms, those that are asked for or that other blocks hold come back, with the frequencies of all rows."""
    c = spark.createDataFrame([(f"f{i % 9}", i, "c1", "FDA", t) for i, t in enumerate(texts)], "file string, pdf_index int, chunk_id string, authority string, text string")
    q = spark.createDataFrame([(1, "audit rare5 nowhere"), (2, None)], "qid long, q_aug string")
    asked = spark.createDataFrame(R.asked_terms(q, SPACES).collect(), "space string, term string, tid long")
    got = {b: R.counted_blocks(c, b, asked, SPACES) for b in (1, 7)}
    vocab = I.space_vocabulary(I.space_counts(c, R.KEY, SPACES, "text"), c.agg(F.count("*").alias("n")))
    df = {(r.space, r.term): r.df for r in vocab.collect()}
    want = {r.tid: df[r.space, r.term] for r in asked.collect() if (r.space, r.term) in df}
    words = {term: n for (space, term), n in df.items() if space == "word" and n > 1}
    for rows in got.values():
        assert {r.tid: r.df for r in rows.where("tid is not null and kind < 2").collect()} == want
        named = R.word_vocabulary(rows).collect()
        assert {r.term: r.df for r in named} == words and len(named) == len(words)
    assert got[7].count() > got[1].count()


def test_no_posting_is_shuffled(spark, texts):
    """What is dealt by term is a row a term of a block, and what comes back to blocks has no term."""
    c = spark.createDataFrame([("f", i, "c1", "FDA", t) for i, t in enumerate(texts)], "file string, pdf_index int, chunk_id string, authority string, text string")
    q = spark.createDataFrame([(1, "audit trail", 0)], "qid long, q_aug string, bits int")
    x = R.score_reaching(q, c, SPACES, None, 0.2, R.prior_parts(F.col("authority"), F.col("file"), F.col("text"), ()), F.lit(0), F.lit(False))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "term#" not in plan.partition("FlatMapCoGroupsInArrow")[2].partition("Relation")[0].replace("terms#", "")


def test_ranks_of_few_rows_are_those_of_all(spark):
    rng = random.Random(4)
    rows = [(i % 3, "f", i, "c", rng.choice([0.2, 0.21, 0.5, 0.499, 0.500000000000001, -0.3, 0.7 + i / 10000]), 0.1) for i in range(600)] + [(9, "f", 1, "c", 0.1, 0.1), (None, "f", 1, "c", 0.1, 0.1)]
    x = spark.createDataFrame(rows, "qid long, file string, pdf_index int, chunk_id string, final double, base double")
    for k in (1, 5, 150):
        want = x.withColumn("rank", F.row_number().over(R.ranking(["qid"]))).where(F.col("rank") <= k)
        assert sorted(map(str, R.rank(x, ["qid"], k).collect())) == sorted(map(str, want.collect()))
    few = R.promising(x, ["qid"], 5, {"every": F.lit(True), "low": F.col("final") < 0.3})
    assert few.where(F.array_contains("_rules", "every")).count() < 300
    low = Window.partitionBy("qid").orderBy(F.desc("final"))
    best = x.where("final < 0.3").withColumn("k", F.row_number().over(low)).where("k <= 5").select("qid", "final")
    assert best.exceptAll(few.where(F.array_contains("_rules", "low")).select("qid", "final")).count() == 0


def test_best_similarities_are_those_of_all_forms(spark, texts):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, profile string")
    forms = [(q, v, " ".join(texts[q * 3 + v].split()[: 4 + v])) for q in range(12) for v in range(3)] + [(50, 0, "nowhere"), (51, 0, None)]
    q = spark.createDataFrame(forms, "qid long, variant_no int, q_aug string")
    want = I.search_space(docs, q, I.word_terms, ["doc"], ["qid", "variant_no"], "profile", "q_aug").groupBy("qid", "doc").agg(F.max("sim").alias("sim"))
    values = lambda x: {(r.qid, r.doc): round(r.sim, 9) for r in x.collect()}
    for block in (1024, 5):
        got = R.best_similarities(docs, q, I.word_terms, "doc", "qid", "variant_no", "profile", "q_aug", block=block)
        assert values(got) == values(want) and len(values(got)) == got.count() > 100
