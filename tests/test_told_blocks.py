"""Blocks that know terms by their keys: what they make of texts, what they tell each other, and rows that can't be among the best."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks as B
from corpusloom.operators import index as I
from corpusloom.operators import retrieval as R

SPACES = {"word": I.word_terms, "char": I.char_terms}
ODD = ["", " ", "a", "straße é　日本語 x_y 1½ \x85 q", "the of the cat the\xa0cat sat on-it", "\x00a\x00 b", "naïve" * 3, "one\ttwo\none  two", "²x ³ ⅷ áb"]


@pytest.mark.parametrize("low, high", [(0, 9), (0, 0), (0, 2), (3, 6)])
def test_blocks_make_the_terms_of_the_spaces(spark, low, high):
    texts = ODD[low:high]
    words = B.Words(pa.array(["gone", *texts], pa.string()).slice(1))
    rows = spark.createDataFrame(list(enumerate(texts)), "no int, text string")
    from corpusloom import config as C

    for name, make, terms in (("char", B.windows, I.char_terms), ("word", B.pairs(("the",)), lambda t: I.word_terms(t, ("the",))), ("token", B.letter_tokens(C.SEARCH_STOP), R.search_tokens)):
        found = make(words)
        spelled = found.spell(np.arange(len(found.keys))).to_pylist()
        assert (found.keys[1:] > found.keys[:-1]).all() and len(set(spelled)) == len(spelled)
        got = Counter()
        for row, no, tf in found.slices():
            got.update({(int(r), spelled[n]): int(t) for r, n, t in zip(row, no, tf, strict=True)})
        want = Counter((r.no, r.term) for r in rows.select("no", F.explode(terms(F.col("text"))).alias("term")).collect())
        assert got == want, name
        assert dict(zip(spelled, found.frequencies().tolist(), strict=True)) == Counter(t for _, t in want)


def test_scores_by_keys_are_those_by_terms_and_the_best_stay(spark, monkeypatch):
    rng = random.Random(8)
    words = ["audit", "trail", "of", "records", "Straße", "É", "validation", "a"] + [f"rare{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    c = spark.createDataFrame([(f"f{i % 9}", i, "c1", rng.choice(["FDA", "SOP", None]), text(14)) for i in range(300)] + [("e", 0, "c1", "FDA", "")], "file string, pdf_index int, chunk_id string, authority string, text string")
    q = spark.createDataFrame([(i, text(9), i % 2, "FDA" if i % 3 else "MIXED", [f"f{i % 9}", "e"] if i % 4 else None) for i in range(12)] + [(12, None, 0, None, None)], "qid long, q_aug string, bits int, scope string, _files array<string>")
    parts, hits, wide = R.prior_parts(F.col("authority"), F.col("file"), F.col("text"), ()), F.col("pdf_index") % 4, F.col("qid") % 2 == 0
    vocab = I.space_vocabulary(I.space_counts(c, R.KEY, SPACES, "text"), c.agg(F.count("*").alias("n")))
    rows = lambda x: {(r.qid, r.file, r.pdf_index): tuple(round(r[k], 9) for k in ("sim_word", "sim_char", "overlap", "base", "final")) for r in x.collect()}
    plain = q.drop("_files")
    want = rows(R.score_reaching(plain, c, SPACES, vocab, 0.1, parts, hits, wide))
    monkeypatch.setattr(I, "BLOCK", 64)
    assert len(want) > 500 and rows(R.score_reaching(plain, c, SPACES, None, 0.1, parts, hits, wide, block=32)) == want
    rules = [(True, True, 0.15), (True, False, 0.15), (False, False, 0.2)]
    some = R.score_reaching(q.withColumn("_scope", R.admitted_authorities(F.col("scope"))), c, SPACES, None, 0.1, parts, hits, wide, block=32, best=(3, rules))
    every = R.score_reaching(plain, c, SPACES, vocab, 0.1, parts, hits, wide).join(q.select("qid", "_files"), "qid")
    got = rows(some)
    assert len(got) < len(want) and all(want[k] == v for k, v in got.items())
    for scoped, filed, least in rules:
        x = every.where(F.col("base") >= least)
        x = x.where(R.in_scope(F.col("scope"), F.col("authority"))) if scoped else x
        x = x.where("_files is null or array_contains(_files, file)") if filed else x
        best = x.withColumn("k", F.row_number().over(R.ranking(["qid"]))).where("k <= 3").collect()
        assert best and {(r.qid, r.file, r.pdf_index) for r in best} <= set(got)


def test_told_frequencies_are_those_of_all_rows(spark):
    texts = [f"shared word{i % 5} only{i}" for i in range(40)]
    c = spark.createDataFrame([("f", i, "c1", t) for i, t in enumerate(texts)], "file string, pdf_index int, chunk_id string, text string")
    q = spark.createDataFrame([(1, "shared only7 nowhere")], "qid long, q_aug string")
    asked = R.asked_keys(R.question_terms(q, SPACES)).collect()
    told = R.told(c, 6, spark.createDataFrame(asked, "space string, term long, tid long"), SPACES)
    held = {r.term: r.df for r in B.shared_terms(told).collect()}
    words = Counter(w for t in texts for w in [*re.findall(r"\w+", t), *map(" ".join, zip(t.split(), t.split()[1:], strict=False))])
    key = {w: int(k) for w, k in zip(words, B.string_keys([w for w in words]).view(np.int64), strict=True) if " " not in w}
    assert len(held) == sum(n > 1 for n in words.values()) and all(held.get(k, 1) == words[w] for w, k in key.items())
    df = {r.tid: r.df for r in B.asked_frequencies(told, 3).collect()}
    of = {r.term: df.get(r.tid) for r in asked if r.space == "word"}
    assert [of[int(k)] for k in B.string_keys(["shared", "only7", "nowhere"]).view(np.int64)] == [40, 1, None]


def test_index_rows_of_blocks_are_those_of_the_joins(spark, monkeypatch):
    """Rows of one key are one text, null keys are keys, and nothing but keys and counts is shuffled by term."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices(["audit", "trail", "Straße", "a", "of"] + [f"rare{i}" for i in range(40)], k=12))
    rows = [(f"f{i % 5}" if i % 7 else None, i, "c1" if i % 11 else None, text()) for i in range(90)] + [("e", 0, "c1", ""), ("e", 1, "c1", None)]
    c = spark.createDataFrame(rows + rows[:20] + rows[-2:], "file string, pdf_index int, chunk_id string, text string")
    q = spark.createDataFrame([(i, text()) for i in range(7)] + [(0, "audit again"), (None, "trail"), (8, None), (9, "zzz")], "qid long, q_aug string")
    monkeypatch.setattr(I, "BLOCK", 32)
    n = c.agg(F.count("*").alias("n"))
    plain = lambda x: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect())
    for space, terms in SPACES.items():
        tf = I.counts(c, R.KEY, terms(F.col("text")))
        vocab = I.vocabulary(tf, n)
        assert plain(R.block_vocabulary(c, terms)) == plain(vocab)
        postings = R.block_postings(c, space, terms)
        assert plain(postings) == plain(I.weights(tf, vocab, R.KEY).select(*R.KEY, "term", "weight"))
        assert "hashpartitioning(term" not in postings._jdf.queryExecution().toString()
        sims = plain(I.search_space(c, q, terms, R.KEY, ["qid"], "text", "q_aug"))
        assert len(sims) > 100 and plain(R.cosines(q, c, space, terms, block=32)) == sims
