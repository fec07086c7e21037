"""Index rows of chunks whose sentences begin with their own position, each against the SQL of the same query."""

import time

import duckdb
import pytest

from corpusloom.plans.catalog import ORACLE_SQL, QUERIES


def sentence(start, word, size):
    """A sentence of `size` characters."""
    body = f"{start} says that {word} " + "longer words go on " * size
    return body[: size - 2].rstrip().ljust(size - 2, "x") + "x."


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rows")
    # Two sentences that together are one character too long for a chunk, and would fit in one without the digit in front.
    tight = sentence("Zero", "alpha", 500) + " " + sentence("1", "omega", 500)
    docs = [(i, text, "en", f"src{i}", len(text)) for i, text in enumerate([tight, tight + " 2.44 beta is there.", "Short alpha. 1 omega."])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "Which alpha says that omega"), (2, "beta 44")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["tfidf_postings", "tfidf_word", "token_overlap", "index_roundtrip"])
def test_rows_are_those_of_the_sql(spark, where, name):
    with duckdb.connect() as con:
        for table in ("documents", "benchmark"):
            con.execute(f"create view {table} as select * from read_parquet('{where}/{table}.parquet/*.parquet')")
        want = con.execute(ORACLE_SQL[name]).fetchall()
    got = QUERIES[name](spark, where).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 3


def test_overlap_lowers_letter_by_letter(spark, tmp_path):
    """A dotted capital is one small letter, in questions and in chunks, and cuts no word."""
    docs = [(i, text, "en", f"src{i}", len(text)) for i, text in enumerate(["The İnstance of GMPİX is here.", "An instance, and gmpix.", "ΟΔΟΣ and K\u212aElvin say OİL."])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "İnstance GMPİX"), (2, "instance oil kkelvin"), (3, "ΣΑΣ oİl stance"), (4, None), (5, "")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as con:
        for table in ("documents", "benchmark"):
            con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = con.execute(ORACLE_SQL["token_overlap"]).fetchall()
    got = QUERIES["token_overlap"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and (1, "doc_0", "p0_c1", 1.0) in want


def test_changes_of_documents_with_a_very_long_line(spark, tmp_path):
    """The last line is cut in time that grows with the text, not with the square of its lines."""
    texts = ["b " * 150_000 + "\nlast", "one line", "", "a\n", "a\n\n", "x\ny", "\n", " \n "]
    spark.createDataFrame([(3 * i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(ORACLE_SQL["index_changes"]).fetchall()
    began = time.monotonic()
    got = QUERIES["index_changes"](spark, str(tmp_path)).collect()
    assert time.monotonic() - began < 30
    assert sorted(map(tuple, got)) == sorted(want) and {status for _, status in want} >= {"changed", "removed", "same"}


def test_boosts_count_a_chunks_signals_once(spark, where):
    """The rows are the SQL's, and no text is searched where rows are joined with the questions."""
    with duckdb.connect() as con:
        for table in ("documents", "benchmark"):
            con.execute(f"create view {table} as select * from read_parquet('{where}/{table}.parquet/*.parquet')")
        want = con.execute(ORACLE_SQL["requirement_boost"]).fetchall()
    rows = QUERIES["requirement_boost"](spark, where)
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr) and len(want) > 3
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join")
    before, _, dealt = below.partition("Repartition")
    assert "regexp" not in above + before and "regexp" in dealt.partition("Relation")[0]
