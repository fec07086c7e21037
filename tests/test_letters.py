"""Sentences and letters at the edges of what the SQL of the same queries says."""

import duckdb

from corpusloom.functions import text as T
from corpusloom.plans.catalog import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


def both(spark, where, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{where}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{where}/documents.parquet/*.parquet')")
        want = con.execute(ORACLE_SQL[name]).fetchall()
    return sorted(map(tuple, QUERIES[name](spark, str(where)).collect()), key=repr), sorted(want, key=repr)


TEXTS = ["Zero. 1 one. 22 and 2 twos are 2. 3 of them 13! 41\n\n ", "\n\tbegins here. \r\nnext one is said there: 1 and many more; 2 and some others.\t", None, "", "We go on with more words 1. 123456 we go on with more words 1; we go on with words as well 20222: 3 we go on with more words 33333. We go on with the last words 4."]


def test_sentences_keep_their_digits_and_lose_their_blanks(spark, tmp_path):
    for name in ("split_sentences", "complete_sentences"):
        got, want = both(spark, tmp_path / name, name, TEXTS)
        assert got == want and len(want) > 3


def test_an_oversize_block_keeps_the_digits_of_its_sentences(spark):
    one = spark.createDataFrame([("a 0. 1 b. 2 c. 3 d 3.",)], "text string").select(T.split_sentences(F.col("text"))).first()[0]
    assert one == ["a 0.", "1 b.", "2 c.", "3 d 3."]


def test_first_letters_have_one_capital(spark, tmp_path):
    letters = [chr(c) for c in (*range(0x41, 0x180), *range(0x386, 0x3FF), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)) if chr(c).isalpha()]
    texts = [*letters, "ΟΔΟΣ ΑΣ.", "xİİ", None, "", "12"]
    got, want = both(spark, tmp_path, "capitalize_first", texts)
    assert got == want
