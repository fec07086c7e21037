"""Queries read whole lines and texts."""

from pyspark.sql import functions as F

from corpusloom.plans.catalog import QUERIES


def saved(spark, where, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{where}/{name}.parquet")
    return str(where)


def test_repeated_lines_count_whole_lines(spark, tmp_path):
    pages = ["\n".join(["The same header", *[f"the line {w} of page {p}" for w in "abcd"]]) for p in ("one", "two", "three")]
    d = saved(spark, tmp_path, "documents", [(1, "\n".join(pages), "src0")], "doc_id long, text string, source string")
    assert [(r.key, r.df, r.pages) for r in QUERIES["repeated_lines"](spark, d).collect()] == [("the same header", 3, 3)]


def test_quote_dump_compares_whole_turns(spark, tmp_path):
    same = " ".join(f"begin{i:02d}" for i in range(80))
    rest = ["".join(chr(97 + (i * k) % 26) for i in range(1500)) for k in (3, 7)]
    rows = [(1, 0, same + rest[0]), (1, 1, same + rest[1]), (2, 0, "x" * 420 + " " + rest[0]), (2, 1, "y" * 420 + " " + rest[0] + rest[0])]
    rows += [(3, 0, "".join(chr(97 + i % 26) for i in range(199))), (3, 1, "".join(chr(97 + i % 26) for i in range(199)))]
    d = saved(spark, tmp_path, "conversations", rows, "conv_id int, turn int, text string")
    assert {r.conv_id: r.dump for r in QUERIES["quote_dump"](spark, d).collect()} == {1: False, 2: False, 3: True}


def test_case_questions_and_lines_are_whole(spark, small):
    from corpusloom.plans.eval_plans import results

    most = spark.read.parquet(f"{small}/documents.parquet").agg(F.max(F.length("text"))).first()[0]
    assert most > 60 and results(spark, small).agg(F.max(F.length("question"))).first()[0] == most
    assert QUERIES["capitalize_first"](spark, small).agg(F.max(F.length("line"))).first()[0] >= most
