import json

import pytest

from corpusloom.functions import text
from corpusloom.operators import chunking, evaluation, pages, routing
from corpusloom.operators.replies import normalize_confidence
from corpusloom.sources import files, index_store
from pyspark.sql import functions as F


def test_golden_lines_get_defaults(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text(json.dumps({"id": 7, "question": "q"}) + "\n\n" + json.dumps({"id": "b", "question": "é", "scope": "FDA", "must_include": ["x"], "min_citations": 0, "expected_not_found": True}) + "\n")
    rows = {r.id: r for r in files.golden_cases(spark, str(p)).collect()}
    assert set(rows) == {"7", "b"}
    assert (rows["7"].scope, rows["7"].expected_not_found, rows["7"].must_include, rows["7"].min_citations) == ("MIXED", False, [], 1)
    assert (rows["b"].scope, rows["b"].expected_not_found, rows["b"].must_include, rows["b"].min_citations) == ("FDA", True, ["x"], 0)


def test_csv_round_trip_and_missing_file(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["id", "notes"]).collect() == []
    df = spark.createDataFrame([("a", 'say "x", y\nz'), ("b", "é")], "id string, notes string")
    files.write_csv(df, str(tmp_path / "r"))
    back = files.read_csv(spark, str(tmp_path / "r"), ["id", "notes", "verdict"]).collect()
    assert sorted((r.id, r.notes, r.verdict) for r in back) == [("a", 'say "x", y\nz', None), ("b", "é", None)]


def test_texts_by_case(spark, tmp_path):
    files.write_texts(spark.createDataFrame([("e1", "a\nb")], "id string, text string"), str(tmp_path / "t"))
    assert "".join(f.read_text() for f in (tmp_path / "t" / "id=e1").glob("*.txt")) == "a\nb\n"


def test_confidence_is_normalised(spark):
    rows = spark.createDataFrame([(" HIGH ",), ("medium",), ("low",), ("sure",), (None,)], "v string").select(normalize_confidence(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["High", "Medium", "Low", "Low", "Low"]


def test_baseline_lines_get_defaults(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text(json.dumps({"id": "a", "question": "q", "must_include": ["x"], "max_citations": 2}) + "\n")
    r = files.baseline_cases(spark, str(p)).first()
    assert (r.id, r.domain, r.scope, r.expected_outcome, r.must_include, r.must_not_include, r.min_citations, r.max_citations) == ("a", "", "MIXED", "unknown", ["x"], [], 1, 2)


def test_texts_are_read_back(spark, tmp_path):
    rows = [("e1", "a\nb\n\nc"), ("e.2", "é")]
    files.write_texts(spark.createDataFrame(rows, "id string, text string"), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in files.read_texts(spark, str(tmp_path / "t")).collect()) == sorted(rows)


def test_fingerprint_follows_the_files(spark, tmp_path):
    data = tmp_path / "d"
    (data / "sub").mkdir(parents=True)
    (data / "a.txt").write_text("abc")
    (data / "sub" / "b.txt").write_text("d")
    rows = {r.path.rsplit("/", 1)[1]: r.size for r in files.fingerprint(spark, str(data), "*.txt").collect()}
    assert rows == {"a.txt": 3, "b.txt": 1}
    before = files.digest(files.fingerprint(spark, str(data)))
    assert before == files.digest(files.fingerprint(spark, str(data)))
    (data / "sub" / "b.txt").write_text("de")
    assert before != files.digest(files.fingerprint(spark, str(data)))
    assert files.digest(files.fingerprint(spark, str(tmp_path / "none"))) == "0:0:0"


def test_index_is_built_once_until_its_metadata_or_ids_differ(spark, tmp_path):
    built = []

    def build(chunk_id="p0_c1"):
        built.append(chunk_id)
        return {"chunks": spark.createDataFrame([(0, 1, chunk_id)], "pdf_index int, page int, chunk_id string")}

    path = str(tmp_path / "i")
    for meta, want in (({"v": 1}, 1), ({"v": 1}, 1), ({"v": 2}, 2)):
        rows = index_store.load_or_build(spark, path, meta, build)["chunks"].collect()
        assert [r.chunk_id for r in rows] == ["p0_c1"] and len(built) == want
    index_store.load_or_build(spark, path, {"v": 2}, build, force=True)
    index_store.load_or_build(spark, path, {"v": 3}, lambda: build("p7_c1"))
    index_store.load_or_build(spark, path, {"v": 3}, build)  # the ids of the stored one don't name their pages
    assert len(built) == 5


def test_invalid_verdicts_and_empty_documents_end_the_job(spark):
    rows = spark.createDataFrame([("a", " Partial "), ("b", "strong_correct")], "id string, verdict string")
    assert {r.id: r.verdict for r in evaluation.strict_verdicts(rows).collect()} == {"a": "partial", "b": "strong_correct"}
    with pytest.raises(Exception, match="invalid verdict for id=c"):
        evaluation.strict_verdicts(spark.createDataFrame([("c", "odd")], "id string, verdict string")).collect()
    counts = "file string, n long"
    assert chunking.validated(spark.createDataFrame([("a", 2)], counts)).first().total_chunks == 2
    with pytest.raises(Exception, match="1 documents without chunks"):
        chunking.validated(spark.createDataFrame([("a", 2), ("b", 0)], counts)).collect()
    with pytest.raises(Exception, match="no documents expected"):
        chunking.validated(spark.createDataFrame([], counts)).collect()


def test_trivial_labels_titles_and_paths(spark):
    cases = [(None, 3, True), (["1"], 0, True), (["1"], 2, False), (["1", "page 02", "3"], 3, True), (["1", "ii"], 2, False), (["1", None], 2, False)]
    rows = spark.createDataFrame(cases, "l array<string>, n int, want boolean")
    assert all(r.got == r.want for r in rows.select(pages.labels_trivial(F.col("l"), F.col("n")).alias("got"), "want").collect())
    titles = [("Untitled", "The best line of it", "x.pdf", "The best line of it"), ("A proper title", "b", "x.pdf", "A proper title"), (None, None, "good_name-of.it.pdf", "good name of.it"), ("", "1", "x.pdf", "x.pdf")]
    rows = spark.createDataFrame(titles, "m string, f string, n string, want string")
    assert all(r.got == r.want for r in rows.select(text.citation_title(F.col("m"), F.col("f"), F.col("n")).alias("got"), "want").collect())
    paths = spark.createDataFrame([("A", "b", "x", "b/x"), ("A", "B2", "x", "B2/x"), ("A", "a", "X", "a/X"), ("A", "B", "x", "B/x")], "authority string, folder string, name string, path string")
    assert {(r.authority, r.name): r.path for r in routing.path_map(paths).collect()} == {("A", "x"): "B/x", ("A", "X"): "a/X"}


def test_report_of_no_results_and_of_some(spark, tmp_path):
    schema = "id long, domain string, question string, verdict string, notes string, cited_sources string, domain_used boolean, scope_retry boolean"
    none = evaluation.scorecard_markdown(spark.createDataFrame([], schema), "now").orderBy("part", "pos").collect()
    assert "- partial: 0 (0.0%)" in [r.line for r in none]
    rows = [(1, "d", "q1", "partial", "", "a:1", True, False), (2, "c", "q2", "incorrect", "a Hallucination", "", False, True), (3, "d", "q3", "strong_correct", None, None, None, None)]
    files.write_report(evaluation.scorecard_markdown(spark.createDataFrame(rows, schema), "now"), str(tmp_path / "r"))
    lines = "".join(p.read_text() for p in (tmp_path / "r").glob("*.txt")).split("\n")
    assert "- strong+partial % (target >= 85%): 66.7%" in lines and "- hallucinations count (target = 0): 1" in lines
    assert lines.index("| c | 1 | 0 | 0 | 1 | 0 | 0.0% | 0.0% | 0.0% |") < lines.index("| d | 2 | 1 | 1 | 0 | 0 | 50.0% | 100.0% | 0.0% |")
    assert lines[-3:-1] == ["| 2 | c | q2 |  | false | true |", "| 1 | d | q1 | a:1 | true | false |"]
