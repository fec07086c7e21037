"""How the query catalogue reads the test tables: lines, pages, chunks and questions, in Spark and in DuckDB SQL.

A document is a file `doc_<id>`; its source gives its authority; five lines make a page; a whole benchmark passage is a
question. Term lists are chosen from words that occur in the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config as C

PAGE_LINES = 5
#: Heading prefixes, requirement stems and the like that the invented prose holds.
PREFIXES = ("of", "an", "es", "die", "les", "en", "in", "er")
STEMS = ("and", "des", "que", "der", "thin", "ent")
SIGNALS = ("the", "and", "des", "de la", "of the")
PATTERNS = ("of", "es", "thein", "enre")
BOILER = ("ndth", "ouen", "adose")
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "der", "die", "el", "le", "des", "que", "on", "er")
LEXICON = {
    "deviations": C.Lexicon(("enther", "andth", "reouou"), ("tion", "ouen", "hehe", "stan"), ("ndea",)),
    "equipment_qualification": C.Lexicon(("thest", "eauai"), ("ing", "ment", "erer"), ("oush",)),
    "data_integrity": C.Lexicon(("hanin", "keit"), ("ent", "sche", "ver", "osa"), ("thshre",)),
    "computerized_systems": C.Lexicon(("blead", "ungen"), ("and", "der", "ere"), ("ationat",)),
    "apr": C.Lexicon(("eren", "ciona"), ("th", "on"), ()),
    "validation": C.Lexicon(("inhe", "ado"), ("ou", "es"), ()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def authority(source: str = "source"):
    n = F.pmod(F.expr(f"cast(substring({source}, 4) as int)"), F.lit(len(C.AUTHORITIES)))
    return F.element_at(F.array(*[F.lit(a) for a in C.AUTHORITIES]), n + 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("file", F.concat(F.lit("doc_"), F.col("doc_id"))).withColumn("authority", authority())


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, authority, line_no, page_no, line)."""
    return line_rows(documents(spark, sf_dir))


def line_rows(docs: DataFrame) -> DataFrame:
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return docs.select("doc_id", "file", "authority", split).withColumn("page_no", F.floor(F.col("line_no") / PAGE_LINES).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_replace("text", r"\s+", " ").alias("question"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DOCS_SQL = f"docs AS (SELECT *, 'doc_' || doc_id AS file, {sql_list(C.AUTHORITIES)}[1 + CAST(substr(source, 4) AS INT) % {len(C.AUTHORITIES)}] AS authority FROM documents)"
LINES_SQL = f"{DOCS_SQL}, lines AS (SELECT *, CAST(line_no // {PAGE_LINES} AS INT) AS page_no FROM (SELECT doc_id, file, authority, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS line_no FROM docs))"
QUESTIONS_SQL = r"questions AS (SELECT item_id AS qid, regexp_replace(text, '\s+', ' ', 'g') AS question FROM benchmark)"


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """An index table, built once per application and input and read from then on."""
    from corpusloom.sources import index_store

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = index_store.scratch(spark)
        build(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
        index_store.released(spark)
    return spark.read.parquet(_STORED[key])
