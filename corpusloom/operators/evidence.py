"""Evidence rules (phase B): relevance, local filter, requirement gate, coherence, diagnostics.

Facts are rows (qid, pdf, pdf_index, chunk_id, quote, score); a question's text is the column `question`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T

KEY = ["pdf", "pdf_index", "chunk_id"]


def by_score() -> list[Column]:
    return [F.desc("score"), *[F.asc(k) for k in KEY]]


def is_relevant(question: Column, quote: Column, score: Column, pairs: Sequence[tuple[str, tuple[str, ...]]] = (("risk management", ("risk management",)), ("data integrity", ("data integrity", "alcoa"))), floor: float = C.DEFAULT.relevance_floor) -> Column:
    """Two shared tokens, or one with a good score, or a topic named on both sides."""
    shared = F.size(F.array_intersect(T.tokens(question), T.tokens(quote)))
    ql, fl = F.lower(question), F.lower(quote)
    named = F.lit(False)
    for asked, said in pairs:
        named = named | (ql.contains(asked) & T.contains_any(fl, said))
    return (F.size(T.tokens(quote)) > 0) & ((shared >= 2) | ((shared >= 1) & (score >= floor)) | named)


def local_filter(facts: DataFrame, most: int = 8, floor: float = C.DEFAULT.relevance_floor) -> DataFrame:
    """Quotable, relevant facts, the best of each similarity key, at most `most` per question, with `pos`."""
    key = T.similarity_key(F.col("quote"))
    x = facts.where(~T.is_noisy(F.col("quote")) & is_relevant(F.col("question"), F.col("quote"), F.col("score"), floor=floor)).withColumn("_key", key).where("_key <> ''")
    x = x.withColumn("_d", F.row_number().over(Window.partitionBy("qid", "_key").orderBy(*by_score()))).where("_d = 1")
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*by_score())))
    return x.where(F.col("pos") <= most).drop("_key", "_d")


def coherent(question: Column, quote: Column, primary=C.VALIDATION_PRIMARY, secondary=C.VALIDATION_SECONDARY, negative=C.VALIDATION_NEGATIVE, bypass=("investigational medicinal products", "adulteration", "adulterated"), bypass_word: str = "imp") -> Column:
    """No negative phrase (unless the question asks for it) and a primary term or two secondary ones."""
    q, s = T.normalize_query(question), T.collapsed(quote)
    skip = q.rlike(rf"\b{bypass_word}\b") | T.contains_any(q, bypass)
    return (s != "") & (skip | ~T.contains_any(s, negative)) & (T.contains_any(s, primary) | (T.count_terms(s, secondary) >= 2))


def topic_tokens(question: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(T.normalize_query(question), F.lit("[a-z0-9]{3,}"), 0))
    return F.array_except(found, F.array(*[F.lit(x) for x in C.TOPIC_STOP]))


def requirement_gate(filtered: DataFrame, source: DataFrame, gate: Column, boilerplate=C.BOILERPLATE, stems=C.REQUIREMENT_STEMS, coherence: Column | None = None) -> DataFrame:
    """Facts kept by the requirement rules, with `how`.

    source holds all facts of the questions. Kept: requirement-bearing facts that aren't boilerplate (and are
    coherent, behind the gate). Behind the gate, facts of one document alone get the best such fact of another. Where
    nothing is kept, the best coherent fact (gate) or the best topical fact that isn't boilerplate stands in.
    """
    quote = F.col("quote")
    plain, required = ~T.is_boilerplate(quote, boilerplate, stems), T.has_requirement(quote, stems)
    fits = coherent(F.col("question"), quote) if coherence is None else coherence
    good = plain & required & (~gate | fits)
    filtered = filtered.select(source.columns)
    kept = filtered.where(good).withColumn("how", F.lit("kept"))
    docs = kept.groupBy("qid").agg(F.countDistinct("pdf").alias("_docs"), F.first("pdf").alias("_pdf"))
    lone = docs.where("_docs = 1").select("qid", "_pdf")
    best = Window.partitionBy("qid").orderBy(*by_score())
    other = source.where(gate & plain & required & fits).join(lone, "qid").where("pdf <> _pdf").drop("_pdf")
    other = other.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").withColumn("how", F.lit("second source"))
    topical = F.expr("size(_topic) = 0") | F.exists("_topic", lambda t: F.array_contains(T.words(F.regexp_replace(T.collapsed(quote), r"[^\p{L}\p{N}_]+", " ")), t))
    spare = source.withColumn("_topic", topic_tokens(F.col("question"))).where(F.when(gate, plain & required & fits).otherwise(plain & topical)).drop("_topic")
    spare = spare.join(kept.select("qid").distinct(), "qid", "left_anti")
    spare = spare.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").withColumn("how", F.lit("stand-in"))
    return kept.unionByName(other, allowMissingColumns=True).unionByName(spare, allowMissingColumns=True)


def empty_summary(facts: DataFrame, left: DataFrame, boilerplate=C.BOILERPLATE, stems=C.REQUIREMENT_STEMS) -> DataFrame:
    """Why questions ended without evidence: counts of noisy, irrelevant, boilerplate and requirement-free facts."""
    gone = facts.join(left.select("qid").distinct(), "qid", "left_anti")
    quote = F.col("quote")
    return gone.groupBy("qid").agg(
        F.count("*").alias("facts"), F.count_if(T.is_noisy(quote)).alias("noisy"), F.count_if(~is_relevant(F.col("question"), quote, F.col("score"))).alias("irrelevant"),
        F.count_if(T.is_boilerplate(quote, boilerplate, stems)).alias("boilerplate"), F.count_if(~T.has_requirement(quote, stems)).alias("no_requirement"),
    )
