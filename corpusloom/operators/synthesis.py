"""Extractive synthesis (phase C): sentences of facts, candidates, rendering, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T
from corpusloom.operators.evidence import KEY

REFUSAL = "Not found in provided PDFs"


def clean_sentence(sentence: Column, most: int = 30, acronyms=C.ACRONYM_CASE, patterns=C.HEADING_PATTERNS) -> Column:
    """The sentence as it is quoted, or null where it can't be: trimmed, cased, no heading, not cut off."""
    s = T.capitalize_first(T.normalize_acronyms(T.trim_words(sentence, most), acronyms))
    return T.let(s, lambda x: F.when((x != "") & ~T.looks_like_heading(x, patterns) & ~T.looks_truncated(x) & x.rlike(r"[.;:]$"), x))


def dedupe_key(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(facts: DataFrame, by: list[str], quote: str = "quote", stems=C.REQUIREMENT_STEMS, patterns=C.HEADING_PATTERNS) -> DataFrame:
    """(by, pos, sentence, required): requirement-bearing sentences first, shorter ones first, distinct by letters and digits."""
    x = facts.select(*by, F.posexplode(T.complete_sentences(F.col(quote), patterns)).alias("_at", "_raw"))
    x = x.withColumn("_req", T.has_requirement(F.col("_raw"), stems)).withColumn("_n", F.size(T.words(F.col("_raw"))))
    x = x.withColumn("sentence", clean_sentence(F.col("_raw"), patterns=patterns)).where("sentence is not null").withColumn("_key", dedupe_key(F.col("sentence"))).where("_key <> ''")
    order = [F.desc("_req"), F.asc("_n"), F.asc("_at")]
    x = x.withColumn("_d", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*order))).where("_d = 1")
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return x.select(*by, "pos", "sentence", T.has_requirement(F.col("sentence"), stems).alias("required"))


def select_facts(facts: DataFrame, found: DataFrame, stems=C.REQUIREMENT_STEMS, per_doc: int = 2, most: int = 5) -> DataFrame:
    """Facts with a sentence in `found`: requirement-bearing first, then by score; per document and in all limited; with `fact_pos`."""
    order = [F.desc("_req"), F.desc("score"), *[F.asc(k) for k in KEY]]
    x = facts.where(~T.is_noisy(F.col("quote"))).join(found.select("qid", *KEY).distinct(), ["qid", *KEY], "left_semi")
    x = x.withColumn("_req", T.has_requirement(F.col("quote"), stems))
    x = x.withColumn("_d", F.row_number().over(Window.partitionBy("qid", "pdf").orderBy(*order))).where(F.col("_d") <= per_doc)
    return x.withColumn("fact_pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("fact_pos") <= most).drop("_req", "_d")


def considered(selected: DataFrame, found: DataFrame, domain_ok: Callable[[Column], Column] | None = None, most: int = 5, least_domain: int = 2) -> DataFrame:
    """The sentences that a question's candidates come from, with how many there are, were required and in the domain, and whether the domain decides.

    A fact gives two sentences, a lone fact three. Taking them in order stops at the first required one from the fifth on, or
    before a fact that would begin past the fifth. Questions with a domain (column `domain`) use its sentences when two pass.
    """
    w = Window.partitionBy("qid")
    x = selected.withColumn("_facts", F.count("*").over(w)).join(found, ["qid", *KEY])
    x = x.where(F.col("pos") <= F.when(F.col("_facts") > 1, 2).otherwise(3))
    x = x.withColumn("_i", F.row_number().over(w.orderBy("fact_pos", "pos")))
    stop = F.min(F.when(F.col("required") & (F.col("_i") >= most), F.col("_i"))).over(w)
    first = F.min("_i").over(Window.partitionBy("qid", "fact_pos"))
    x = x.withColumn("_stop", stop).withColumn("_first", first).where((F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop"))) & (F.col("_first") <= most))
    ok = domain_ok(F.col("sentence")) if domain_ok else F.lit(True)
    x = x.withColumn("_dom", F.col("required") & F.col("domain").isNotNull() & ok)
    x = x.withColumn("n_total", F.count("*").over(w)).withColumn("n_required", F.count_if("required").over(w)).withColumn("n_domain", F.count_if("_dom").over(w))
    return x.withColumn("domain_used", F.col("domain").isNotNull() & (F.col("n_domain") >= least_domain))


def domain_stats(sentences: DataFrame) -> DataFrame:
    """(qid, n_total, n_required, n_domain, domain_used) of considered sentences."""
    return sentences.groupBy("qid").agg(*[F.max(c).alias(c) for c in ("n_total", "n_required", "n_domain", "domain_used")])


def candidates(selected: DataFrame, found: DataFrame, domain_ok: Callable[[Column], Column] | None = None, most: int = 5, least_domain: int = 2) -> DataFrame:
    """Numbered candidate sentences per question among those considered: the domain's where it decides, all required ones where
    it has too few, all where a question has no domain."""
    return numbered(considered(selected, found, domain_ok, most, least_domain), most)


def numbered(sentences: DataFrame, most: int = 5) -> DataFrame:
    """The candidates among considered sentences."""
    use = F.when(F.col("domain").isNull(), F.lit(True)).when(F.col("domain_used"), F.col("_dom")).otherwise(F.col("required"))
    order = Window.partitionBy("qid").orderBy("fact_pos", "pos")
    x = sentences.where(use).withColumn("cand", F.row_number().over(order)).where(F.col("cand") <= most)
    line = F.when(F.col("required"), F.concat(F.lit("Requirement: "), F.col("sentence"))).otherwise(F.col("sentence"))
    return x.select("qid", *KEY, "score", "cand", line.alias("line"), "n_required", "n_domain", "domain_used")


def confidence(n: Column, docs: Column, mean: Column) -> Column:
    return F.when((n >= 3) & (docs >= 2) & (mean >= 0.25), "High").when((n >= 2) & (docs >= 1) & (mean >= 0.22), "Medium").otherwise("Low")


def choose_lines(cands: DataFrame, per_doc: int = 2, diversity: int = 2) -> DataFrame:
    """Candidates in answer order with `n`: the first sentence of each of the first two documents, then the rest in order, two
    per document at most. Repeated lines of one chunk count once; questions with fewer than two lines have none."""
    same = Window.partitionBy("qid", *KEY, F.lower("line")).orderBy("cand")
    x = cands.withColumn("_s", F.row_number().over(same)).where("_s = 1")
    x = x.withColumn("_of_doc", F.row_number().over(Window.partitionBy("qid", "pdf").orderBy("cand")))
    firsts = F.row_number().over(Window.partitionBy("qid", F.col("_of_doc") == 1).orderBy("cand"))
    x = x.withColumn("_pass", F.when((F.col("_of_doc") == 1) & (firsts <= diversity), 1).otherwise(2)).where(F.col("_of_doc") <= per_doc)
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("_pass", "cand"))).withColumn("_all", F.count("*").over(Window.partitionBy("qid")))
    return x.where("_all >= 2").drop("_s", "_of_doc", "_pass", "_all")


def render(chosen: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, answer, n_lines, confidence) for every question; those without lines are refused."""
    text = F.format_string("%d) %s (%s | %s | %s)", F.col("n"), "line", "pdf", (F.col("pdf_index") + 1).cast("string"), "chunk_id")
    x = chosen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("_l"), F.countDistinct("pdf").alias("_d"), F.avg("score").alias("_m"))
    label = confidence(F.size("_l"), F.col("_d"), F.col("_m"))
    x = x.select("qid", F.size("_l").alias("n_lines"), label.alias("confidence"), F.concat(F.lit("ANSWER:\n"), F.array_join(F.col("_l")["t"], "\n"), F.lit("\nCONFIDENCE: "), label).alias("answer"))
    return questions.select("qid").join(x, "qid", "left").select("qid", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "confidence")


def dedupe_citations(citations: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first of each cited chunk, in order, at most `most` per question, with `citation`."""
    x = citations.withColumn("_d", F.row_number().over(Window.partitionBy(by, *KEY).orderBy(order))).where("_d = 1")
    return x.withColumn("citation", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("citation") <= most).drop("_d")


def body_lines(answer: Column) -> Column:
    """The numbered sentences of a rendered answer without their number and source; none of a refusal."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda s: F.btrim(s)), lambda s: s.rlike(r"^\d+\)\s+"))
    bare = F.transform(lines, lambda s: F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(s, r"^\d+\)\s*", "")), r"\s+\([^)]+\)\s*$", "")))
    return F.when(answer.startswith("ANSWER:"), bare).otherwise(F.array().cast("array<string>"))


def cited_sentences(answers: DataFrame, cited: DataFrame, by: str = "qid") -> DataFrame:
    """cited (by, citation ...) with `sentence`, the rendered line in the citation's place. Where a repeated citation was dropped, later lines
    stand beside the citation that moved up, and a citation past the last line has an empty sentence; refusals have no rows."""
    lines = answers.select(by, body_lines(F.col("answer")).alias("_l"), F.col("answer").startswith("ANSWER:").alias("_said")).where("_said").drop("_said")
    x = cited.join(lines, by)
    return x.withColumn("sentence", F.coalesce(F.get("_l", F.col("citation") - 1), F.lit(""))).drop("_l")
