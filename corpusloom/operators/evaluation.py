"""Evaluation and reporting: case checks, metrics, verdicts, scorecards and diagnoses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

VERDICTS = ("unknown", "strong_correct", "partial", "incorrect", "correct_refusal")


def term_reasons(answer: Column, must: Column, must_not: Column) -> Column:
    """missing:<term> for required terms the answer lacks, forbidden:<term> for barred ones it has; case aside."""
    low = F.lower(answer)
    missing = F.transform(F.filter(must, lambda t: ~F.contains(low, F.lower(t))), lambda t: F.concat(F.lit("missing:"), t))
    barred = F.transform(F.filter(must_not, lambda t: F.contains(low, F.lower(t))), lambda t: F.concat(F.lit("forbidden:"), t))
    return F.concat(missing, barred)


def balance_reason(required: Column, eligible: Column, kept: Column) -> Column:
    """phase_a_balance_missing:<names> where all required authorities were eligible and some weren't kept."""
    lost = F.array_sort(F.array_except(required, kept))
    all_eligible = F.size(F.array_except(required, eligible)) == 0
    return F.when((F.size(required) > 0) & all_eligible & (F.size(lost) > 0), F.concat(F.lit("phase_a_balance_missing:"), F.array_join(lost, ",")))


def run_eval(cases: DataFrame, answers: DataFrame, refusal: str) -> DataFrame:
    """cases (id, expected_not_found, must_include, must_not_include, min_citations) with refused, reasons, ok and outcome.

    answers has (id, answer, n_citations) and may have `balance`, a reason of balance_reason. A case that expects a refusal
    fails as a hallucination, one that doesn't by a refusal, its terms, too few citations or its balance.
    """
    x = cases.join(answers, "id", "left").withColumn("answer", F.coalesce("answer", F.lit(refusal)))
    refused = F.btrim("answer") == refusal
    none = F.array().cast("array<string>")
    cited = F.coalesce("n_citations", F.lit(0))
    made_up = F.array(F.lit("hallucination_expected_refusal"), F.when(cited > 0, "hallucination_with_citations").otherwise("hallucination_without_citations"))
    few = F.when(cited < F.col("min_citations"), F.array(F.lit("few_citations"))).otherwise(none)
    lost = F.when(F.col("balance").isNotNull(), F.array("balance")).otherwise(none) if "balance" in x.columns else none
    checks = F.concat(term_reasons(F.col("answer"), F.col("must_include"), F.col("must_not_include")), few, lost)
    absent = F.col("expected_not_found")
    reasons = F.when(absent & refused, none).when(absent, made_up).when(refused, F.array(F.lit("incorrect_refusal"))).otherwise(checks)
    x = x.withColumn("refused", refused).withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
    failed = F.when(absent, "hallucination").when(refused, "incorrect_refusal").otherwise("pass")
    return x.withColumn("outcome", F.when(F.col("ok"), F.when(absent, "correct_refusal").otherwise("answer_ok")).otherwise(failed))


def rate(hit: Column, of: Column | None = None) -> Column:
    """Share of rows with `hit` among those with `of`; 0 where there are none."""
    of = F.lit(True) if of is None else of
    return F.coalesce(F.count_if(hit & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))


def metrics(results: DataFrame, most_fallback: float = 0.15) -> DataFrame:
    """One row: pass and fallback rates, refusals, and whether the fallback rate of answerable cases fails the gate."""
    answerable = ~F.col("expected_not_found")
    fb = rate(F.col("fallback"), answerable)
    return results.agg(
        F.count("*").alias("cases"), rate(F.col("ok")).alias("pass_rate"), rate(F.col("fallback")).alias("fallback_rate"), fb.alias("fallback_answerable"),
        F.count_if(F.col("refused")).alias("refusals"), (fb > most_fallback).alias("ci_fail"),
    )


#: Fixed value: what a run says when the fallback gate fails.
FALLBACK_ALERT = "Fallback retrieval triggered too often; check embeddings/index changes or similarity calibration."


def result_document(results: DataFrame, integrity: DataFrame, most_fallback: float = 0.15) -> DataFrame:
    """One row with the result document of a run, but for its cases: `index_integrity`, counts, `metrics`, `alerts` and `ci_fail`.

    results are run_eval's rows with `fallback`; integrity is chunking.integrity_report's row.
    """
    absent, refused = F.col("expected_not_found"), F.col("refused")
    fb = rate(F.col("fallback"), ~absent)
    high = fb > most_fallback
    measured = F.struct(
        F.count_if(absent & refused).alias("correct_refusal"), F.count_if(~absent & refused).alias("incorrect_refusal"), F.count_if(absent & ~refused).alias("hallucination"),
        F.count_if(F.col("fallback")).alias("phase_a_fallback_used_count"), rate(F.col("fallback")).alias("phase_a_fallback_used_rate"), fb.alias("fallback_used_rate_answerable"),
    )
    alerts = F.struct(F.lit(most_fallback).alias("fallback_used_rate_answerable_max"), high.alias("fallback_used_rate_answerable_exceeded"), F.when(high, F.lit(FALLBACK_ALERT)).otherwise(F.lit("")).alias("message"))
    run = results.agg(
        F.count("*").alias("count"), F.count_if("ok").alias("passed"), rate(F.col("ok")).alias("pass_rate"), measured.alias("metrics"), alerts.alias("alerts"), high.alias("ci_fail"), F.count_if(~F.col("ok")).alias("failures"),
    )
    checked = integrity.select(F.struct(F.col("total_docs").alias("total_documents"), "total_chunks", F.col("content_hash").alias("index_hash")).alias("index_integrity"))
    return checked.crossJoin(run)  # a row each


def cited_sources(citations: Column) -> Column:
    """Distinct doc:page of an array of (doc, page), in order of first appearance."""
    return F.array_join(F.array_distinct(F.transform(citations, lambda c: F.concat_ws(":", c["doc"], c["page"].cast("string")))), ";")


def short_sources(sources: Column, most: int = 2) -> Column:
    parts = F.filter(F.split(sources, ";"), lambda s: s != "")
    return F.concat(F.array_join(F.slice(parts, 1, most), "; "), F.when(F.size(parts) > most, F.lit("; ...")).otherwise(F.lit("")))


def init_verdicts(results: DataFrame, existing: DataFrame, valid: Sequence[str] = VERDICTS) -> DataFrame:
    """(id, verdict, notes) for every result: the last existing verdict (by `row`), unknown where none or an invalid one."""
    last = existing.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("row")))).where("_k = 1").select("id", "verdict", "notes")
    x = results.select("id").join(last, "id", "left")
    good = F.col("verdict").isin(*valid)
    return x.select("id", F.when(good, F.col("verdict")).otherwise(F.lit("unknown")).alias("verdict"), F.coalesce("notes", F.lit("")).alias("notes"))


def invalid_verdicts(existing: DataFrame, valid: Sequence[str] = VERDICTS) -> DataFrame:
    return existing.where(~F.coalesce(F.col("verdict").isin(*valid), F.lit(False)))


def strict_verdicts(existing: DataFrame, valid: Sequence[str] = VERDICTS) -> DataFrame:
    """The rows again; a verdict that is none of the valid ones ends the job with an error that names its id."""
    v = F.lower(F.btrim(F.coalesce("verdict", F.lit(""))))
    wrong = F.concat(F.lit("invalid verdict for id="), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    return existing.withColumn("verdict", F.when(v.isin(*valid), v).otherwise(F.raise_error(wrong)))


def scorecard(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and percentages of verdicts (id, verdict, notes), in all or by columns."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    pct = lambda c: F.concat(T.fixed(100.0 * c / F.col("total"), 1), F.lit("%"))
    x = joined.groupBy(*by).agg(F.count("*").alias("total"), *counts, F.count_if(F.lower("notes").contains("hallucination")).alias("hallucinations"))
    return x.withColumn("strong_pct", pct(F.col("strong_correct"))).withColumn("useful_pct", pct(F.col("strong_correct") + F.col("partial")))


def worst(joined: DataFrame, order: Sequence[Column], most: int = 10) -> DataFrame:
    """The worst cases, a report of fixed length."""
    return joined.orderBy(*order).limit(most)


def scorecard_markdown(joined: DataFrame, stamp: str) -> DataFrame:
    """(part, pos, line): the report of judged results (id, domain, question, verdict, notes, cited_sources, domain_used, scope_retry).

    Overall figures, a row per domain in order, and the ten worst, incorrect ones first. Written in order by `sources.files.write_report`.
    """
    pct = lambda n: F.when(F.col("total") > 0, F.concat(T.fixed(100.0 * n / F.col("total"), 1), F.lit("%"))).otherwise(F.lit("0.0%"))
    good = F.col("strong_correct") + F.col("partial")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n = lambda c: F.col(c).cast("string")
    counts = [text(f"- {v}: ", n(v), " (", pct(F.col(v)), ")") for v in ("strong_correct", "partial", "incorrect", "correct_refusal", "unknown")]
    head = [F.lit(x) for x in ("# Baseline Scorecard", "", f"Generated: {stamp}", "", "## Overall metrics")]
    rest = [text("- strong+partial % (target >= 85%): ", pct(good)), text("- strong % (target >= 75%): ", pct(F.col("strong_correct"))), text("- hallucinations count (target = 0): ", n("hallucinations"))]
    titles = ("", "## By-domain table", "", "| domain | total | strong | partial | incorrect | correct_refusal | strong% | strong+partial% | refusal% |", "|---|---:|---:|---:|---:|---:|---:|---:|---:|")
    lines = F.array(*head, text("- total: ", n("total")), *counts, *rest, *[F.lit(x) for x in titles])
    overall = scorecard(joined).select(F.lit(1).alias("part"), F.posexplode(lines).alias("pos", "line"))
    row = lambda *cells: text("| ", *[c for cell in cells for c in (cell, " | ")][:-1], " |")
    each = row(F.col("domain"), *[n(c) for c in ("total", "strong_correct", "partial", "incorrect", "correct_refusal")], pct(F.col("strong_correct")), pct(good), pct(F.col("correct_refusal")))
    nth = F.row_number().over(Window.orderBy("domain")) - 1  # one row per domain, already counted
    domains = scorecard(joined.fillna("", ["domain"]), ["domain"]).select(F.lit(2).alias("part"), nth.alias("pos"), each.alias("line"))
    spark = joined.sparkSession
    titles = ["", "## Worst 10", "", "| id | domain | question | cited_sources | domain_filter_used | empty_scope_retry_used |", "|---|---|---|---|---|---|"]
    above = spark.createDataFrame([(3, i, x) for i, x in enumerate(titles)], "part int, pos int, line string")
    order = [F.when(F.col("verdict") == "incorrect", 0).otherwise(1), F.col("id").cast("string")]
    ten = worst(joined.where("verdict in ('incorrect', 'partial')"), order)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "domain", "question", "cited_sources", "domain_used", "scope_retry")]
    last = ten.select(F.lit(4).alias("part"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("pos"), row(*cells).alias("line"))
    return overall.unionByName(domains).unionByName(above).unionByName(last)


def partial_stats(partials: DataFrame, framework: Sequence[str], least: int = 2) -> DataFrame:
    """One row over partial results: counts, exact medians and the share of framework questions."""
    asks = T.contains_any(F.lower("question"), tuple(framework))
    return partials.agg(
        F.count("*").alias("partials"), F.count_if("domain_filter_used").alias("filtered"), F.count_if(F.col("n_domain") >= least).alias("enough_domain"),
        F.median("n_total").alias("median_total"), F.median("n_domain").alias("median_domain"), F.round(rate(asks), 6).alias("framework_rate"),
    )


def parse_answer(text: Column) -> Column:
    """(answer, confidence, citations) of a rendered output file."""
    citations = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?s)Citations:\n(.*)$", 1), "\n"), lambda c: F.regexp_replace(F.btrim(c), r"^-\s*", "")), lambda c: c != "")
    return F.struct(
        F.btrim(F.regexp_extract(text, r"(?s)ANSWER:\n(.*?)(?:\nCONFIDENCE:|$)", 1)).alias("answer"), F.regexp_extract(text, r"CONFIDENCE:\s*(\w+)", 1).alias("confidence"), citations.alias("citations"),
    )


def answer_lines(text: Column, most: int = 5) -> Column:
    """The numbered sentences of a rendered answer, numbers and trailing citation taken off."""
    numbered = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\d+\)\s+"))
    return F.slice(F.transform(numbered, lambda s: F.btrim(F.regexp_replace(F.regexp_replace(s, r"^\s*\d+\)\s+", ""), r"\s*\([^)]+\)\s*$", ""))), 1, most)


def extract_json(raw: Column) -> Column:
    """The text from the first brace to the last, where it parses as an object."""
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(found, "$").isNotNull() & (found != ""), found)


def safe_id(case_id: Column) -> Column:
    return F.regexp_replace(case_id, "[^A-Za-z0-9._-]+", "_")
