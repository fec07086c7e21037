"""Evaluation queries; questions stand for golden cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as V
from corpusloom.operators import retrieval as R
from corpusloom.operators import synthesis as S
from corpusloom.operators.synthesis import REFUSAL
from corpusloom.plans.fixtures import DOCS_SQL, QUESTIONS_SQL, documents, questions, sql_list, table
from corpusloom.plans.phase_plans import _ANSWER, answers, lines_chosen
from corpusloom.plans.registry import query
from corpusloom.plans.search_plans import _BALANCE, _SLOTS, balanced, gathered

_MUST = "CASE qid % 3 WHEN 0 THEN ['the', 'Requirement'] WHEN 1 THEN ['Confidence', 'zzz'] ELSE CAST([] AS VARCHAR[]) END"
_NOT = "CASE qid % 4 WHEN 0 THEN ['Tion'] ELSE CAST([] AS VARCHAR[]) END"


def s_reasons(cited: str) -> str:
    """The reasons against a case; columns answer, refused, expected_not_found, must, mustnot and min_citations."""
    terms = "list_transform(list_filter(must, lambda t: NOT contains(lower(answer), lower(t))), lambda t: 'missing:' || t) || list_transform(list_filter(mustnot, lambda t: contains(lower(answer), lower(t))), lambda t: 'forbidden:' || t)"
    made_up = f"['hallucination_expected_refusal', CASE WHEN {cited} > 0 THEN 'hallucination_with_citations' ELSE 'hallucination_without_citations' END]"
    few = f"CASE WHEN {cited} < min_citations THEN ['few_citations'] ELSE CAST([] AS VARCHAR[]) END"
    return f"CASE WHEN expected_not_found AND refused THEN CAST([] AS VARCHAR[]) WHEN expected_not_found THEN {made_up} WHEN refused THEN ['incorrect_refusal'] ELSE {terms} || {few} END"


_CASES = f"""{_ANSWER}, cases AS (SELECT qid AS id, qid % 5 = 0 AS expected_not_found, {_MUST} AS must, {_NOT} AS mustnot, CASE WHEN qid % 2 = 0 THEN 1 ELSE 4 END AS min_citations FROM questions),
rr AS (SELECT cases.*, answer, n_lines AS n_citations, trim(answer) = '{REFUSAL}' AS refused FROM cases JOIN ans ON ans.qid = cases.id),
ev AS (SELECT *, {s_reasons('n_citations')} AS reasons FROM rr)"""


def evaluated(spark, d, replies=None):
    """Cases with their checks; `replies` (id, answer, n_citations) default to the answers from all facts."""
    cases = questions(spark, d).selectExpr(
        "qid as id", "qid % 5 = 0 as expected_not_found", "case qid % 3 when 0 then array('the', 'Requirement') when 1 then array('Confidence', 'zzz') else cast(array() as array<string>) end as must_include",
        "case qid % 4 when 0 then array('Tion') else cast(array() as array<string>) end as must_not_include", "case when qid % 2 = 0 then 1 else 4 end as min_citations",
    )
    if replies is None:
        replies = answers(spark, d).select(F.col("qid").alias("id"), "answer", F.col("n_lines").alias("n_citations"))
    return V.run_eval(cases, replies, REFUSAL)


_OUTCOME = "CASE WHEN len(reasons) = 0 THEN CASE WHEN expected_not_found THEN 'correct_refusal' ELSE 'answer_ok' END WHEN expected_not_found THEN 'hallucination' WHEN refused THEN 'incorrect_refusal' ELSE 'pass' END"


@query("run_eval", f"{_CASES} SELECT id, refused, len(reasons) = 0 AS ok, {_OUTCOME} AS outcome, array_to_string(reasons, ';') AS reasons FROM ev")
def run_eval(spark, d):
    return evaluated(spark, d).select("id", "refused", "ok", "outcome", F.array_join("reasons", ";").alias("reasons"))


@query("term_checks", f"{_CASES} SELECT id, array_to_string(list_concat(list_transform(list_filter(must, lambda t: NOT contains(lower(answer), lower(t))), lambda t: 'missing:' || t), list_transform(list_filter(mustnot, lambda t: contains(lower(answer), lower(t))), lambda t: 'forbidden:' || t)), ';') AS reasons FROM ev")
def term_checks(spark, d):
    x = evaluated(spark, d)
    return x.select("id", F.array_join(V.term_reasons(F.col("answer"), F.col("must_include"), F.col("must_not_include")), ";").alias("reasons"))


@query("eval_metrics", f"{_CASES} SELECT count(*) AS cases, count(*) FILTER (WHERE len(reasons) = 0) / CAST(count(*) AS DOUBLE) AS pass_rate, count(*) FILTER (WHERE fallback) / CAST(count(*) AS DOUBLE) AS fallback_rate, count(*) FILTER (WHERE fallback AND NOT expected_not_found) / CAST(count(*) FILTER (WHERE NOT expected_not_found) AS DOUBLE) AS fallback_answerable, count(*) FILTER (WHERE refused) AS refusals, count(*) FILTER (WHERE fallback AND NOT expected_not_found) / CAST(count(*) FILTER (WHERE NOT expected_not_found) AS DOUBLE) > 0.15 AS ci_fail FROM (SELECT *, id IN (SELECT qid FROM bi WHERE fallback) AS fallback FROM ev)")
def eval_metrics(spark, d):
    used = gathered(spark, d).where("fallback").select(F.col("qid").alias("id")).distinct().withColumn("fallback", F.lit(True))
    return V.metrics(evaluated(spark, d).join(used, "id", "left").withColumn("fallback", F.coalesce("fallback", F.lit(False))))


@query("balance_gate", f"""{_BALANCE}, sl AS ({_SLOTS}), b AS (SELECT qid, ['EU_GMP', 'FDA'] AS required, coalesce((SELECT list(authority) FROM sl WHERE sl.qid = questions.qid AND eligible), []) AS eligible, coalesce((SELECT list(DISTINCT authority) FROM bal WHERE bal.qid = questions.qid), []) AS kept FROM questions)
SELECT qid, CASE WHEN len(list_filter(required, lambda r: NOT list_contains(eligible, r))) = 0 AND len(list_filter(required, lambda r: NOT list_contains(kept, r))) > 0 THEN 'phase_a_balance_missing:' || array_to_string(list_sort(list_filter(required, lambda r: NOT list_contains(kept, r))), ',') END AS reason FROM b""")
def balance_gate(spark, d):
    """Each question's eligible authorities and those kept, against the two that a case requires."""
    able = R.slots(gathered(spark, d)).where("eligible").groupBy("qid").agg(F.collect_set("authority").alias("eligible"))
    kept = balanced(spark, d).groupBy("qid").agg(F.collect_set("authority").alias("kept"))
    none = F.array().cast("array<string>")
    x = questions(spark, d).select("qid").join(able, "qid", "left").join(kept, "qid", "left")
    return x.select("qid", V.balance_reason(F.array(F.lit("EU_GMP"), F.lit("FDA")), F.coalesce("eligible", none), F.coalesce("kept", none)).alias("reason"))


def outputs(spark, d):
    """Rendered output files of all questions, with the citations of their answers."""
    cited = S.dedupe_citations(lines_chosen(spark, d), "qid", "n", 5)
    row = F.struct("citation", F.format_string("- %s | p%s | %s", "pdf", (F.col("pdf_index") + 1).cast("string"), "chunk_id").alias("c"))
    lists = cited.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(row))["c"], "\n").alias("c"))
    text = F.concat("answer", F.lit("\n\nCitations:\n"), F.coalesce("c", F.lit("")))
    return answers(spark, d).join(lists, "qid", "left").select("qid", text.alias("text"))


_OUT = f"{_ANSWER}, cd AS (SELECT *, row_number() OVER (PARTITION BY qid, pdf, pdf_index, chunk_id ORDER BY n) AS dd FROM chosen), cc AS (SELECT qid, string_agg('- ' || pdf || ' | p' || (pdf_index + 1) || ' | ' || chunk_id, chr(10) ORDER BY n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS nth FROM cd WHERE dd = 1) WHERE nth <= 5 GROUP BY qid), outf AS (SELECT qid, answer || chr(10) || chr(10) || 'Citations:' || chr(10) || coalesce(c, '') AS text FROM ans LEFT JOIN cc USING (qid))"


@query("render_output_file", f"{_OUT} SELECT qid, text FROM outf")
def render_output_file(spark, d):
    return outputs(spark, d)


@query("parse_answer_text", f"{_OUT} SELECT qid, trim(regexp_extract(text, '(?s)ANSWER:\\n(.*?)(?:\\nCONFIDENCE:|$)', 1)) AS answer, regexp_extract(text, 'CONFIDENCE:\\s*(\\w+)', 1) AS confidence, list_transform(list_filter(string_split(regexp_extract(text, '(?s)Citations:\\n(.*)$', 1), chr(10)), lambda c: c <> ''), lambda c: regexp_replace(trim(c), '^-\\s*', '')) AS citations FROM outf")
def parse_answer_text(spark, d):
    return outputs(spark, d).select("qid", V.parse_answer(F.col("text")).alias("p")).select("qid", "p.*")


@query("parse_answer_sentences", f"{_OUT} SELECT qid, list_transform(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^\\s*\\d+\\)\\s+')), lambda s: trim(regexp_replace(regexp_replace(s, '^\\s*\\d+\\)\\s+', ''), '\\s*\\([^)]+\\)\\s*$', '')))[1:5] AS sentences FROM outf")
def parse_answer_sentences(spark, d):
    return outputs(spark, d).select("qid", V.answer_lines(F.col("text")).alias("sentences"))


_JSON = "CASE event_id % 4 WHEN 0 THEN 'noise ' || props || ' tail' WHEN 1 THEN '{broken ' || event_type ELSE props END"


@query("extract_json", f"WITH j AS (SELECT event_id, regexp_extract({_JSON}, '(?s)(\\{{.*\\}})', 1) AS o FROM events) SELECT event_id, CASE WHEN o <> '' AND json_valid(o) THEN o END AS json FROM j")
def extract_json(spark, d):
    raw = F.expr("case event_id % 4 when 0 then concat('noise ', props, ' tail') when 1 then concat('{broken ', event_type) else props end")
    return table(spark, d, "events").select("event_id", V.extract_json(raw).alias("json"))


@query("validate_facts", f"""WITH {DOCS_SQL}, src AS (SELECT doc_id % 50 AS qid, file AS pdf, CAST(n_chars % 4 AS INT) AS pdf_index, 'c' || doc_id % 3 AS chunk_id, n_chars / 100.0::DOUBLE AS score, doc_id FROM docs), rep AS (SELECT (doc_id % 50) AS qid, file AS pdf, CAST(n_chars % 4 AS INT) + (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END) AS page, 'c' || doc_id % 3 AS chunk_id FROM docs)
SELECT DISTINCT src.qid, src.pdf, src.pdf_index, src.chunk_id, round(score, 6) AS score FROM rep JOIN src ON src.qid = rep.qid AND src.pdf = rep.pdf AND src.pdf_index = rep.page - 1 AND src.chunk_id = rep.chunk_id""")
def validate_facts(spark, d):
    from corpusloom.operators import replies as L

    x = documents(spark, d)
    key = [(F.col("doc_id") % 50).alias("qid"), F.col("file").alias("pdf")]
    chunk = F.concat(F.lit("c"), F.col("doc_id") % 3).alias("chunk_id")
    source = x.select(*key, F.expr("cast(n_chars % 4 as int)").alias("pdf_index"), chunk, (F.col("n_chars") / 100.0).alias("score"))
    reply = x.select(*key, F.expr("cast(n_chars % 4 as int) + case when doc_id % 2 = 0 then 1 else 2 end").alias("page"), chunk)
    return L.validate_facts(reply, source).select("qid", "pdf", "pdf_index", "chunk_id", F.round("score", 6).alias("score"))


@query("quote_dump")
def quote_dump(spark, d):
    from corpusloom.operators import replies as L

    # Each turn against the one before it in its conversation.
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    x = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), prev.alias("b")).where("b is not null")
    return x.select("conv_id", "turn", L.is_quote_dump(F.col("a"), F.col("b")).alias("dump"))


@query("validate_synthesis")
def validate_synthesis(spark, d):
    from corpusloom.operators import replies as L
    from corpusloom.plans.phase_plans import facts, lines_chosen

    reply = lines_chosen(spark, d).select("qid", "n", F.regexp_replace("line", "^Requirement: ", "").alias("sentence"), "pdf", (F.col("pdf_index") + 1).alias("page"), "chunk_id")
    return L.validate_synthesis(reply, facts(spark, d)).select("qid", "n", "sentence", "pdf", "chunk_id")


