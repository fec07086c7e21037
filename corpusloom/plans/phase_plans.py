"""Evidence and synthesis queries over retrieved facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import query as Q
from corpusloom.functions import text as T
from corpusloom.operators import evidence as E
from corpusloom.operators import synthesis as S
from corpusloom.plans.fixtures import BOILER, LEXICON, PATTERNS, STEMS, questions, sql_list, stored
from corpusloom.plans.query_plans import VALID, s_count, s_normalize
from corpusloom.plans.registry import query
from corpusloom.plans.search_plans import _BALANCE, balanced, domains, gathered, with_text
from corpusloom.plans.text_plans import S_TRUNCATED, s_any, s_clean, s_collapsed, s_complete, s_match, s_requirement, s_tokens

PRIMARY, SECONDARY, NEGATIVE = ("enther", "eauai"), ("thest", "ing", "ment", "keit"), ("ndea",)


def facts(spark, d):
    """A question's facts: the balanced chunks of its searches, scored by their final score."""
    return stored(spark, d, "facts", build_facts)


def build_facts(spark, d):
    kept = with_text(spark, d, balanced(spark, d)).join(questions(spark, d), "qid")
    return kept.select("qid", "question", F.col("file").alias("pdf"), "pdf_index", "chunk_id", F.col("text").alias("quote"), F.round("final", 6).alias("score"))


_FACTS = f"{_BALANCE}, facts AS MATERIALIZED (SELECT qid, question, file AS pdf, pdf_index, chunk_id, text AS quote, round(final, 6) AS score FROM bal JOIN (SELECT file, pdf_index, chunk_id, text FROM chunks) USING (file, pdf_index, chunk_id) JOIN questions USING (qid))"
_ORD = "score DESC, pdf, pdf_index, chunk_id"
_REL = f"(len({s_tokens('quote')}) > 0 AND (len(list_intersect({s_tokens('question')}, {s_tokens('quote')})) >= 2 OR (len(list_intersect({s_tokens('question')}, {s_tokens('quote')})) >= 1 AND score >= 0.28) OR (contains(lower(question), 'risk management') AND contains(lower(quote), 'risk management')) OR (contains(lower(question), 'data integrity') AND {s_any('lower(quote)', ('data integrity', 'alcoa'))})))"
_NOISY = f"(lower({s_clean('quote')}) = '' OR {s_match(f'lower({s_clean("quote")})', T.DIAGRAM)} OR length({s_clean('quote')}) < 35)"
_KEY = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({s_clean('quote')}), '\\b\\d+\\b', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_BOIL = f"({s_collapsed('quote')} = '' OR {s_any(s_collapsed('quote'), BOILER)} OR (len(string_split({s_collapsed('quote')}, ' ')) <= 12 AND {s_any(s_collapsed('quote'), ('guidance', 'guideline'))} AND NOT {s_requirement('quote')}))"
_REQ = s_requirement("quote")
_COH = f"({s_collapsed('quote')} <> '' AND (regexp_matches({s_normalize('question')}, '\\bimp\\b') OR contains({s_normalize('question')}, 'oush') OR NOT {s_any(s_collapsed('quote'), NEGATIVE)}) AND ({s_any(s_collapsed('quote'), PRIMARY)} OR {s_count(s_collapsed('quote'), SECONDARY)} >= 2))"
_LOCAL = f"{_FACTS}, l1 AS (SELECT *, {_KEY} AS key FROM facts WHERE NOT {_NOISY} AND {_REL}), l2 AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY {_ORD}) AS dd FROM l1 WHERE key <> ''), loc AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_ORD}) AS INT) AS pos FROM l2 WHERE dd = 1) WHERE pos <= 8)"


def coherence():
    return E.coherent(F.col("question"), F.col("quote"), PRIMARY, SECONDARY, NEGATIVE, bypass=("oush",))


@query("relevance_filter", f"{_FACTS} SELECT qid, pdf, chunk_id, {_REL} AS relevant FROM facts")
def relevance_filter(spark, d):
    return facts(spark, d).select("qid", "pdf", "chunk_id", E.is_relevant(F.col("question"), F.col("quote"), F.col("score")).alias("relevant"))


@query("phase_b_filter", f"{_LOCAL} SELECT qid, pdf, chunk_id, pos FROM loc")
def phase_b_filter(spark, d):
    return E.local_filter(facts(spark, d)).select("qid", "pdf", "chunk_id", "pos")


@query("topic_coherence", f"{_FACTS} SELECT qid, pdf, chunk_id, {_COH} AS coherent FROM facts")
def topic_coherence(spark, d):
    return facts(spark, d).select("qid", "pdf", "chunk_id", coherence().alias("coherent"))


_TOPIC = f"list_filter(list_distinct(regexp_extract_all({s_normalize('question')}, '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({sql_list(C.TOPIC_STOP)}, x))"
_WORDS = f"string_split(regexp_replace({s_collapsed('quote')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"
_ACTIVE = s_any(s_normalize("question"), VALID)
_GATE = f"""{_LOCAL}, kp AS (SELECT qid, pdf, pdf_index, chunk_id, score FROM loc WHERE NOT {_BOIL} AND {_REQ} AND (NOT {_ACTIVE} OR {_COH})),
lone AS (SELECT qid, any_value(pdf) AS only_pdf FROM kp GROUP BY qid HAVING count(DISTINCT pdf) = 1),
oth AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY {_ORD}) AS k FROM facts f JOIN lone USING (qid) WHERE pdf <> only_pdf AND {_ACTIVE} AND NOT {_BOIL} AND {_REQ} AND {_COH}) WHERE k = 1),
spa AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY {_ORD}) AS k FROM facts f WHERE qid NOT IN (SELECT qid FROM kp) AND CASE WHEN {_ACTIVE} THEN NOT {_BOIL} AND {_REQ} AND {_COH} ELSE NOT {_BOIL} AND (len({_TOPIC}) = 0 OR len(list_intersect({_TOPIC}, {_WORDS})) > 0) END) WHERE k = 1),
gt AS (SELECT qid, pdf, pdf_index, chunk_id, score, 'kept' AS how FROM kp UNION ALL SELECT qid, pdf, pdf_index, chunk_id, score, 'second source' FROM oth UNION ALL SELECT qid, pdf, pdf_index, chunk_id, score, 'stand-in' FROM spa)"""


def active():
    """Whether the stricter gate holds: the question names what validation questions do."""
    return T.contains_any(T.normalize_query(F.col("question")), VALID)


def gated(spark, d):
    f = facts(spark, d)
    return E.requirement_gate(E.local_filter(f), f, active(), BOILER, STEMS, coherence())


@query("requirement_filter", f"{_GATE} SELECT qid, pdf, chunk_id, how FROM gt")
def requirement_filter(spark, d):
    return gated(spark, d).select("qid", "pdf", "chunk_id", "how")


@query("phase_b_empty_summary", f"{_GATE} SELECT qid, count(*) AS facts, count(*) FILTER (WHERE {_NOISY}) AS noisy, count(*) FILTER (WHERE NOT {_REL}) AS irrelevant, count(*) FILTER (WHERE {_BOIL}) AS boilerplate, count(*) FILTER (WHERE NOT {_REQ}) AS no_requirement FROM facts WHERE qid NOT IN (SELECT qid FROM gt) GROUP BY qid")
def phase_b_empty_summary(spark, d):
    return E.empty_summary(facts(spark, d), gated(spark, d), BOILER, STEMS)


# Sentences. The tables hold none of the acronyms that the default list spells in capitals, so the SQL leaves that rule out.

def _s_caps(x: str) -> str:
    return f"regexp_extract({x}, '(?s)^([^\\p{{L}}]*)', 1) || upper(regexp_extract({x}, '(?s)^[^\\p{{L}}]*(\\p{{L}})', 1)) || regexp_extract({x}, '(?s)^[^\\p{{L}}]*\\p{{L}}(.*)$', 1)"


_W = "list_filter(string_split(regexp_replace(raw, '[\\s\\p{Z}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_STOP = sql_list(C.TRAILING_STOP)
_SENT = f"""se0 AS (SELECT qid, pdf, pdf_index, chunk_id, unnest({s_complete('quote')}) AS raw, unnest(range(0, len({s_complete('quote')}))) AS ix FROM facts),
se1 AS (SELECT *, {_W} AS w FROM se0), se2 AS (SELECT *, w[1:30] AS head, list_transform(w[1:30], lambda x: NOT list_contains({_STOP}, lower(trim(x, '.,;:')))) AS good FROM se1),
se3 AS (SELECT *, head[1:len(good) - coalesce(list_position(list_reverse(good), true) - 1, len(good))] AS kept FROM se2),
se4 AS (SELECT *, CASE WHEN len(w) <= 30 THEN array_to_string(w, ' ') WHEN len(kept) < 4 THEN '' WHEN regexp_matches(kept[len(kept)], '[.;:]$') THEN array_to_string(kept, ' ') ELSE array_to_string(kept, ' ') || '.' END AS tr FROM se3),
se5 AS (SELECT *, {_s_caps('tr')} AS sentence FROM se4 WHERE tr <> ''),
se6 AS (SELECT *, lower(trim(sentence)) AS ls, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS key, {s_requirement('raw')} AS req FROM se5 WHERE regexp_matches(sentence, '[.;:]$')),
se7 AS (SELECT *, row_number() OVER (PARTITION BY qid, pdf, pdf_index, chunk_id, key ORDER BY req DESC, len(w), ix) AS dd FROM se6 WHERE key <> '' AND NOT {s_match('ls', S_TRUNCATED)} AND NOT ends_with(ls, 'with a.') AND NOT ends_with(ls, 'and .') AND NOT HEADING),
sent AS (SELECT qid, pdf, pdf_index, chunk_id, sentence, {s_requirement('sentence')} AS required, CAST(row_number() OVER (PARTITION BY qid, pdf, pdf_index, chunk_id ORDER BY req DESC, len(w), ix) AS INT) AS pos FROM se7 WHERE dd = 1)"""


def _with_heading(sql: str) -> str:
    from corpusloom.plans.text_plans import s_heading_text

    return sql.replace("HEADING", s_heading_text("sentence", PATTERNS))


_SENTS = f"{_FACTS}, {_with_heading(_SENT)}"


def found(spark, d):
    return stored(spark, d, "sentences", lambda spark, d: S.sentences(facts(spark, d), ["qid", *E.KEY], "quote", STEMS, PATTERNS))


@query("extract_sentences", f"{_SENTS} SELECT qid, pdf, chunk_id, pos, sentence, required FROM sent")
def extract_sentences(spark, d):
    return found(spark, d).select("qid", "pdf", "chunk_id", "pos", "sentence", "required")


def s_pass(x: str) -> str:
    s = s_collapsed(x)
    each = " ".join(f"WHEN '{name}' THEN {_s_pass(s, lex)}" for name, lex in LEXICON.items())
    return f"coalesce(CASE domain {each} END, false)"


def _s_pass(s: str, lex) -> str:
    return f"({s} <> '' AND {s_count(s, lex.negative)} = 0 AND ({s_count(s, lex.strong)} >= {lex.min_strong} OR {s_count(s, lex.secondary)} >= {lex.min_secondary}))"


def passes(sentence):
    """Whether a sentence passes the lexicon of its question's domain."""
    ok = F.lit(False)
    for name, lex in LEXICON.items():
        ok = ok | ((F.col("domain") == name) & Q.passes(sentence, lex))
    return F.coalesce(ok, F.lit(False))


@query("domain_sentence_filter", f"{_SENTS} SELECT qid, pdf, chunk_id, pos, {s_pass('sentence')} AS passes FROM sent JOIN dm USING (qid)")
def domain_sentence_filter(spark, d):
    return found(spark, d).join(domains(spark, d), "qid").select("qid", "pdf", "chunk_id", "pos", passes(F.col("sentence")).alias("passes"))


_SEL = f"""{_SENTS}, sf0 AS (SELECT f.*, {_REQ} AS rq FROM facts f WHERE NOT {_NOISY} AND EXISTS (SELECT 1 FROM sent s WHERE s.qid = f.qid AND s.pdf = f.pdf AND s.pdf_index = f.pdf_index AND s.chunk_id = f.chunk_id)),
sf1 AS (SELECT *, row_number() OVER (PARTITION BY qid, pdf ORDER BY rq DESC, {_ORD}) AS dd FROM sf0), sf AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rq DESC, {_ORD}) AS INT) AS fact_pos FROM sf1 WHERE dd <= 2) WHERE fact_pos <= 5)"""


def chosen_facts(spark, d):
    return S.select_facts(facts(spark, d), found(spark, d), STEMS)


@query("select_facts", f"{_SEL} SELECT qid, pdf, chunk_id, fact_pos FROM sf")
def select_facts(spark, d):
    return chosen_facts(spark, d).select("qid", "pdf", "chunk_id", "fact_pos")


_CAND = f"""{_SEL}, cn0 AS (SELECT sf.qid, sf.pdf, sf.pdf_index, sf.chunk_id, sf.score, fact_pos, pos, sentence, required, (SELECT domain FROM dm WHERE dm.qid = sf.qid) AS domain, count(*) OVER () AS z FROM sf JOIN sent USING (qid, pdf, pdf_index, chunk_id) WHERE pos <= CASE WHEN (SELECT count(*) FROM sf x WHERE x.qid = sf.qid) > 1 THEN 2 ELSE 3 END),
cn1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fact_pos, pos) AS i FROM cn0), cn2 AS (SELECT *, min(CASE WHEN required AND i >= 5 THEN i END) OVER (PARTITION BY qid) AS stop, min(i) OVER (PARTITION BY qid, fact_pos) AS f1 FROM cn1),
cn3 AS (SELECT *, required AND domain IS NOT NULL AND {s_pass('sentence')} AS dom FROM cn2 WHERE (stop IS NULL OR i <= stop) AND f1 <= 5),
cn4 AS (SELECT *, count(*) FILTER (WHERE required) OVER (PARTITION BY qid) AS n_required, count(*) FILTER (WHERE dom) OVER (PARTITION BY qid) AS n_domain FROM cn3),
cn5 AS (SELECT *, domain IS NOT NULL AND n_domain >= 2 AS domain_used FROM cn4),
cand AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY fact_pos, pos) AS INT) AS cand, CASE WHEN required THEN 'Requirement: ' ELSE '' END || sentence AS line FROM cn5 WHERE CASE WHEN domain IS NULL THEN true WHEN domain_used THEN dom ELSE required END) WHERE cand <= 5)"""


def cands(spark, d):
    return S.candidates(chosen_facts(spark, d).join(domains(spark, d), "qid"), found(spark, d), passes)


@query("sentence_candidates", f"{_CAND} SELECT qid, pdf, chunk_id, cand, line, n_required, n_domain, domain_used FROM cand")
def sentence_candidates(spark, d):
    return cands(spark, d).select("qid", "pdf", "chunk_id", "cand", "line", "n_required", "n_domain", "domain_used")


_CHOSEN = f"""{_CAND}, ch1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, pdf, pdf_index, chunk_id, lower(line) ORDER BY cand) AS same FROM cand) WHERE same = 1),
ch2 AS (SELECT *, row_number() OVER (PARTITION BY qid, pdf ORDER BY cand) AS od FROM ch1), ch3 AS (SELECT *, CASE WHEN od = 1 AND row_number() OVER (PARTITION BY qid, od = 1 ORDER BY cand) <= 2 THEN 1 ELSE 2 END AS pass FROM ch2),
ch4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY pass, cand) AS INT) AS n, count(*) OVER (PARTITION BY qid) AS al FROM ch3 WHERE od <= 2), chosen AS (SELECT * FROM ch4 WHERE al >= 2)"""


def lines_chosen(spark, d):
    return S.choose_lines(cands(spark, d))


@query("answer_sentences", f"{_CHOSEN} SELECT qid, n, pdf, chunk_id, line FROM chosen")
def answer_sentences(spark, d):
    return lines_chosen(spark, d).select("qid", "n", "pdf", "chunk_id", "line")


_CONF = "CASE WHEN n >= 3 AND nd >= 2 AND m >= 0.25 THEN 'High' WHEN n >= 2 AND nd >= 1 AND m >= 0.22 THEN 'Medium' ELSE 'Low' END"
_ANSWER = f"""{_CHOSEN}, rn AS (SELECT qid, count(*) AS n, count(DISTINCT pdf) AS nd, avg(score) AS m, string_agg(n || ') ' || line || ' (' || pdf || ' | ' || (pdf_index + 1) || ' | ' || chunk_id || ')', chr(10) ORDER BY n) AS t FROM chosen GROUP BY qid),
ans AS (SELECT qid, coalesce('ANSWER:' || chr(10) || t || chr(10) || 'CONFIDENCE: ' || {_CONF}, '{S.REFUSAL}') AS answer, CAST(coalesce(n, 0) AS INT) AS n_lines, CASE WHEN n IS NOT NULL THEN {_CONF} END AS confidence FROM questions LEFT JOIN rn USING (qid))"""


def answers(spark, d):
    return S.render(lines_chosen(spark, d), questions(spark, d))


@query("synthesize", f"{_ANSWER} SELECT * FROM ans")
def synthesize(spark, d):
    return answers(spark, d)


@query("confidence_label", f"{_ANSWER} SELECT coalesce(confidence, 'none') AS confidence, count(*) AS n FROM ans GROUP BY 1")
def confidence_label(spark, d):
    return answers(spark, d).groupBy(F.coalesce("confidence", F.lit("none")).alias("confidence")).agg(F.count("*").alias("n"))


@query("dedupe_citations", f"{_CHOSEN}, cd AS (SELECT *, row_number() OVER (PARTITION BY qid, pdf, pdf_index, chunk_id ORDER BY n) AS dd FROM chosen) SELECT * FROM (SELECT qid, pdf, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY n) AS INT) AS citation FROM cd WHERE dd = 1) WHERE citation <= 5")
def dedupe_citations(spark, d):
    return S.dedupe_citations(lines_chosen(spark, d), "qid", "n", 5).select("qid", "pdf", "chunk_id", "citation")


@query("format_facts", f"{_FACTS} SELECT qid, string_agg('- ' || {s_clean('quote')} || ' (' || pdf || ' | ' || (pdf_index + 1) || ' | ' || chunk_id || ') score=' || printf('%.4f', score), chr(10) ORDER BY {_ORD}) AS facts FROM facts GROUP BY qid")
def format_facts(spark, d):
    line = F.format_string("- %s (%s | %s | %s) score=%s", T.clean_text(F.col("quote")), "pdf", (F.col("pdf_index") + 1).cast("string"), "chunk_id", T.fixed(F.col("score"), 4))
    rows = facts(spark, d).select("qid", F.struct(*[(-F.col("score")).alias("s"), *[F.col(k) for k in E.KEY]], line.alias("line")).alias("r"))
    return rows.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("r"))["line"], "\n").alias("facts"))


_LIVE = "(contains(lq, 'market share') OR contains(lq, 'average cost') OR (contains(lq, 'failure rate') AND (contains(lq, 'current') OR regexp_matches(lq, '\\b20[0-9]{2}\\b'))) OR (contains(lq, 'who is') AND contains(lq, 'head of')) OR (contains(lq, 'how many') AND contains(lq, 'warning letter') AND contains(lq, 'last month')))"
# The chain over the gate's facts, and over all facts of the questions that the gate leaves without any.
_CHAIN = _CHOSEN.replace(_FACTS, f"{_GATE}, src AS (SELECT f.* FROM facts f JOIN gt USING (qid, pdf, pdf_index, chunk_id) UNION ALL SELECT * FROM facts WHERE qid NOT IN (SELECT qid FROM gt))").replace("FROM facts f WHERE NOT", "FROM src f WHERE NOT")
_FULL = f"""{_CHAIN}, cd AS (SELECT *, row_number() OVER (PARTITION BY qid, pdf, pdf_index, chunk_id ORDER BY n) AS dd FROM chosen), nc AS (SELECT qid, least(5, count(*)) AS n_citations FROM cd WHERE dd = 1 GROUP BY qid),
rn AS (SELECT qid, count(*) AS n, count(DISTINCT pdf) AS nd, avg(score) AS m, string_agg(n || ') ' || line || ' (' || pdf || ' | ' || (pdf_index + 1) || ' | ' || chunk_id || ')', chr(10) ORDER BY n) AS t FROM chosen WHERE qid NOT IN (SELECT qid FROM (SELECT qid, lower(trim(question)) AS lq FROM questions) WHERE {_LIVE}) GROUP BY qid)
SELECT qid, coalesce('ANSWER:' || chr(10) || t || chr(10) || 'CONFIDENCE: ' || {_CONF}, '{S.REFUSAL}') AS answer, CAST(coalesce(n, 0) AS INT) AS n_lines, CASE WHEN n IS NOT NULL THEN {_CONF} END AS confidence, CAST(CASE WHEN n IS NULL THEN 0 ELSE n_citations END AS INT) AS n_citations, qid IN (SELECT qid FROM facts) AND qid NOT IN (SELECT qid FROM gt) AS from_all_facts FROM questions LEFT JOIN rn USING (qid) LEFT JOIN nc USING (qid)"""


def answer_parts(spark, d):
    """(bare, considered, lines) of the whole chain over phase A's facts: those that the gate keeps, or all of the questions in
    `bare`, where it keeps none; questions about live data have neither sentences nor lines."""
    f = facts(spark, d)
    kept = gated(spark, d).select("qid", *E.KEY).distinct()
    bare = f.join(kept.select("qid").distinct(), "qid", "left_anti")
    source = f.join(kept, ["qid", *E.KEY], "left_semi").unionByName(bare)
    chosen = S.select_facts(source, found(spark, d), STEMS).join(domains(spark, d), "qid")
    asked = questions(spark, d).where(~Q.live_data(F.col("question"))).select("qid")
    considered = S.considered(chosen.join(asked, "qid", "left_semi"), found(spark, d), passes)
    return bare, considered, S.choose_lines(S.numbered(considered))


@query("answer", _FULL)
def answer(spark, d):
    """The whole chain: facts, sentences, candidates, lines, answer and its citations. Questions without facts, about live data,
    with fewer than two lines or no citation are refused."""
    bare, _, lines = answer_parts(spark, d)
    cited = S.dedupe_citations(lines, "qid", "n", 5).groupBy("qid").agg(F.count("*").cast("int").alias("n_citations"))
    out = S.render(lines.join(cited.select("qid"), "qid", "left_semi"), questions(spark, d))
    out = out.join(cited, "qid", "left").join(bare.select("qid").distinct().withColumn("_b", F.lit(True)), "qid", "left")
    return out.select("qid", "answer", "n_lines", "confidence", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.col("_b").isNotNull().alias("from_all_facts"))
