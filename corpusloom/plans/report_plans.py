"""Baseline runs, their verdicts and reports, the files between them, titles and paths of documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T
from corpusloom.operators import chunking as K
from corpusloom.operators import evaluation as V
from corpusloom.operators import retrieval as R
from corpusloom.operators import routing as G
from corpusloom.operators import synthesis as S
from corpusloom.plans.eval_plans import _MUST, _NOT, evaluated, s_reasons
from corpusloom.plans.fixtures import LEXICON, LINES_SQL, PREFIXES, QUESTIONS_SQL, documents, lines, questions, sql_list, stored, table
from corpusloom.plans.page_plans import _INTEGRITY, chunk_counts
from corpusloom.plans.phase_plans import _FULL, _LIVE, answer, answer_parts
from corpusloom.plans.registry import query
from corpusloom.plans.search_plans import DEFAULT, RETRIED, domains, gathered, mixed, pool, retried, with_text
from corpusloom.plans.text_plans import _SCORE, _T, _TITLE, s_letters, s_match, s_norm
from corpusloom.sources import files, index_store

STAMP = "as asked"

_CTES, _SELECT = _FULL.rsplit("\nSELECT ", 1)
#: The answers of the whole chain, and of each question its sentences' counts, its citations and its result row.
_RUN = f"""{_CTES}, an AS MATERIALIZED (SELECT {_SELECT}),
live AS (SELECT qid FROM (SELECT qid, lower(trim(question)) AS lq FROM questions) WHERE {_LIVE}), st AS (SELECT qid, count(*) AS n_total, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE dom) AS n_domain, any_value(domain) IS NOT NULL AND count(*) FILTER (WHERE dom) >= 2 AS domain_used FROM cn3 WHERE qid NOT IN (SELECT qid FROM live) GROUP BY qid),
cl AS (SELECT qid, pdf || ':' || (pdf_index + 1) AS c, row_number() OVER (PARTITION BY qid ORDER BY n) AS nth FROM cd WHERE dd = 1), cs AS (SELECT qid, string_agg(c, ';' ORDER BY nth) AS cited FROM (SELECT qid, c, min(nth) AS nth FROM cl WHERE nth <= 5 GROUP BY qid, c) GROUP BY qid),
br AS MATERIALIZED (SELECT qid AS id, coalesce(domain, 'general') AS domain, question, answer = '{S.REFUSAL}' AS refusal, 'unknown' AS verdict, n_citations AS citations_count, CASE WHEN n_citations > 0 THEN cited ELSE '' END AS cited_sources, domain AS domain_key, coalesce(domain_used, false) AS domain_used, coalesce(n_total, 0) AS n_total, coalesce(n_required, 0) AS n_required, coalesce(n_domain, 0) AS n_domain, qid IN (SELECT qid FROM sr WHERE retried) AS scope_retry, '' AS notes FROM questions JOIN an USING (qid) JOIN dm USING (qid) LEFT JOIN st USING (qid) LEFT JOIN cs USING (qid))"""


def _citation_lists(lines):
    return S.dedupe_citations(lines, "qid", "n", 5).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("citation", F.col("pdf").alias("doc"), (F.col("pdf_index") + 1).alias("page")))).alias("c"))


def citation_lists(spark, d):
    """(id, c): the citations of the answers that have any."""
    said = answer(spark, d).where("n_citations > 0").select("qid")
    return _citation_lists(answer_parts(spark, d)[2]).join(said, "qid", "left_semi").withColumnRenamed("qid", "id")


def baseline(spark, d):
    """A result row per question, from the answer and its trace."""

    def build(spark, d):
        _, considered, chosen = answer_parts(spark, d)
        cited = _citation_lists(chosen)
        again = mixed(spark, d).where("retried").select("qid").distinct().withColumn("scope_retry", F.lit(True))
        x = questions(spark, d).join(answer(spark, d), "qid").join(domains(spark, d).withColumnRenamed("domain", "domain_key"), "qid")
        for part in (S.domain_stats(considered), cited, again):
            x = x.join(part, "qid", "left")
        x = x.fillna(False, ["domain_used", "scope_retry"]).fillna(0, ["n_total", "n_required", "n_domain"])
        sources = F.when(F.col("n_citations") > 0, V.cited_sources(F.col("c"))).otherwise(F.lit(""))
        return x.select(
            F.col("qid").alias("id"), F.coalesce("domain_key", F.lit("general")).alias("domain"), "question", (F.col("answer") == S.REFUSAL).alias("refusal"), F.lit("unknown").alias("verdict"),
            F.col("n_citations").alias("citations_count"), sources.alias("cited_sources"), "domain_key", "domain_used", "n_total", "n_required", "n_domain", "scope_retry", F.lit("").alias("notes"),
        )

    return stored(spark, d, "baseline", build)


@query("baseline_run", f"{_RUN} SELECT * FROM br")
def baseline_run(spark, d):
    return baseline(spark, d)


_COLUMNS = ("id", "domain", "question", "refusal", "verdict", "citations_count", "cited_sources", "domain_key", "domain_used", "n_total", "n_required", "n_domain", "scope_retry", "notes")


@query("baseline_results_csv", f"{_RUN} SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _COLUMNS)} FROM br")
def baseline_results_csv(spark, d):
    """The result rows, written as CSV and read again as strings."""
    path = index_store.scratch(spark)
    files.write_csv(baseline(spark, d), path)
    return files.read_csv(spark, path, _COLUMNS)


@query("case_outputs", f"{_RUN}, cw AS (SELECT qid, string_agg('- ' || pdf || ' | p' || (pdf_index + 1) || ' | ' || chunk_id, chr(10) ORDER BY nth) AS c FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n) AS nth FROM cd WHERE dd = 1) WHERE nth <= 5 GROUP BY qid) SELECT CAST(qid AS VARCHAR) AS id, answer || chr(10) || chr(10) || 'Citations:' || chr(10) || CASE WHEN n_citations > 0 THEN c ELSE '- none' END AS text FROM an LEFT JOIN cw USING (qid)")
def case_outputs(spark, d):
    """A text per case, written to a folder each and read again."""
    cited = S.dedupe_citations(answer_parts(spark, d)[2], "qid", "n", 5)
    row = F.struct("citation", F.format_string("- %s | p%s | %s", "pdf", (F.col("pdf_index") + 1).cast("string"), "chunk_id").alias("c"))
    lists = cited.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(row))["c"], "\n").alias("c"))
    text = F.concat("answer", F.lit("\n\nCitations:\n"), F.when(F.col("n_citations") > 0, F.col("c")).otherwise(F.lit("- none")))
    out = answer(spark, d).join(lists, "qid", "left").select(V.safe_id(F.col("qid").cast("string")).alias("id"), text.alias("text"))
    path = index_store.scratch(spark)
    files.write_texts(out, path)
    return files.read_texts(spark, path)


_GOLDEN = f"WITH {QUESTIONS_SQL}, cases AS (SELECT CAST(qid AS VARCHAR) AS id, question, qid % 5 = 0 AS nf, {_MUST} AS must, {_NOT} AS mustnot, CASE WHEN qid % 2 = 0 THEN 1 ELSE 4 END AS least FROM questions)"


def case_lines(spark, d, **more):
    """Cases as JSON lines; fields that hold their default are left out, as in hand-written files."""
    must = F.expr("case qid % 3 when 0 then array('the', 'Requirement') when 1 then array('Confidence', 'zzz') end")
    fields = [F.col("qid").alias("id"), "question", F.expr("case when qid % 5 = 0 then true end").alias("expected_not_found"), must.alias("must_include"), F.expr("case when qid % 4 = 0 then array('Tion') end").alias("must_not_include"), F.expr("case when qid % 2 = 1 then 4 end").alias("min_citations")]
    path = index_store.scratch(spark)
    questions(spark, d).select(F.to_json(F.struct(*fields, *[v.alias(k) for k, v in more.items()])).alias("value")).write.text(path)
    return path


@query("golden_cases", f"{_GOLDEN} SELECT id, question, 'MIXED' AS scope, nf AS expected_not_found, array_to_string(must, '|') AS must_include, array_to_string(mustnot, '|') AS must_not_include, least AS min_citations, 0 AS n_required FROM cases")
def golden_cases(spark, d):
    x = files.golden_cases(spark, case_lines(spark, d))
    return x.select("id", "question", "scope", "expected_not_found", F.array_join("must_include", "|").alias("must_include"), F.array_join("must_not_include", "|").alias("must_not_include"), "min_citations", F.size("phase_a_require_authorities_when_eligible").alias("n_required"))


@query("baseline_cases", f"{_GOLDEN} SELECT id, question, '' AS domain, 'MIXED' AS scope, CASE WHEN nf THEN 'refusal' ELSE 'unknown' END AS expected_outcome, array_to_string(must, '|') AS must_include, array_to_string(mustnot, '|') AS must_not_include, least AS min_citations, 6 AS max_citations FROM cases")
def baseline_cases(spark, d):
    x = files.baseline_cases(spark, case_lines(spark, d, expected_outcome=F.expr("case when qid % 5 = 0 then 'refusal' end")))
    return x.withColumn("must_include", F.array_join("must_include", "|")).withColumn("must_not_include", F.array_join("must_not_include", "|"))


# Verdicts of the cases follow from their checks: what is right as expected, refused wrongly, or answered in part.
_VERDICTS = f"""{_RUN}, cases AS (SELECT qid AS id, qid % 5 = 0 AS expected_not_found, {_MUST} AS must, {_NOT} AS mustnot, CASE WHEN qid % 2 = 0 THEN 1 ELSE 4 END AS min_citations FROM questions),
cx AS (SELECT *, {s_reasons('citations_count')} AS reasons FROM (SELECT cases.*, answer, refusal AS refused, citations_count FROM br JOIN cases USING (id) JOIN an ON an.qid = id)),
vd AS MATERIALIZED (SELECT id, CASE WHEN len(reasons) = 0 AND refused THEN 'correct_refusal' WHEN len(reasons) = 0 THEN 'strong_correct' WHEN refused THEN 'incorrect' ELSE 'partial' END AS verdict, array_to_string(reasons, ';') AS notes FROM cx)"""


def case_verdicts(spark, d):
    a = answer(spark, d).select(F.col("qid").alias("id"), "answer", "n_citations")
    ok, refused = F.col("ok"), F.col("refused")
    verdict = F.when(ok & refused, "correct_refusal").when(ok, "strong_correct").when(refused, "incorrect").otherwise("partial")
    found = evaluated(spark, d, a).select("id", verdict.alias("verdict"), F.array_join("reasons", ";").alias("notes"))
    return stored(spark, d, "case verdicts", lambda spark, d: V.strict_verdicts(found))


def judged_cases(spark, d):
    return baseline(spark, d).drop("verdict", "notes").join(case_verdicts(spark, d), "id")


@query("baseline_verdicts", f"{_VERDICTS} SELECT * FROM vd")
def baseline_verdicts(spark, d):
    return case_verdicts(spark, d)


def _s_pct(n: str, total: str = "total") -> str:
    return f"printf('%.1f%%', 100.0::DOUBLE * ({n}) / {total})"


_SUMS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in V.VERDICTS) + ", count(*) FILTER (WHERE contains(lower(notes), 'hallucination')) AS hallucinations"
_OVERALL = ["'# Baseline Scorecard'", "''", f"'Generated: {STAMP}'", "''", "'## Overall metrics'", "'- total: ' || total"]
_OVERALL += [f"'- {v}: ' || {v} || ' (' || {_s_pct(v)} || ')'" for v in ("strong_correct", "partial", "incorrect", "correct_refusal", "unknown")]
_OVERALL += [f"'- strong+partial % (target >= 85%): ' || {_s_pct('strong_correct + partial')}", f"'- strong % (target >= 75%): ' || {_s_pct('strong_correct')}", "'- hallucinations count (target = 0): ' || hallucinations"]
_OVERALL += ["''", "'## By-domain table'", "''", "'| domain | total | strong | partial | incorrect | correct_refusal | strong% | strong+partial% | refusal% |'", "'|---|---:|---:|---:|---:|---:|---:|---:|---:|'"]
_ABOVE = ["''", "'## Worst 10'", "''", "'| id | domain | question | cited_sources | domain_filter_used | empty_scope_retry_used |'", "'|---|---|---|---|---|---|'"]
_REPORT = f"""{_VERDICTS}, jd AS (SELECT br.* EXCLUDE (verdict, notes), vd.verdict, vd.notes FROM br JOIN vd USING (id)), oa AS (SELECT {_SUMS} FROM jd), od AS (SELECT domain, {_SUMS} FROM jd GROUP BY domain),
ol AS (SELECT [{', '.join(_OVERALL)}] AS l FROM oa), rp AS (SELECT 1 AS part, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM ol
UNION ALL SELECT 2, row_number() OVER (ORDER BY domain) - 1, '| ' || concat_ws(' | ', domain, total, strong_correct, partial, incorrect, correct_refusal, {_s_pct('strong_correct')}, {_s_pct('strong_correct + partial')}, {_s_pct('correct_refusal')}) || ' |' FROM od
UNION ALL SELECT 3, unnest(range(0, {len(_ABOVE)})), unnest([{', '.join(_ABOVE)}])
UNION ALL SELECT 4, k - 1, '| ' || concat_ws(' | ', id, domain, question, cited_sources, domain_used, scope_retry) || ' |' FROM (SELECT *, row_number() OVER (ORDER BY verdict = 'partial', CAST(id AS VARCHAR)) AS k FROM jd WHERE verdict IN ('incorrect', 'partial')) WHERE k <= 10)"""


@query("scorecard_markdown", f"{_REPORT} SELECT part, CAST(pos AS INT) AS pos, line FROM rp")
def scorecard_markdown(spark, d):
    return V.scorecard_markdown(judged_cases(spark, d), STAMP)


# The worst partial cases again, with the counters of their searches and of the domain's chunk filter.
_AGAIN = f"""{_VERDICTS}, w10 AS (SELECT br.id, n_domain, n_total FROM br JOIN vd USING (id) WHERE vd.verdict = 'partial' ORDER BY n_domain, n_total, CAST(br.id AS VARCHAR) LIMIT 10),
cf AS (SELECT qid, count(*) AS chunks_before, count(*) FILTER (WHERE a) AS after_level1, count(*) FILTER (WHERE b) AS after_level2, any_value(level) AS level FROM d1v GROUP BY qid)
SELECT id, n_domain, n_total, coalesce(level, 0) AS level, {DEFAULT.pipeline_top_k} AS top_k, coalesce(chunks_before, 0) AS chunks_before, coalesce(after_level1, 0) AS after_level1, coalesce(after_level2, 0) AS after_level2, id IN (SELECT qid FROM thin) AS relaxed, coalesce(fallback, false) AS fallback FROM w10 LEFT JOIN cf ON cf.qid = id LEFT JOIN (SELECT qid, bool_or(fallback) AS fallback FROM bi GROUP BY qid) f ON f.qid = id"""


@query("worst_reanswered", _AGAIN)
def worst_reanswered(spark, d):
    worst = V.worst(judged_cases(spark, d).where("verdict = 'partial'"), [F.col("n_domain"), F.col("n_total"), F.col("id").cast("string")])
    worst = worst.select("id", "n_domain", "n_total")
    mine = retried(spark, d).join(F.broadcast(worst.select(F.col("id").alias("qid"))), "qid")
    counts = R.filter_counts(with_text(spark, d, mine).join(domains(spark, d), "qid"), LEXICON)
    thin = R.thin(pool(spark, d), domains(spark, d), RETRIED).withColumn("relaxed", F.lit(True))
    used = gathered(spark, d).groupBy("qid").agg(F.bool_or("fallback").alias("fallback"))
    x = worst.withColumnRenamed("id", "qid")
    for part in (counts, thin, used):
        x = x.join(part, "qid", "left")
    x = x.withColumnRenamed("qid", "id").withColumn("top_k", F.lit(DEFAULT.pipeline_top_k)).fillna(0, ["level", "chunks_before", "after_level1", "after_level2"]).fillna(False, ["relaxed", "fallback"])
    return x.select("id", "n_domain", "n_total", "level", "top_k", "chunks_before", "after_level1", "after_level2", "relaxed", "fallback")


@query("validated_index", f"{_INTEGRITY} SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_chunks, 0::BIGINT AS zero_docs FROM n WHERE n > 0")
def validated_index(spark, d):
    """The report over the documents that have chunks; one without any would end the job."""
    return K.validated(chunk_counts(spark, d).where("n > 0")).select("total_docs", "total_chunks", "zero_docs")


def s_title(raw: str) -> str:
    t = _T.replace("raw", raw)
    return f"CASE WHEN {t} = '' OR {s_match(t, T.TITLE_DROP)} OR length({t}) < 6 OR {s_letters(t)} < 4 THEN NULL ELSE {t} END"


@query("citation_title", f"""WITH {LINES_SQL}, n AS (SELECT doc_id, line_no, {s_norm('line')} AS s FROM lines WHERE page_no = 0 AND line_no < 100), c AS (SELECT *, {_SCORE} AS score FROM n),
r AS (SELECT doc_id, s AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k FROM c WHERE score >= 0) WHERE k = 1), m AS (SELECT page_id, {_TITLE} AS meta FROM pages),
x AS (SELECT doc_id, file, coalesce(meta, '') AS meta, coalesce(best, '') AS best, replace(file, '_', ' ') AS stem FROM docs LEFT JOIN m ON page_id = doc_id LEFT JOIN r USING (doc_id)) SELECT doc_id, coalesce({s_title('meta')}, {s_title('best')}, {s_title('stem')}, file) AS title FROM x""")
def citation_title(spark, d):
    """A document's title: that of the page of its number, where there is one, else its first page's best line, else its name."""
    first = lines(spark, d).where("page_no = 0 and line_no < 100").withColumn("score", T.title_score(F.col("line"), PREFIXES)).where("score >= 0")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no"))
    first = first.withColumn("k", best).where("k = 1").select("doc_id", T.normalize_line(F.col("line")).alias("best"))
    meta = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("meta"))
    x = documents(spark, d).select("doc_id", "file").join(meta, "doc_id", "left").join(first, "doc_id", "left")
    return x.select("doc_id", T.citation_title(F.col("meta"), F.col("best"), F.col("file")).alias("title"))


@query("path_map", r"WITH u AS (SELECT url, regexp_extract(url, '//[^/]*/([^/?]*)', 1) AS folder, regexp_extract(url, '([^/?]*)(?:[?].*)?$', 1) AS name FROM pages) SELECT upper(folder) AS authority, name, arg_min(url, lower(folder) || chr(1) || lower(name) || chr(1) || url) AS path FROM u WHERE url IS NOT NULL GROUP BY ALL")
def path_map(spark, d):
    u = table(spark, d, "pages").where("url is not null").select(F.col("url").alias("path"), F.regexp_extract("url", "//[^/]*/([^/?]*)", 1).alias("folder"), F.regexp_extract("url", "([^/?]*)(?:[?].*)?$", 1).alias("name"))
    return G.path_map(u.withColumn("authority", F.upper("folder")))


@query("file_fingerprint")
def file_fingerprint(spark, d):
    """Path below the folder, size and time of every table's files."""
    x = files.fingerprint(spark, d, "*.parquet")
    return x.select(F.regexp_extract("path", "([^/]+[.]parquet(?:/.*)?)$", 1).alias("path"), "size", "modified")


# Reports over the baseline run. Of its verdicts, the incorrect ones stand in the file under a name that isn't known, and cases with several
# reasons against them were looked at twice.
_RES = f"""{_VERDICTS}, res AS (SELECT CAST(id AS VARCHAR) AS id, domain, question, n_total, n_domain, domain_used AS domain_filter_used, domain_key FROM br),
old AS (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN verdict = 'incorrect' THEN 'wrong' ELSE verdict END AS verdict, notes, 1 AS row FROM vd UNION ALL SELECT CAST(id AS VARCHAR), 'incorrect', 'second look: hallucination', 2 FROM vd WHERE contains(notes, ';')),
lst AS (SELECT id, arg_max(verdict, row) AS verdict, arg_max(notes, row) AS notes FROM old GROUP BY id),
ver AS (SELECT res.id, CASE WHEN list_contains({list(V.VERDICTS)}, verdict) THEN verdict ELSE 'unknown' END AS verdict, coalesce(notes, '') AS notes FROM res LEFT JOIN lst USING (id))"""


def results(spark, d):
    return baseline(spark, d).select(F.col("id").cast("string").alias("id"), "domain", "question", "n_total", "n_domain", F.col("domain_used").alias("domain_filter_used"), "domain_key")


def existing(spark, d):
    """A verdict file: rows in the order in which they were written, later ones of an id in force."""
    x = case_verdicts(spark, d).withColumn("id", F.col("id").cast("string"))
    first = x.select("id", F.when(F.col("verdict") == "incorrect", "wrong").otherwise(F.col("verdict")).alias("verdict"), "notes", F.lit(1).alias("row"))
    return first.unionByName(x.where(F.col("notes").contains(";")).select("id", F.lit("incorrect").alias("verdict"), F.lit("second look: hallucination").alias("notes"), F.lit(2).alias("row")))


def verdicts(spark, d):
    return V.init_verdicts(results(spark, d), existing(spark, d))


def judged(spark, d):
    return results(spark, d).join(verdicts(spark, d), "id")


@query("init_verdicts", f"{_RES} SELECT * FROM ver")
def init_verdicts(spark, d):
    return verdicts(spark, d)


@query("invalid_verdicts", f"{_RES} SELECT id, verdict FROM old WHERE NOT list_contains({sql_list(V.VERDICTS)}, verdict)")
def invalid_verdicts(spark, d):
    return V.invalid_verdicts(existing(spark, d)).select("id", "verdict")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in V.VERDICTS)
_CARD = f"count(*) AS total, {_COUNTS}, count(*) FILTER (WHERE contains(lower(notes), 'hallucination')) AS hallucinations, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'strong_correct') / count(*)) AS strong_pct, printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (WHERE verdict IN ('strong_correct', 'partial')) / count(*)) AS useful_pct"


@query("scorecard", f"{_RES} SELECT {_CARD} FROM ver JOIN res USING (id)")
def scorecard(spark, d):
    return V.scorecard(judged(spark, d))


@query("scorecard_by_domain", f"{_RES} SELECT domain, {_CARD} FROM ver JOIN res USING (id) GROUP BY domain")
def scorecard_by_domain(spark, d):
    return V.scorecard(judged(spark, d), ["domain"])


_PRIO = "CASE verdict WHEN 'incorrect' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END"


@query("worst_cases", f"{_RES} SELECT id, domain, verdict FROM ver JOIN res USING (id) ORDER BY {_PRIO}, id LIMIT 10")
def worst_cases(spark, d):
    return V.worst(judged(spark, d), [F.expr(_PRIO), F.col("id")]).select("id", "domain", "verdict")


@query("partials_by_domain", f"{_RES}, dk AS (SELECT unnest({list(C.DOMAIN_PRIORITY)}) AS domain) SELECT domain, count(p.id) AS partials FROM dk LEFT JOIN (SELECT id, domain FROM res JOIN ver USING (id) WHERE verdict = 'partial') p USING (domain) GROUP BY domain")
def partials_by_domain(spark, d):
    fixed = spark.createDataFrame([(x,) for x in C.DOMAIN_PRIORITY], "domain string")
    counts = judged(spark, d).where("verdict = 'partial'").groupBy("domain").agg(F.count("*").alias("partials"))
    return F.broadcast(fixed).join(counts, "domain", "left").select("domain", F.coalesce("partials", F.lit(0)).alias("partials"))


_FRAME = ("ndea", "thest", "eau")


@query("partial_stats", f"{_RES}, p AS (SELECT * FROM res JOIN ver USING (id) WHERE verdict = 'partial') SELECT count(*) AS partials, count(*) FILTER (WHERE domain_filter_used) AS filtered, count(*) FILTER (WHERE n_domain >= 2) AS enough_domain, median(n_total) AS median_total, median(n_domain) AS median_domain, round(count(*) FILTER (WHERE {' OR '.join(f"contains(lower(question), '{t}')" for t in _FRAME)}) / CAST(count(*) AS DOUBLE), 6) AS framework_rate FROM p")
def partial_stats(spark, d):
    return V.partial_stats(judged(spark, d).where("verdict = 'partial'"), _FRAME)


@query("domain_nonuse", f"{_RES} SELECT domain_key IS NULL AS no_domain, n_domain < 2 AS too_few, count(*) AS n FROM res JOIN ver USING (id) WHERE verdict = 'partial' AND NOT domain_filter_used GROUP BY ALL")
def domain_nonuse(spark, d):
    x = judged(spark, d).where("verdict = 'partial' and not domain_filter_used")
    return x.groupBy(F.col("domain_key").isNull().alias("no_domain"), (F.col("n_domain") < 2).alias("too_few")).agg(F.count("*").alias("n"))


@query("worst_partials", f"{_RES} SELECT id, n_domain, n_total FROM res JOIN ver USING (id) WHERE verdict = 'partial' ORDER BY n_domain, n_total, id LIMIT 10")
def worst_partials(spark, d):
    return V.worst(judged(spark, d).where("verdict = 'partial'"), [F.col("n_domain"), F.col("n_total"), F.col("id")]).select("id", "n_domain", "n_total")


@query("cited_sources", f"{_RUN} SELECT id, cited_sources AS sources FROM br WHERE citations_count > 0")
def cited_sources(spark, d):
    """The sources of each answer's citations, in order."""
    return citation_lists(spark, d).select("id", V.cited_sources(F.col("c")).alias("sources"))


@query("short_sources", f"{_RUN} SELECT id, array_to_string(string_split(cited_sources, ';')[1:2], '; ') || CASE WHEN len(string_split(cited_sources, ';')) > 2 THEN '; ...' ELSE '' END AS sources FROM br WHERE citations_count > 0")
def short_sources(spark, d):
    return citation_lists(spark, d).select("id", V.short_sources(V.cited_sources(F.col("c"))).alias("sources"))
