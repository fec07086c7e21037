"""Question-side queries: normalisation, expansion, classification, routing signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import query as Q
from corpusloom.functions import text as T
from corpusloom.plans.fixtures import LEXICON, QUESTIONS_SQL, questions, quoted, sql_list, table
from corpusloom.plans.registry import query
from corpusloom.plans.text_plans import s_any, s_collapsed, s_match

# The questions' invented words stand in for the terms that the default lists hold.
SYN = (("the ", "and the "), ("de la", "du"))
ACR = (("of", "out of"), ("que", "quel"))
BROAD = {"marker": "the", "include": ("of", "and", "to"), "exclude": ("thth", "ndnd")}
TRIG = {"deviation": ("ther", "eau"), "data_integrity": ("ing", "ado"), "validation": ("ation", "keit")}
ANCH = {"deviation": ("ther", "of", "and"), "data_integrity": ("ing", "of"), "validation": ("ation", "and", "la")}
OOS, APR, VALID = ("oush",), ("ment", "ent"), ("ou", "ver")


def s_normalize(x: str) -> str:
    x = s_collapsed(x)
    for mark in "?!.,;:":
        x = f"regexp_replace({x}, '[{mark}]+', '{mark}', 'g')"
    return f"trim({x})"


_Q = f"WITH {QUESTIONS_SQL}, q AS (SELECT qid, question, {s_normalize('question')} AS s FROM questions)"


def s_word(x: str, words) -> str:
    return s_match(x, r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])")


def s_expand() -> str:
    forms = [f"CASE WHEN contains(s, {quoted(a)}) THEN {s_normalize(f'replace(s, {quoted(a)}, {quoted(b)})')} END" for a, b in SYN]
    for a, b in ACR:
        doubled = f"regexp_replace(s, ' ', '  ', 'g')"
        new = f"replace(regexp_replace({doubled}, '(^|[^\\pL\\pN_]){a}($|[^\\pL\\pN_])', '\\1{b}\\2', 'g'), '  ', ' ')"
        forms.append(f"CASE WHEN {s_word('s', [a])} THEN {s_normalize(new)} END")
    return "[s, " + ", ".join(forms) + "]"


def s_distinct(x: str) -> str:
    """Distinct non-empty strings in order of first appearance."""
    return f"list_filter({x}, lambda v, i: v IS NOT NULL AND v <> '' AND list_position({x}, v) = i)"


@query("normalize_query", f"{_Q} SELECT qid, s AS q_norm FROM q")
def normalize_query(spark, d):
    return questions(spark, d).select("qid", T.normalize_query(F.col("question")).alias("q_norm"))


@query("expand_query", f"{_Q} SELECT qid, unnest({s_distinct(s_expand())}[1:5]) AS variant FROM q")
def expand_query(spark, d):
    return questions(spark, d).select("qid", F.explode(Q.expand(F.col("question"), SYN, ACR)).alias("variant"))


_BROAD = f"({s_word('s', [BROAD['marker']])} AND {s_word('s', BROAD['include'])} AND NOT {s_any('s', BROAD['exclude'])})"


@query("broad_requirement", f"{_Q} SELECT qid, {_BROAD} AS broad FROM q")
def broad_requirement(spark, d):
    return questions(spark, d).select("qid", Q.broad_requirement(F.col("question"), **BROAD).alias("broad"))


_WIDE = s_normalize("s || ' of and the'")


@query("query_variants", f"{_Q}, v AS (SELECT qid, {s_distinct(s_expand())}[1:5] AS e, CASE WHEN {_BROAD} THEN [{_WIDE}] ELSE [] END AS w FROM q), a AS (SELECT qid, list_concat(e, w) AS a FROM v) SELECT qid, unnest({s_distinct('a')}) AS variant FROM a")
def query_variants(spark, d):
    q = F.col("question")
    found = Q.variants(q, ("of", "and", "the"), SYN, ACR, Q.broad_requirement(q, **BROAD))
    return questions(spark, d).select("qid", F.explode(found).alias("variant"))


_I = "lower(trim(question))"


@query("classify_intent", f"{_Q} SELECT qid, CASE WHEN starts_with({_I}, 'of') OR starts_with({_I}, 'the') OR contains({_I}, 'anth') THEN 'definition' WHEN {s_any(_I, ('eau', 'keit'))} THEN 'procedure' WHEN {s_any(_I, ('ment', 'ing'))} THEN 'requirements' ELSE 'unknown' END AS intent FROM q")
def classify_intent(spark, d):
    return questions(spark, d).select("qid", Q.intent(F.col("question"), ("of", "the"), ("anth",), ("eau", "keit"), ("ment", "ing")).alias("intent"))


_ALNUM = "trim(regexp_replace(lower(question), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_TRIGGERED = "list_filter([" + ", ".join(f"CASE WHEN {s_any('a', t)} THEN '{k}' END" for k, t in TRIG.items()) + "], lambda x: x IS NOT NULL)"


@query("query_triggers", f"{_Q} SELECT qid, unnest({_TRIGGERED}) AS topic FROM (SELECT qid, {_ALNUM} AS a FROM q)")
def query_triggers(spark, d):
    return questions(spark, d).select("qid", F.explode(Q.triggers(F.col("question"), TRIG)).alias("topic"))


_ANCHORS = "list_concat(" + ", list_concat(".join(f"CASE WHEN {s_any('a', t)} THEN {sql_list(ANCH[k])} ELSE [] END" for k, t in list(TRIG.items())[:2]) + f", CASE WHEN {s_any('a', TRIG['validation'])} THEN {sql_list(ANCH['validation'])} ELSE [] END))"


@query("anchor_terms", f"{_Q}, t AS (SELECT qid, {_ANCHORS} AS l FROM (SELECT qid, {_ALNUM} AS a FROM q)) SELECT qid, array_to_string({s_distinct('l')}, ';') AS anchors FROM t")
def anchor_terms(spark, d):
    return questions(spark, d).select("qid", F.array_join(Q.anchors(F.col("question"), TRIG, ANCH), ";").alias("anchors"))


_HQ = "'see ich q ' || qid % 20 || ' and part ' || qid || ' or q' || qid % 7 || '(r2) ' || question"


@query("doc_hints", f"{_Q} SELECT qid, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(lower(h), '\\bq\\s*[- ]?([0-9]{{1,2}})(?:\\s*\\(r[0-9]+\\))?\\b', 1), lambda x: 'q' || x), list_transform(regexp_extract_all(lower(h), '\\bpart\\s*([0-9]{{1,3}})\\b', 1), lambda x: 'part' || x)))) AS hints FROM (SELECT qid, {_HQ} AS h FROM q)")
def doc_hints(spark, d):
    h = F.expr("concat('see ich q ', qid % 20, ' and part ', qid, ' or q', qid % 7, '(r2) ', question)")
    return questions(spark, d).select("qid", Q.doc_hints(h).alias("hints"))


_LIVE = "CASE qid % 5 WHEN 0 THEN 'What is the average cost of ' WHEN 1 THEN 'Current failure rate ' WHEN 2 THEN 'who is near ' WHEN 3 THEN 'How many warning letters last month ' ELSE '' END || question"


@query("live_data_guard", f"{_Q}, l AS (SELECT qid, lower(trim({_LIVE})) AS s FROM q) SELECT qid, (contains(s, 'market share') OR contains(s, 'average cost') OR (contains(s, 'failure rate') AND (contains(s, 'current') OR regexp_matches(s, '\\b20[0-9]{{2}}\\b'))) OR (contains(s, 'who is') AND contains(s, 'head of')) OR (contains(s, 'how many') AND contains(s, 'warning letter') AND contains(s, 'last month'))) AS live FROM l")
def live_data_guard(spark, d):
    asked = F.expr("concat(case qid % 5 when 0 then 'What is the average cost of ' when 1 then 'Current failure rate ' when 2 then 'who is near ' when 3 then 'How many warning letters last month ' else '' end, question)")
    return questions(spark, d).select("qid", Q.live_data(asked).alias("live"))


def s_count(x: str, terms) -> str:
    return "(" + (" + ".join(f"CASE WHEN contains({x}, {quoted(t)}) THEN 1 ELSE 0 END" for t in dict.fromkeys(terms)) or "0") + ")"


def _s_domain() -> str:
    rows = []
    for rank, name in enumerate(C.DOMAIN_PRIORITY):
        score = f"3 * {s_count('s', LEXICON[name].strong)} + {s_count('s', LEXICON[name].secondary)}"
        if name == "apr":
            score = f"CASE WHEN {s_any('s', APR)} AND NOT {s_any('s', OOS)} THEN {score} ELSE 0 END"
        if name == "validation":
            score = f"CASE WHEN {s_any('s', VALID)} THEN greatest({score}, 1) ELSE {score} END"
        rows.append(f"SELECT qid, s, {rank} AS rank, '{name}' AS name, {score} AS score FROM q")
    return f"""{_Q}, sc AS ({' UNION ALL '.join(rows)}), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS k FROM sc)
SELECT qid, CASE WHEN {s_any('s', OOS)} OR (contains(s, 'phase i') AND contains(s, 'phase ii')) THEN 'deviations' WHEN score > 0 THEN name WHEN {s_any('s', APR)} THEN 'apr' WHEN {s_any('s', VALID)} THEN 'validation' END AS domain FROM b WHERE k = 1"""


@query("detect_domain", _s_domain())
def detect_domain(spark, d):
    return questions(spark, d).select("qid", Q.domain(F.col("question"), LEXICON, out_of_spec=OOS, apr=APR, validation=VALID).alias("domain"))


def _s_hits() -> str:
    rows = [f"SELECT qid, '{n}' AS domain, {s_count('s', x.strong)} AS strong, {s_count('s', x.secondary)} AS secondary, {s_count('s', x.negative)} AS negative FROM q" for n, x in LEXICON.items()]
    return f"{_Q} {' UNION ALL '.join(rows)}"


@query("lexicon_hits", _s_hits())
def lexicon_hits(spark, d):
    parts = []
    for name, lex in LEXICON.items():
        strong, secondary, negative = Q.lexicon_flags(T.normalize_query(F.col("question")), lex)
        parts.append(F.struct(F.lit(name).alias("domain"), strong.alias("strong"), secondary.alias("secondary"), negative.alias("negative")))
    return questions(spark, d).select("qid", F.explode(F.array(*parts)).alias("x")).select("qid", "x.*")


TOPIC_WORDS = {"process_validation": ("ation", "thin", "ou"), "oos": ("eau", "ment"), "sterile": ("ing", "ere"), "data_integrity": ("keit", "ado", "ent")}


@query("match_topics", f"{_Q}, m AS ({' UNION ALL '.join(f'''SELECT qid, '{k}' AS topic, {s_count('s', w)} AS score FROM q''' for k, w in TOPIC_WORDS.items())}) SELECT qid, topic, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, topic) AS rank FROM m WHERE score > 0")
def match_topics(spark, d):
    from corpusloom.operators import routing as R

    return R.match_topics(questions(spark, d).select("qid", T.normalize_query(F.col("question")).alias("q")), {k: (w, ()) for k, w in TOPIC_WORDS.items()})


_RULES = tuple(p for _, paths in C.TOPICS.values() for p in paths)


@query("path_match", f"WITH f AS (SELECT DISTINCT lower({sql_list(C.AUTHORITIES)}[1 + CAST(substr(source, 4) AS INT) % 8]) || '/annex15 ' || source || '.pdf' AS path FROM documents), r AS (SELECT DISTINCT unnest({sql_list(_RULES)}) AS rule) SELECT path, rule FROM f JOIN r ON starts_with(path, rule) OR (NOT ends_with(rule, '/') AND contains(path, rule))")
def path_match(spark, d):
    from corpusloom.operators import routing as R
    from corpusloom.plans.fixtures import authority

    paths = table(spark, d, "documents").select(F.concat(F.lower(authority()), F.lit("/annex15 "), F.col("source"), F.lit(".pdf")).alias("path")).distinct()
    rules = spark.createDataFrame([(r,) for r in dict.fromkeys(_RULES)], "rule string")
    return paths.join(F.broadcast(rules), R.path_matches(F.col("path"), F.col("rule"))).select("path", "rule")


@query("filename_overlap", f"{_Q}, t AS (SELECT qid, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]{{2,}}')), lambda x: length(x) >= 3) AS qt FROM q), n AS (SELECT page_id, list_filter(list_distinct(regexp_extract_all(lower(url || ' ' || regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '[a-z0-9]{{2,}}')), lambda x: length(x) >= 3) AS nt FROM pages) SELECT qid, page_id, round(CAST(len(list_intersect(qt, nt)) AS DOUBLE) / len(qt), 6) AS overlap FROM t, n WHERE len(list_intersect(qt, nt)) > 0")
def filename_overlap(spark, d):
    from corpusloom.operators import routing as R

    names = table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("name"))
    found = R.name_overlap(questions(spark, d), names, "qid", "question", "page_id", "name")
    return found.select("qid", "page_id", F.round("overlap", 6).alias("overlap"))


@query("topic_tokens", f"{_Q} SELECT qid, list_sort(list_filter(list_distinct(regexp_extract_all(s, '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({sql_list(C.TOPIC_STOP)}, x))) AS tokens FROM q")
def topic_tokens(spark, d):
    found = F.array_distinct(F.regexp_extract_all(T.normalize_query(F.col("question")), F.lit("[a-z0-9]{3,}"), 0))
    return questions(spark, d).select("qid", F.array_sort(F.array_except(found, F.array(*[F.lit(x) for x in C.TOPIC_STOP]))).alias("tokens"))


