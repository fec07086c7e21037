"""Line-level, page-level and sentence-level queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T
from corpusloom.operators import pages as P
from corpusloom.plans.fixtures import BOILER, DOCS_SQL, LINES_SQL, PATTERNS, PREFIXES, STEMS, documents, lines, quoted, sql_list, table
from corpusloom.plans.registry import query

B = quoted(T.BLANK)


#: RE2's \b knows ASCII alone.
S_TRUNCATED = T.TRUNCATED.replace(r"\b", r"(^|[^\p{L}\p{N}_])", 1)


# SQL twins of the expressions in functions.text.
def s_norm(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, chr(160) || chr(61623) || chr(8226), '   '), {B}, ' ', 'g'))"


def s_letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def s_match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def s_heading(x: str, prefixes=PREFIXES) -> str:
    x = f"trim({x})"
    starts = r"(?i)^\s*(" + "|".join(prefixes) + r")($|[^\p{L}\p{N}_])"  # RE2's \b knows ASCII alone
    return f"(length({x}) BETWEEN 1 AND 180 AND ({s_match(x, starts)} OR {s_match(x, T.NUMBERED)} OR ({s_match(x, T.CAPITALS)} AND {s_letters(x)} >= 6)))"


def s_artifact(x: str) -> str:
    n = s_norm(x)
    return f"({n} = '' OR {s_match(n, T.PAGE_NUMBER)} OR {s_match(f'lower({n})', T.PAGE_OF)} OR {s_match(n, T.URL)} OR contains(lower({n}), 'table of contents') OR {s_match(n, T.RULE)} OR {s_match(n, T.MARKS)})"


def s_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({s_norm(x)}), {quoted(T.PAGE_OF)}, ' ', 'g'), '\\b\\d+\\b', '#', 'g'), {B}, ' ', 'g'))"


def s_clean(x: str) -> str:
    """RE2 has no lookbehind: a number goes where a non-digit precedes and follows; two passes cover neighbours."""
    x = f"translate({x}, chr(160) || chr(61623) || chr(8226), '   ')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([^0-9\\pL_])[0-9]{{2,4}}([^0-9\\pL_])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({x}, {B}, ' ', 'g'))"


def s_collapsed(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {B}, ' ', 'g'))"


def s_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(t)})" for t in terms) + ")"


def s_requirement(x: str, stems=STEMS) -> str:
    return s_match(f"lower({x})", r"(^|[^\p{L}\p{N}_])(" + "|".join(stems) + ")")


def s_heading_text(x: str, patterns=PATTERNS) -> str:
    x = f"trim(regexp_replace({x}, {B}, ' ', 'g'))"
    up = f"length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g'))"
    starts = " OR ".join(f"starts_with(lower({x}), {quoted(p)})" for p in patterns)
    return f"({x} = '' OR ends_with({x}, ':') OR {starts} OR ({s_letters(x)} >= 6 AND CAST({up} AS DOUBLE) / {s_letters(x)} >= 0.85))"


def s_sentences(x: str, marks: str = ".!?") -> str:
    """Split after a terminator and white space, by way of a marker."""
    return f"list_filter(list_transform(string_split(regexp_replace(trim({x}), '([{marks}])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ' || chr(10) || chr(9) || chr(13))), lambda p: p <> '')"


def s_complete(x: str, patterns=PATTERNS) -> str:
    parts = s_sentences(s_clean(x), ".;:")
    return f"list_filter({parts}, lambda p: regexp_matches(p, '[.;:]$') AND NOT {s_heading_text('p', patterns)} AND len(regexp_extract_all(p, '[a-zA-Z]{{2,}}')) >= 4)"


def s_tokens(x: str, stop=C.TOKEN_STOP) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}')), lambda t: NOT list_contains({sql_list(stop)}, t))"


@query("scan_corpus", f"WITH {DOCS_SQL} SELECT authority, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(file) AS first_file FROM docs GROUP BY authority")
def scan_corpus(spark, d):
    return documents(spark, d).groupBy("authority").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.min("file").alias("first_file"))


@query("authority_map", f"WITH {DOCS_SQL} SELECT DISTINCT source, authority, authority = 'SOP' AS is_internal_sop, CASE WHEN authority = 'SOP' THEN 'INTERNAL_SOP' ELSE 'REGULATORY' END AS source_type FROM docs")
def authority_map(spark, d):
    sop = F.col("authority") == "SOP"
    return documents(spark, d).select("source", "authority", sop.alias("is_internal_sop"), F.when(sop, "INTERNAL_SOP").otherwise("REGULATORY").alias("source_type")).distinct()


@query("normalize_line", f"WITH {LINES_SQL} SELECT doc_id, line_no, {s_norm('line')} AS line, {s_key('line')} AS frequency_key FROM lines")
def normalize_line(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.normalize_line(F.col("line")).alias("line"), T.frequency_key(F.col("line")).alias("frequency_key"))


@query("heading_filter", f"WITH {LINES_SQL} SELECT doc_id, line_no, {s_norm('line')} AS heading FROM lines WHERE {s_heading(s_norm('line'))}")
def heading_filter(spark, d):
    line = T.normalize_line(F.col("line"))
    return lines(spark, d).where(T.is_heading(line, PREFIXES)).select("doc_id", "line_no", line.alias("heading"))


@query("artifact_filter", f"WITH {LINES_SQL} SELECT doc_id, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS n_artifacts, CAST(count(*) FILTER (WHERE NOT a) AS BIGINT) AS n_kept FROM (SELECT doc_id, {s_artifact('line')} AS a FROM lines) GROUP BY doc_id")
def artifact_filter(spark, d):
    flagged = lines(spark, d).select("doc_id", T.is_artifact(F.col("line")).alias("a"))
    return flagged.groupBy("doc_id").agg(F.count_if("a").alias("n_artifacts"), F.count_if(~F.col("a")).alias("n_kept"))


_HYPHEN = f"""WITH RECURSIVE {LINES_SQL},
n AS (SELECT doc_id, line_no, {s_norm("CASE WHEN line_no % 2 = 0 THEN regexp_replace(line, '[.,]$', '-') ELSE lower(line) END")} AS line FROM lines),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM n WHERE line <> ''),
c AS (SELECT *, lead(line) OVER w AS nxt, coalesce(regexp_matches(line, '[A-Za-z]{{2,}}-$') AND regexp_matches(lead(line) OVER w, '^\\p{{Ll}}') AND NOT {s_heading('lead(line) OVER w')}, false) AS cond FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT doc_id, i, line_no, line, nxt, cond, cond AS merged FROM c WHERE i = 1 UNION ALL SELECT c.doc_id, c.i, c.line_no, c.line, c.nxt, c.cond, c.cond AND NOT r.merged FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1),
o AS (SELECT *, coalesce(lag(merged) OVER (PARTITION BY doc_id ORDER BY i), false) AS used FROM r)
SELECT doc_id, line_no, CASE WHEN merged THEN left(line, length(line) - 1) || nxt ELSE line END AS line FROM o WHERE NOT used"""


@query("hyphen_merge", _HYPHEN)
def hyphen_merge(spark, d):
    line = F.when(F.col("line_no") % 2 == 0, F.regexp_replace("line", "[.,]$", "-")).otherwise(F.lower("line"))
    return P.merge_hyphenated(lines(spark, d).select("doc_id", "line_no", line.alias("line")), "doc_id", prefixes=PREFIXES).select("doc_id", "line_no", "line")


_REPEAT = f"""WITH {LINES_SQL}, k AS (SELECT DISTINCT doc_id, page_no, {s_key('line')} AS key FROM lines WHERE {s_key('line')} <> ''),
n AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM lines GROUP BY doc_id),
f AS (SELECT doc_id, key, count(*) AS df FROM k GROUP BY doc_id, key)
SELECT f.doc_id, f.key, f.df, n.pages FROM f JOIN n USING (doc_id) WHERE df >= greatest(2, CAST(ceil({C.DEFAULT.repeat_ratio} * pages) AS BIGINT))"""


@query("repeated_lines", _REPEAT)
def repeated_lines(spark, d):
    keyed = lines(spark, d).withColumn("key", T.frequency_key(F.col("line")))
    return P.repeated_lines(keyed, "doc_id", "page_no", "key")


@query("split_sentences", f"SELECT doc_id, unnest({s_sentences('text')}) AS sentence FROM documents")
def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("sentence"))


_TITLE = "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"
_T = f"trim({s_norm('raw')}, ' -_:;,.')"


@query("clean_title", f"WITH t AS (SELECT page_id, {_TITLE} AS raw FROM pages) SELECT page_id, CASE WHEN {_T} = '' OR {s_match(_T, T.TITLE_DROP)} OR length({_T}) < 6 OR {s_letters(_T)} < 4 THEN '' ELSE {_T} END AS title FROM t")
def clean_title(spark, d):
    raw = F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", T.clean_title(raw).alias("title"))


_SCORE = f"""CASE WHEN s = '' OR list_contains({sql_list(C.GENERIC_TITLES)}, lower(s)) OR {s_artifact('s')} THEN -1 ELSE
(CASE WHEN {s_heading('s')} THEN 3 ELSE 0 END) + (CASE WHEN len(list_filter(string_split(s, ' '), lambda w: w <> '')) BETWEEN 3 AND 18 THEN 2 ELSE 0 END) + (CASE WHEN length(s) <= 140 THEN 1 ELSE 0 END) + (CASE WHEN {s_match('lower(s)', T.TITLE_WORDS)} THEN 1 ELSE 0 END) END"""


@query("title_from_first_page", f"WITH {LINES_SQL}, n AS (SELECT doc_id, line_no, {s_norm('line')} AS s FROM lines WHERE page_no = 0), c AS (SELECT *, {_SCORE} AS score FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k FROM c WHERE line_no < 100) SELECT doc_id, s AS title, CAST(score AS INT) AS score FROM r WHERE k = 1 AND score > 0")
def title_from_first_page(spark, d):
    first = lines(spark, d).where("page_no = 0 and line_no < 100")
    scored = first.withColumn("score", T.title_score(F.col("line"), PREFIXES))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no"))
    return scored.withColumn("k", best).where("k = 1 and score > 0").select("doc_id", T.normalize_line(F.col("line")).alias("title"), "score")


@query("clean_text", f"SELECT conv_id, turn, {s_clean('text')} AS text FROM conversations")
def clean_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_text(F.col("text")).alias("text"))


_NOISE = f"lower({s_clean('text')})"


@query("noisy_filter", f"SELECT conv_id, turn, ({_NOISE} = '' OR {s_match(_NOISE, T.DIAGRAM)} OR length({_NOISE}) < 35) AS noisy FROM conversations")
def noisy_filter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_noisy(F.col("text")).alias("noisy"))


@query("similarity_key", f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace({_NOISE}, '\\b\\d+\\b', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), {B}, ' ', 'g')) AS key FROM conversations")
def similarity_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.similarity_key(F.col("text")).alias("key"))


_CUT = f"rtrim(left({s_clean('text')}, 420))"


@query("clip_snippet", f"SELECT doc_id, CASE WHEN length({s_clean('text')}) <= 420 THEN {s_clean('text')} ELSE (CASE WHEN length(regexp_extract({_CUT}, '^(.*) ', 1)) > 120 THEN regexp_extract({_CUT}, '^(.*) ', 1) ELSE {_CUT} END) || ' ...' END AS snippet FROM documents")
def clip_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text")).alias("snippet"))


@query("requirement_language", f"SELECT conv_id, turn, {s_requirement('text')} AS has_requirement FROM conversations")
def requirement_language(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.has_requirement(F.col("text"), STEMS).alias("has_requirement"))


_BP = f"({s_collapsed('text')} = '' OR {s_any(s_collapsed('text'), BOILER)} OR (len(string_split({s_collapsed('text')}, ' ')) <= 12 AND {s_any(s_collapsed('text'), ('guidance', 'guideline'))} AND NOT {s_requirement('text')}))"


@query("boilerplate_filter", f"SELECT conv_id, turn, {_BP} AS boilerplate FROM conversations")
def boilerplate_filter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_boilerplate(F.col("text"), BOILER, STEMS).alias("boilerplate"))


@query("heading_text", f"SELECT doc_id, line_no, {s_heading_text('line')} AS heading FROM (WITH {LINES_SQL} SELECT * FROM lines)")
def heading_text(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.looks_like_heading(F.col("line"), PATTERNS).alias("heading"))


@query("complete_sentences", f"SELECT doc_id, unnest({s_complete('text')}) AS sentence FROM documents")
def complete_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.complete_sentences(F.col("text"), PATTERNS)).alias("sentence"))


_ACRONYMS = ("ER", "THE", "DE", "OF")


def _s_acronyms(x: str) -> str:
    """RE2's word bounds know ASCII alone and it has no lookahead: blanks are doubled so that neighbours share none."""
    x = f"regexp_replace({x}, '([ \\n])', '\\1\\1', 'g')"
    for a in _ACRONYMS:
        x = f"regexp_replace({x}, '(?i)(^|[^\\pL\\pN_]){a}($|[^\\pL\\pN_])', '\\1{a}\\2', 'g')"
    return f"regexp_replace(regexp_replace({x}, '  ', ' ', 'g'), '\\n\\n', chr(10), 'g')"


@query("normalize_acronyms", f"SELECT item_id, {_s_acronyms('text')} AS text FROM benchmark")
def normalize_acronyms(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.normalize_acronyms(F.col("text"), _ACRONYMS).alias("text"))


_TRIM_STOP = ("the", "of", "and", "is", "de", "la", "der", "to", "in", "on", "er")
_W = f"list_filter(string_split(regexp_replace(text, {B}, ' ', 'g'), ' '), lambda w: w <> '')"
_TRIM = f"""WITH w AS (SELECT conv_id, turn, {_W} AS w FROM conversations),
h AS (SELECT *, w[1:30] AS head, list_transform(w[1:30], lambda x: NOT list_contains({sql_list(_TRIM_STOP)}, lower(trim(x, '.,;:')))) AS good FROM w),
c AS (SELECT *, head[1:len(good) - coalesce(list_position(list_reverse(good), true) - 1, len(good))] AS kept FROM h)
SELECT conv_id, turn, CASE WHEN len(w) <= 30 THEN array_to_string(w, ' ') WHEN len(kept) < 4 THEN '' WHEN regexp_matches(kept[len(kept)], '[.;:]$') THEN array_to_string(kept, ' ') ELSE array_to_string(kept, ' ') || '.' END AS sentence FROM c"""


@query("trim_sentence", _TRIM)
def trim_sentence(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.trim_words(F.col("text"), 30, _TRIM_STOP).alias("sentence"))


@query("capitalize_first", "SELECT doc_id, CASE WHEN regexp_matches(line, '\\p{L}') THEN regexp_extract(line, '(?s)^([^\\p{L}]*)', 1) || upper(regexp_extract(line, '(?s)^[^\\p{L}]*(\\p{L})', 1)) || regexp_extract(line, '(?s)^[^\\p{L}]*\\p{L}(.*)$', 1) ELSE line END AS line FROM (SELECT doc_id, '- ' || lower(text) AS line FROM documents)")
def capitalize_first(spark, d):
    line = F.concat(F.lit("- "), T.lower(F.col("text")))
    return table(spark, d, "documents").select("doc_id", T.capitalize_first(line).alias("line"))


@query("truncated_endings", f"SELECT conv_id, turn, (s = '' OR {s_match('s', S_TRUNCATED)} OR ends_with(s, 'with a.') OR ends_with(s, 'and .')) AS truncated FROM (SELECT conv_id, turn, lower(trim(text)) AS s FROM conversations)")
def truncated_endings(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.looks_truncated(F.col("text")).alias("truncated"))


@query("tokenize", f"SELECT item_id, list_sort({s_tokens('text')}) AS tokens FROM benchmark")
def tokenize(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_sort(T.tokens(F.col("text"))).alias("tokens"))
