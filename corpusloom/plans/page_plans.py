"""Page-label, block, chunk and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T
from corpusloom.operators import chunking as K
from corpusloom.operators import pages as P
from corpusloom.plans.fixtures import DOCS_SQL, LINES_SQL, PREFIXES, documents, lines, sql_list, stored, table
from corpusloom.plans.registry import query
from corpusloom.plans.text_plans import s_artifact, s_heading, s_norm, s_sentences

# A page's printed number, planted for the test: every third line ends a page's header or footer in a number or numeral.
_LABEL = "CASE WHEN line_no % 5 = 4 THEN CAST(page_no + 1 + (CASE WHEN (doc_id + page_no) % 7 = 3 THEN 40 ELSE 0 END) AS VARCHAR) WHEN line_no % 5 = 1 AND doc_id % 3 = 0 THEN 'Guideline' WHEN line_no % 5 = 2 AND doc_id % 3 = 0 THEN 'iv' ELSE line END"


def page_lines(spark, d):
    """Lines with planted page numbers, guideline marks and numerals."""
    n = F.col("page_no") + 1 + F.when((F.col("doc_id") + F.col("page_no")) % 7 == 3, 40).otherwise(0)
    third = F.col("doc_id") % 3 == 0
    line = F.when(F.col("line_no") % 5 == 4, n.cast("string")).when((F.col("line_no") % 5 == 1) & third, "Guideline").when((F.col("line_no") % 5 == 2) & third, "iv").otherwise(F.col("line"))
    kept = lines(spark, d).withColumn("line", F.trim(line)).where("line <> ''")
    from pyspark.sql import Window

    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("line_no")) - 1)


def labels(spark, d):
    return P.derive_labels(page_lines(spark, d), ["doc_id"], "page_no")


_PAGES = f"""{LINES_SQL}, pl AS (SELECT doc_id, page_no, trim(line) AS line, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS pos FROM (SELECT doc_id, page_no, line_no, {_LABEL} AS line FROM lines) WHERE trim(line) <> ''),
pn AS (SELECT *, {s_norm('line')} AS t, count(*) OVER (PARTITION BY doc_id, page_no) AS n, min(CASE WHEN contains(lower(line), 'guideline') THEN pos END) OVER (PARTITION BY doc_id, page_no) AS mark, coalesce(regexp_matches(lead(line) OVER (PARTITION BY doc_id, page_no ORDER BY pos), '\\p{{L}}'), false) AS wordy FROM pl),
pv AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]{{1,4}}$') AND CAST(regexp_extract(t, '^[0-9]{{1,4}}$') AS VARCHAR) <> '' THEN TRY_CAST(t AS INT) END AS v0, CASE WHEN regexp_matches(t, '{P.ROMAN}') THEN lower(t) END AS r, pos >= n - 15 AS foot, coalesce(pos > mark AND pos <= mark + 8, false) AS head FROM pn),
pw AS (SELECT *, CASE WHEN v0 BETWEEN 1 AND 500 THEN v0 END AS v, pos < 15 OR foot AS wide FROM pv),
px AS (SELECT *, max(CASE WHEN foot AND (v IS NOT NULL OR r IS NOT NULL) THEN 1 END) OVER (PARTITION BY doc_id, page_no) IS NOT NULL AS footed FROM pw),
ph AS (SELECT *, CASE WHEN head AND v <= (CASE WHEN page_no < 20 THEN 30 ELSE 500 END) AND NOT coalesce(footed AND pos < 15 AND v <= 20 AND wordy, false) THEN v END AS hv FROM px),
pa AS (SELECT doc_id, page_no, CAST(arg_max(v, pos) FILTER (WHERE foot AND v IS NOT NULL) AS VARCHAR) AS a, arg_max(r, pos) FILTER (WHERE foot AND r IS NOT NULL) AS b, CAST(min(hv) AS VARCHAR) AS c, arg_max(r, pos) FILTER (WHERE head AND r IS NOT NULL) AS e, CAST(min(v) FILTER (WHERE wide) AS VARCHAR) AS f, arg_max(r, pos) FILTER (WHERE wide AND r IS NOT NULL) AS g,
list_sort(coalesce(list(DISTINCT coalesce(CASE WHEN foot THEN v END, hv)) FILTER (WHERE coalesce(CASE WHEN foot THEN v END, hv) IS NOT NULL), [])) AS near, list_sort(coalesce(list(DISTINCT coalesce(v, hv)) FILTER (WHERE wide AND coalesce(v, hv) IS NOT NULL), [])) AS far FROM ph GROUP BY doc_id, page_no),
lab AS (SELECT doc_id, page_no, coalesce(a, b, c, e, f, g) AS label, CASE WHEN coalesce(a, b, c, e) IS NULL AND coalesce(f, g) IS NOT NULL THEN far ELSE near END AS candidates FROM pa)"""


@query("derive_page_label", f"WITH {_PAGES} SELECT * FROM lab")
def derive_page_label(spark, d):
    return labels(spark, d)


_SMOOTH = f"""WITH RECURSIVE {_PAGES},
nums AS (SELECT *, CASE WHEN regexp_matches(label, '^[0-9]{{1,4}}$') THEN CAST(label AS INT) END AS v, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM lab),
nx AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY page_no) AS x FROM nums),
sm AS (SELECT doc_id, page_no, i, label, candidates, v AS now, x FROM nx WHERE i = 1
UNION ALL SELECT n.doc_id, n.page_no, n.i, CASE WHEN c THEN CAST(p + 1 AS VARCHAR) ELSE n.label END, n.candidates, CASE WHEN c THEN p + 1 ELSE n.v END, n.x
FROM (SELECT n.*, s.now AS p, coalesce(n.x = s.now + 2 AND (n.v IS NULL OR n.v <> s.now + 1) AND (list_contains(n.candidates, s.now + 1) OR n.v IS NULL OR abs(n.v - s.now - 1) >= 10), false) AS c FROM sm s JOIN nx n ON n.doc_id = s.doc_id AND n.i = s.i + 1) n)
SELECT doc_id, page_no, label FROM sm"""


@query("smooth_page_labels", _SMOOTH)
def smooth_page_labels(spark, d):
    return P.smooth_labels(labels(spark, d), "doc_id", "page_no").select("doc_id", "page_no", "label")


@query("display_page", f"WITH {_PAGES} SELECT doc_id, page_no, coalesce(nullif(trim(CASE WHEN page_no % 4 = 0 THEN ' ' ELSE label END), ''), CASE WHEN page_no >= 0 THEN CAST(page_no + 1 AS VARCHAR) END, '?') AS page FROM lab")
def display_page(spark, d):
    label = F.when(F.col("page_no") % 4 == 0, F.lit(" ")).otherwise(F.col("label"))
    return labels(spark, d).select("doc_id", "page_no", P.display_page(label, F.col("page_no")).alias("page"))


@query("inspect_page_labels", f"WITH {_PAGES} SELECT doc_id, page_no, page_no + 1 AS page, label FROM lab WHERE page_no < 10")
def inspect_page_labels(spark, d):
    return labels(spark, d).where("page_no < 10").select("doc_id", "page_no", (F.col("page_no") + 1).alias("page"), "label")


@query("labels_trivial", f"WITH {_PAGES} SELECT doc_id, bool_and(coalesce(CAST(nullif(regexp_extract(label, '(?i)^\\s*(?:page\\s+)?0*([0-9]{{1,6}})\\s*$', 1), '') AS INT) = page_no + 1, false)) AS trivial FROM lab GROUP BY doc_id")
def labels_trivial(spark, d):
    rows = labels(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "label"))).alias("l"), F.max("page_no").alias("n"))
    found = F.transform("l", lambda x: F.coalesce(x["label"], F.lit("")))
    # A page without lines has no label: fewer labels than pages, which isn't trivial.
    return rows.select("doc_id", P.labels_trivial(found, F.col("n") + 1).alias("trivial"))


def blocks(spark, d):
    return K.build_blocks(lines(spark, d), ["doc_id", "page_no"], "line_no", PREFIXES)


def chunk_table(spark, d, most=400, least=120):
    """Chunks of all documents, small so that short fixtures have several."""

    def build(spark, d):
        pages = documents(spark, d).select("doc_id", "file", "authority")
        return K.chunk(blocks(spark, d), ["doc_id", "page_no"], most, least).join(pages, "doc_id")

    return stored(spark, d, f"chunks {most} {least}", build)


_BLOCKS = f"""{LINES_SQL}, bn AS (SELECT doc_id, page_no, line_no, {s_norm('line')} AS line FROM lines),
bf AS (SELECT *, line = '' OR {s_artifact('line')} AS gap, NOT (line = '' OR {s_artifact('line')}) AND {s_heading('line')} AS head FROM bn),
bs AS (SELECT *, gap OR head OR coalesce(lag(gap OR head) OVER w, true) OR coalesce(regexp_matches(lag(line) OVER w, '[.!?]$'), false) AS brk, coalesce(last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER w, 'Unknown') AS section FROM bf WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
bg AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM bs),
bl AS (SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY g) AS INT) AS block, section, text FROM (SELECT doc_id, page_no, g, section, string_agg(line, ' ' ORDER BY line_no) AS text FROM bg WHERE NOT gap AND NOT head GROUP BY doc_id, page_no, g, section))"""


@query("build_blocks", f"WITH {_BLOCKS} SELECT * FROM bl")
def build_blocks(spark, d):
    return blocks(spark, d)


# Parts: sentences of an oversize block packed greedily; chunks: parts packed greedily; both as folds over positions.
def chunk_sql(most: int = 400, least: int = 120) -> str:
    return f"""{_BLOCKS},
se AS (SELECT doc_id, page_no, block, section, CASE WHEN length(text) > {most} THEN {s_sentences('text')} ELSE [text] END AS s FROM bl),
sx AS (SELECT doc_id, page_no, block, section, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM se),
pk AS (SELECT doc_id, page_no, block, section, i, s, 1 AS part, length(s) AS n FROM sx WHERE i = 1
UNION ALL SELECT x.doc_id, x.page_no, x.block, x.section, x.i, x.s, p.part + CASE WHEN p.n + 1 + length(x.s) <= {most} THEN 0 ELSE 1 END, CASE WHEN p.n + 1 + length(x.s) <= {most} THEN p.n + 1 + length(x.s) ELSE length(x.s) END FROM pk p JOIN sx x ON x.doc_id = p.doc_id AND x.page_no = p.page_no AND x.block = p.block AND x.i = p.i + 1),
pt AS (SELECT doc_id, page_no, section, text, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY block, part) AS i FROM (SELECT doc_id, page_no, block, part, any_value(section) AS section, string_agg(s, ' ' ORDER BY i) AS text FROM pk GROUP BY doc_id, page_no, block, part)),
ck AS (SELECT doc_id, page_no, i, section, text, 1 AS c, length(text) AS n FROM pt WHERE i = 1
UNION ALL SELECT t.doc_id, t.page_no, t.i, t.section, t.text, k.c + CASE WHEN k.n + 1 + length(t.text) > {most} THEN 1 ELSE 0 END, CASE WHEN k.n + 1 + length(t.text) > {most} THEN length(t.text) ELSE k.n + 1 + length(t.text) END FROM ck k JOIN pt t ON t.doc_id = k.doc_id AND t.page_no = k.page_no AND t.i = k.i + 1),
cu AS (SELECT doc_id, page_no, c, arg_min(section, i) AS section, string_agg(text, chr(10) ORDER BY i) AS text FROM ck GROUP BY doc_id, page_no, c),
cg AS (SELECT *, sum(CASE WHEN c = 1 OR length(text) >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY c ROWS UNBOUNDED PRECEDING) AS g FROM cu),
chunks AS (SELECT m.doc_id, 'doc_' || m.doc_id AS file, authority, page_no AS pdf_index, page_no + 1 AS page, 'p' || page_no || '_c' || g AS chunk_id, CAST(g AS INT) AS seq, m.section AS section, m.text AS text FROM (SELECT doc_id, page_no, CAST(g AS INT) AS g, arg_min(section, c) AS section, string_agg(text, chr(10) ORDER BY c) AS text FROM cg GROUP BY doc_id, page_no, g) m JOIN docs USING (doc_id))"""


@query("chunk_documents", f"WITH RECURSIVE {chunk_sql()} SELECT doc_id, pdf_index, page, chunk_id, section, text FROM chunks")
def chunk_documents(spark, d):
    return chunk_table(spark, d).select("doc_id", "pdf_index", "page", "chunk_id", "section", "text")


@query("merge_short_chunks", f"WITH RECURSIVE {chunk_sql()} SELECT doc_id, page_no, CAST(count(*) AS BIGINT) AS n_before, CAST(count(DISTINCT g) AS BIGINT) AS n_after, CAST(min(length(text)) AS INT) AS shortest FROM cg GROUP BY doc_id, page_no")
def merge_short_chunks(spark, d):
    packed = K.pack(blocks(spark, d), ["doc_id", "page_no"], 400)
    merged = K.merge_groups(packed, ["doc_id", "page_no"], 120)
    return merged.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_before"), F.countDistinct("g").alias("n_after"), F.min(F.length("text")).alias("shortest"))


_RAW = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(NULL AS INT) WHEN doc_id % 3 = 1 THEN -2 ELSE CAST(doc_id % 11 AS INT) END AS pdf_index, CAST(doc_id % 13 AS INT) AS page, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE 'A-' || doc_id END AS page_label, CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE 'p' || doc_id % 13 || '_c' || doc_id % 4 END AS chunk_id FROM documents"


def raw_chunks(spark, d):
    return table(spark, d, "documents").selectExpr(
        "doc_id", "case when doc_id % 3 = 0 then cast(null as int) when doc_id % 3 = 1 then -2 else cast(doc_id % 11 as int) end as pdf_index", "cast(doc_id % 13 as int) as page",
        "case when doc_id % 2 = 0 then ' ' else concat('A-', doc_id) end as page_label", "case when doc_id % 5 = 0 then 'bad' else concat('p', doc_id % 13, '_c', doc_id % 4) end as chunk_id",
    )


_MIGRATED = f"""raw AS ({_RAW}), mi AS (SELECT *, nullif(regexp_extract(chunk_id, '^p(-?[0-9]+)_c([0-9]+)$', 1), '') AS pg, nullif(regexp_extract(chunk_id, '^p(-?[0-9]+)_c([0-9]+)$', 2), '') AS sq FROM raw),
md AS (SELECT doc_id, greatest(0, coalesce(pdf_index, page)) AS idx, page_label, chunk_id, pg, coalesce(CAST(sq AS INT), 1) AS sq FROM mi)"""


@query("migrate_chunks", f"WITH {_MIGRATED} SELECT doc_id, idx AS pdf_index, idx + 1 AS page, nullif(trim(page_label), '') AS page_label, 'p' || idx || '_c' || greatest(1, sq) AS chunk_id FROM md")
def migrate_chunks(spark, d):
    return K.migrate(raw_chunks(spark, d)).select("doc_id", "pdf_index", "page", "page_label", "chunk_id")


@query("chunk_id_audit", f"WITH {_MIGRATED} SELECT coalesce(CAST(pg AS INT) = idx, false) AS consistent, count(*) AS n FROM md GROUP BY 1")
def chunk_id_audit(spark, d):
    return K.audit_ids(raw_chunks(spark, d)).groupBy("consistent").agg(F.count("*").alias("n"))


_INTEGRITY = f"""WITH RECURSIVE {chunk_sql()}, ex AS (SELECT file, authority, doc_id FROM docs), n AS (SELECT ex.file, ex.authority, count(c.chunk_id) AS n FROM ex LEFT JOIN chunks c ON c.doc_id = ex.doc_id GROUP BY ex.file, ex.authority)"""


def chunk_counts(spark, d):
    """Chunks per expected document, none among them."""
    counts = chunk_table(spark, d).groupBy("file").agg(F.count("*").alias("n"))
    return documents(spark, d).select("file", "authority").join(counts, "file", "left").fillna(0, ["n"])


@query("index_integrity", f"{_INTEGRITY} SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_chunks, count(*) FILTER (WHERE n = 0) AS zero_docs, sha256(string_agg(file || ':' || n, chr(10) ORDER BY file || ':' || n)) AS content_hash FROM n")
def index_integrity(spark, d):
    return K.integrity_report(chunk_counts(spark, d))


@query("zero_chunk_docs", f"{_INTEGRITY} SELECT file, authority FROM n WHERE n = 0")
def zero_chunk_docs(spark, d):
    return chunk_counts(spark, d).where("n = 0").select("file", "authority")


@query("doc_profiles", f"WITH RECURSIVE {chunk_sql()} SELECT file, authority, file || ' ' || left(arg_min(text, pdf_index * 100000 + seq), 500) AS profile FROM chunks GROUP BY file, authority")
def doc_profiles(spark, d):
    return K.profiles(chunk_table(spark, d))


_AUDIT = ("enther", "ndea", "thest", "keit", "eauai", "blead", "nowhere at all")


@query("token_presence", f"""WITH RECURSIVE {chunk_sql()}, tk AS (SELECT unnest({sql_list(_AUDIT)}) AS token), h AS (SELECT token, file, pdf_index, seq, chunk_id, row_number() OVER (PARTITION BY token ORDER BY doc_id, pdf_index, seq) AS k FROM tk JOIN chunks ON contains(lower(text), token))
SELECT tk.token, count(h.file) AS n_chunks, coalesce(string_agg(h.file || ':' || h.chunk_id, ';' ORDER BY k) FILTER (WHERE k <= 5), '') AS examples FROM tk LEFT JOIN h USING (token) GROUP BY tk.token""")
def token_presence(spark, d):
    return K.token_presence(chunk_table(spark, d), _AUDIT)
