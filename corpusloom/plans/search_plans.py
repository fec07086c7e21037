"""Index and retrieval queries over chunks of the documents and questions from benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.config import DEFAULT
from corpusloom.functions import query as Q
from corpusloom.operators import blocks as B
from corpusloom.operators import index as I
from corpusloom.operators import retrieval as R
from corpusloom.operators import routing as G
from corpusloom.operators import upkeep as U
from corpusloom.plans.fixtures import LEXICON, QUESTIONS_SQL, SIGNALS, STOP_WORDS, questions, quoted, sql_list, stored
from corpusloom.operators import chunking as K
from corpusloom.functions import text as T
from corpusloom.plans.page_plans import chunk_sql, chunk_table
from corpusloom.plans.query_plans import _ANCHORS, _BROAD as _BROAD_Q, _WIDE, ACR, ANCH, APR, BROAD, OOS, SYN, TOPIC_WORDS, TRIG, VALID, _s_domain, s_count, s_distinct, s_expand, s_normalize, s_word
from corpusloom.plans.registry import query
from corpusloom.sources.index_store import kept
from corpusloom.plans.text_plans import s_any, s_collapsed

CH = chunk_sql(1000, 220)
PROFILES = (
    {"signals": ("ou", "ment"), "authority": {"FDA": 0.12, "ICH": 0.05}, "file": (("doc_1", 0.04),), "text": (("eauai", 0.06),)},
    {"signals": ("ing", "keit"), "authority": {"EU_GMP": 0.08}, "file": (("7", 0.02),), "text": (("thest", 0.03), ("enther", 0.05))},
)
SOP_SIGNALS, TOC = ("thest", "oush"), "reouou"
#: Queries ask for rows from here on: the fallback's threshold, or what the largest boost lifts to the search's.
LEAST = min(DEFAULT.fallback_similarity, DEFAULT.min_similarity - DEFAULT.max_boost)


def scope():
    """A scope per question, an unknown one among them."""
    return F.element_at(F.array(*[F.lit(s) for s in ("MIXED", "FDA", "EMA", "SOPS", "odd")]), (F.col("qid") % 5 + 1).cast("int"))


def chunks(spark, d):
    return chunk_table(spark, d, 1000, 220)


def postings_of(spark, d, rows):
    """(KEY, term, weight) of the word space for the chunks of some rows, terms by their keys: a chunk's weights need no other chunk's, but the frequencies. Terms that those don't name are of one chunk."""
    every = chunks(spark, d)
    tf = kept(B.term_rows(every.join(rows.select(*R.KEY).distinct(), R.KEY, "left_semi"), R.KEY, {"word": word_terms.in_blocks}, "text").drop("space"))
    df = F.coalesce("df", F.lit(1))
    vocab = tf.select("term").distinct().join(B.shared_terms(counted(spark, d)[1]), "term", "left").select("term", I.idf(F.lit(every.count()), df).alias("idf"))
    return I.weights(tf, vocab, R.KEY)


VARIANT = ["qid", "variant_no"]
TOPICS = {k: (words, C.TOPICS[k][1]) for k, words in TOPIC_WORDS.items()}


def asks(spark, d):
    """(qid, variant_no, q_aug, scope): all forms in which a question is searched, itself first and the one with its anchors last."""
    q = F.col("question")
    found = Q.variants(q, ("of", "and", "the"), SYN, ACR, broad(q))
    terms = Q.anchors(q, TRIG, ANCH)
    anchored = F.when(F.size(terms) > 0, F.array(T.normalize_query(F.concat_ws(" ", T.normalize_query(q), F.array_join(terms, " "))))).otherwise(F.array().cast("array<string>"))
    return questions(spark, d).select("qid", F.posexplode(F.array_distinct(F.concat(found, anchored))).alias("variant_no", "q_aug"), scope().alias("scope"))


def asked(spark, d):
    """Questions with their scope; the text searched is the normalised question."""
    return asks(spark, d).where("variant_no = 0").drop("variant_no")


def word_terms(text):
    return I.word_terms(text, STOP_WORDS)


word_terms.in_blocks = B.pairs(STOP_WORDS)
SPACES = {"word": word_terms, "char": I.char_terms}


# SQL twins.
def s_word_terms(x: str) -> str:
    w = f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({sql_list(STOP_WORDS)}, t))"
    return f"list_concat({w}, list_transform(list_zip(list_slice({w}, 1, len({w}) - 1), list_slice({w}, 2, len({w}))), lambda p: p[1] || ' ' || p[2]))"


def s_char_terms(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({x}), '[\\s\\p{{Z}}]+', ' ', 'g'), ' '), lambda t: t <> '')"
    windows = "list_transform(range(1, greatest(2, length(p) - k + 2)), lambda i: p[i:i + k - 1])"
    one = f"flatten(list_transform([3, 4, 5], lambda k: CASE WHEN length(p) >= k THEN {windows} WHEN k = 3 THEN [p] ELSE [] END))"
    return f"flatten(list_transform({words}, lambda w: list_transform([' ' || w || ' '], lambda p: {one})[1]))"


def s_space(name: str, terms) -> str:
    """CTEs <name>_tf, <name>_v (vocabulary), <name>_d (document weights), <name>_q (question weights), <name>_s (similarities)."""
    n = name
    return f"""{n}_t AS (SELECT file, pdf_index, chunk_id, unnest({terms('text')}) AS term FROM chunks), {n}_tf AS (SELECT file, pdf_index, chunk_id, term, count(*) AS tf FROM {n}_t GROUP BY ALL),
{n}_v AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM chunks)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM {n}_tf GROUP BY term),
{n}_d AS (SELECT file, pdf_index, chunk_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY file, pdf_index, chunk_id)) AS weight FROM {n}_tf JOIN {n}_v USING (term)),
{n}_qt AS (SELECT qid, variant_no, term, count(*) AS tf FROM (SELECT qid, variant_no, unnest({terms('q')}) AS term FROM asks) GROUP BY ALL),
{n}_q AS (SELECT qid, variant_no, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid, variant_no)) AS weight FROM {n}_qt JOIN {n}_v USING (term)),
{n}_s AS (SELECT qid, variant_no, file, pdf_index, chunk_id, sum(q.weight * d.weight) AS sim FROM {n}_q q JOIN {n}_d d USING (term) GROUP BY ALL)"""


_ASKS = f"""qn AS (SELECT qid, question, {s_normalize('question')} AS s, trim(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS a FROM questions),
qe AS (SELECT qid, s, {s_distinct(s_expand())}[1:5] AS e, CASE WHEN {_BROAD_Q} THEN [{_WIDE}] ELSE [] END AS w, {_ANCHORS} AS l FROM qn),
qv AS (SELECT qid, list_concat(list_concat(e, w), CASE WHEN len(l) > 0 THEN [{s_normalize("s || ' ' || array_to_string(" + s_distinct('l') + ", ' ')")}] ELSE [] END) AS every FROM qe),
asks AS MATERIALIZED (SELECT qid, unnest(range(0, len(u))) AS variant_no, unnest(u) AS q FROM (SELECT qid, {s_distinct('every')} AS u FROM qv))"""
_BASE = f"WITH RECURSIVE {CH.replace('chunks AS (', 'chunks AS MATERIALIZED (')}, {QUESTIONS_SQL}, {_ASKS}"
_WORD, _CHAR = s_space("w", s_word_terms), s_space("c", s_char_terms)


def s_toks(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{3,}}')), lambda t: NOT list_contains({sql_list(R.C.SEARCH_STOP)}, t))"


_OVER = f"""qk AS (SELECT qid, variant_no, unnest({s_toks('q')}) AS token, len({s_toks('q')}) AS n FROM asks), ckk AS (SELECT file, pdf_index, chunk_id, unnest({s_toks('text')}) AS token FROM chunks),
ov AS (SELECT qid, variant_no, file, pdf_index, chunk_id, CAST(count(*) AS DOUBLE) / any_value(n) AS overlap FROM qk JOIN ckk USING (token) GROUP BY ALL)"""


def s_prior() -> str:
    q, f, t = "lower(q)", "lower(file)", "lower(text)"
    parts = []
    for p in PROFILES:
        inner = [f"CASE WHEN authority = '{a}' THEN {b} ELSE 0 END" for a, b in p["authority"].items()]
        inner += [f"CASE WHEN contains({f}, {quoted(x)}) THEN {b} ELSE 0 END" for x, b in p["file"]]
        inner += [f"CASE WHEN contains({t}, {quoted(x)}) THEN {b} ELSE 0 END" for x, b in p["text"]]
        parts.append(f"CASE WHEN {s_any(q, p['signals'])} THEN {' + '.join(inner)} ELSE 0 END")
    parts.append(f"CASE WHEN {s_any(q, ('thest', 'oush'))} AND authority = 'SOP' THEN 0.22 ELSE 0 END")
    parts.append(f"-(CASE WHEN contains({t}, 'reouou') THEN 0.06 ELSE 0 END) - (CASE WHEN length({t}) < 80 THEN 0.03 ELSE 0 END)")
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


def prior_column():
    return R.prior(F.col("q_aug"), F.col("authority"), F.col("file"), F.col("text"), PROFILES, sop_signals=SOP_SIGNALS, toc=TOC)


def s_hits(x: str) -> str:
    s = s_collapsed(x)
    s = f"regexp_replace({s}, ' ', '  ', 'g')"
    parts = []
    for sig in SIGNALS:
        pattern = "(^|[^\\pL\\pN_])" + sig.replace(" ", "  ") + "($|[^\\pL\\pN_])"
        parts.append(f"len(regexp_extract_all({s}, '{pattern}'))")
    return f"least(3, {' + '.join(parts)})"


def broad(q):
    return Q.broad_requirement(q, **BROAD)


_BROAD = f"({s_word('q', [BROAD['marker']])} AND {s_word('q', BROAD['include'])} AND NOT {s_any('q', BROAD['exclude'])})"
_SCOPE = "['MIXED', 'FDA', 'EMA', 'SOPS', 'odd'][1 + qid % 5]"
_ADMIT = f"(CASE {_SCOPE} WHEN 'FDA' THEN authority = 'FDA' WHEN 'EMA' THEN list_contains(['EMA', 'EU_GMP', 'PIC_S'], authority) WHEN 'SOPS' THEN authority = 'SOP' ELSE true END)"
# Every question with every chunk.
_SCORED = f"""{_OVER}, ch AS MATERIALIZED (SELECT file, pdf_index, chunk_id, authority, text, {s_hits('text')} AS hit FROM chunks), qb AS (SELECT qid, variant_no, q, {_BROAD} AS broad FROM asks),
sc AS (SELECT qid, variant_no, file, pdf_index, chunk_id, authority, {_SCOPE} AS scope, {_ADMIT} AS admitted, coalesce(w.sim, 0) AS sim_word, coalesce(c.sim, 0) AS sim_char, coalesce(ov.overlap, 0) AS overlap, {s_prior()} AS prior, CASE WHEN broad THEN hit ELSE 0 END AS hits FROM qb CROSS JOIN ch LEFT JOIN w_s w USING (qid, variant_no, file, pdf_index, chunk_id) LEFT JOIN c_s c USING (qid, variant_no, file, pdf_index, chunk_id) LEFT JOIN ov USING (qid, variant_no, file, pdf_index, chunk_id)),
bs2 AS (SELECT *, 0.62 * sim_word + 0.28 * sim_char + 0.10 * overlap + prior AS base, CAST(CASE WHEN hits > 0 THEN least(0.015, hits * 0.005) ELSE 0 END AS DOUBLE) AS boost FROM sc),
fa AS MATERIALIZED (SELECT *, base + boost AS final FROM bs2), fs AS (SELECT * FROM fa WHERE variant_no = 0)"""
_ALL = f"{_BASE}, {_WORD}, {_CHAR}, {_SCORED}"
_RANKED = f"{_ALL}, el AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(final, 12) DESC, round(base, 12) DESC, file, pdf_index, chunk_id) AS INT) AS rank FROM fs WHERE admitted AND base >= 0.2), rk AS (SELECT * FROM el WHERE rank <= 8)"


def all_scored(spark, d):
    """Rows of every search, of all forms of all questions, whose base score is LEAST or more."""
    return stored(spark, d, "scored", build_scored)


def scored(spark, d):
    """all_scored of the questions themselves."""
    return all_scored(spark, d).where("variant_no = 0")


def vocabulary(spark, d):
    """(space, term, df, idf) of both spaces over all chunks."""
    return stored(spark, d, "vocabulary", lambda spark, d: I.counted_vocabulary(chunks(spark, d), R.KEY, SPACES, "text"))


def counted(spark, d):
    """(asked, told): the terms of all forms of all questions, and what the blocks of chunks are told of theirs."""
    asked = stored(spark, d, "asked_terms", lambda spark, d: R.asked_keys(R.question_terms(asks(spark, d), SPACES, VARIANT)))
    return asked, stored(spark, d, "told", lambda spark, d: R.told(chunks(spark, d), R.blocks_of(chunks(spark, d))[1], asked, SPACES))


def reaching(spark, d, q, least, best=None):
    q = q.withColumn("bits", R.switched_on(F.col("q_aug"), PROFILES, SOP_SIGNALS))
    parts = R.prior_parts(F.col("authority"), F.col("file"), F.col("text"), PROFILES, TOC)
    x = R.score_reaching(q, chunks(spark, d), SPACES, None, least, parts, R.requirement_hits(F.col("text"), SIGNALS), broad(F.col("q_aug")), VARIANT, counted=counted(spark, d), best=best)
    x = x.withColumn("admitted", R.in_scope(F.col("scope"), F.col("authority")))
    return x.drop("sim_word", "sim_char", "overlap", "boost")


def build_scored(spark, d):
    return reaching(spark, d, asks(spark, d), LEAST)


def best_scored(spark, d):
    """Of all_scored, with `allowed`: rows that may be among the best of a form under a rule of Phase A, all of the best among them."""

    def build(spark, d):
        mine = allowed(spark, d)
        files = mine.groupBy("qid").agg(F.collect_set("file").alias("_files"))
        q = asks(spark, d).withColumn("_scope", R.admitted_authorities(F.col("scope"))).join(files, "qid", "left")
        least, lower = DEFAULT.min_similarity, DEFAULT.fallback_similarity
        rules = [(True, True, least), (True, False, least), (False, False, least), (True, True, lower)]
        return with_allowed(reaching(spark, d, q, min(least, lower), (DEFAULT.pipeline_top_k, rules)), mine)

    return stored(spark, d, "best_scored", build)


def best_of_questions(spark, d):
    """Of scored: rows that may be among the best 12 that a question's scope admits, all of those among them."""

    def build(spark, d):
        q = asked(spark, d).withColumn("variant_no", F.lit(0)).withColumn("_scope", R.admitted_authorities(F.col("scope"))).withColumn("_files", F.lit(None).cast("array<string>"))
        return reaching(spark, d, q, DEFAULT.min_similarity, (DEFAULT.pipeline_top_k, [(True, False, DEFAULT.min_similarity)]))

    return stored(spark, d, "best_of_questions", build)


def with_text(spark, d, rows):
    return rows.join(chunks(spark, d).select(*R.KEY, "text"), R.KEY)


def ranked(spark, d, top_k=8):
    assert top_k <= DEFAULT.pipeline_top_k
    return R.rank(best_of_questions(spark, d).where("admitted"), ["qid"], top_k, DEFAULT.min_similarity)


@query("tfidf_word", f"{_BASE}, {_WORD} SELECT term, df, round(idf, 6) AS idf FROM w_v")
def tfidf_word(spark, d):
    c = chunks(spark, d)
    v = I.vocabulary(I.counts(c, R.KEY, word_terms(F.col("text"))), c.agg(F.count("*").alias("n")))
    return v.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_char", f"{_BASE}, {_CHAR} SELECT term, df, round(idf, 6) AS idf FROM c_v")
def tfidf_char(spark, d):
    return R.block_vocabulary(chunks(spark, d), I.char_terms).select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_postings", f"{_BASE}, {_WORD} SELECT file, chunk_id, term, round(weight, 6) AS weight FROM w_d")
def tfidf_postings(spark, d):
    return R.block_postings(chunks(spark, d), "word", word_terms).select("file", "chunk_id", "term", F.round("weight", 6).alias("weight"))


@query("index_roundtrip", f"{_BASE}, {_WORD} SELECT file, pdf_index, chunk_id, term, tf, df, round(idf, 6) AS idf, text FROM w_tf JOIN w_v USING (term) JOIN (SELECT file, pdf_index, chunk_id, text FROM chunks) USING (file, pdf_index, chunk_id)")
def index_roundtrip(spark, d):
    """The rows of an index's three tables, joined after they were saved and loaded."""
    from corpusloom.sources import index_store

    c = chunks(spark, d)
    tf = I.counts(c, R.KEY, word_terms(F.col("text")))
    meta = {"version": "1", "chunk_chars": "1000"}
    path = index_store.scratch(spark)
    index_store.save(path, meta, {"chunks": c, "postings": tf, "vocabulary": I.vocabulary(tf, c.agg(F.count("*").alias("n")))})
    t = index_store.load(spark, path, meta)
    x = t["postings"].join(t["vocabulary"], "term").join(t["chunks"].select(*R.KEY, "text"), R.KEY)
    return x.select(*R.KEY, "term", "tf", "df", F.round("idf", 6).alias("idf"), "text")


def older(spark, d):
    """An older state of the corpus: every third document without its last line, some not yet there, and one beside every fifth that is no longer."""
    from corpusloom.plans.fixtures import documents

    x = documents(spark, d)
    last = F.length(F.substring_index("text", "\n", -1))  # a pattern for the last line would be tried from every character of every line
    cut = F.when(F.col("doc_id") % 3 == 0, F.left("text", F.length("text") - last - 1)).otherwise(F.col("text"))
    kept = x.where("doc_id % 7 <> 3 or doc_id is null").withColumn("text", cut)
    gone = x.where("doc_id % 5 = 0").withColumn("doc_id", -1 - F.col("doc_id")).withColumn("file", F.concat(F.lit("old_"), F.col("file")))
    return kept.unionByName(gone)


def upkeep_files(docs):
    return U.manifest(docs, "text", "authority")


def _chunks_of(docs):
    """Chunks of some documents, as chunk_table makes them of all."""
    from corpusloom.plans.fixtures import PREFIXES, line_rows

    blocks = K.build_blocks(line_rows(docs), ["doc_id", "page_no"], "line_no", PREFIXES)
    return K.chunk(blocks, ["doc_id", "page_no"], 1000, 220).join(docs.select("doc_id", "file", "authority"), "doc_id")


@query("index_changes", r"SELECT file, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN o = n THEN 'same' ELSE 'changed' END AS status FROM (SELECT 'doc_' || doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '\n?[^\n]*\z', '') ELSE text END AS o FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 'old_doc_' || doc_id, text FROM documents WHERE doc_id % 5 = 0) FULL JOIN (SELECT 'doc_' || doc_id AS file, text AS n FROM documents) USING (file)")
def index_changes(spark, d):
    from corpusloom.plans.fixtures import documents

    return U.changes(upkeep_files(older(spark, d)), upkeep_files(documents(spark, d)))


def refreshed(spark, d):
    """The older state's index, saved, loaded and brought up to date."""
    from corpusloom.plans.fixtures import documents
    from corpusloom.sources import index_store

    now = documents(spark, d)
    before = older(spark, d)

    def build():
        c = _chunks_of(before)
        tf = I.space_counts(c.select(*R.KEY, "text"), R.KEY, {"word": SPACES["word"]}, "text")
        return {"chunks": c, "postings": tf, "vocabulary": I.space_vocabulary(tf, c.agg(F.count("*").alias("n"))), "manifest": upkeep_files(before)}

    path, meta = index_store.scratch(spark), {"version": "1", "spaces": "word"}
    old = index_store.load_or_build(spark, path, meta, build)
    new = upkeep_files(now)
    changed = U.changes(old["manifest"], new)
    tables = U.refresh(old, changed, lambda files: _chunks_of(now.join(files, "file", "left_semi")), {"word": SPACES["word"]})
    return index_store.load_or_build(spark, path, meta, lambda: tables | {"manifest": new}, force=True)


@query("index_refresh", f"{_BASE}, {_WORD} SELECT file, pdf_index, chunk_id, term, tf, df, round(idf, 6) AS idf, text FROM w_tf JOIN w_v USING (term) JOIN (SELECT file, pdf_index, chunk_id, text FROM chunks) USING (file, pdf_index, chunk_id)")
def index_refresh(spark, d):
    """The rows of the three tables of an older index brought up to date: those of a fresh one."""
    t = refreshed(spark, d)
    x = t["postings"].join(t["vocabulary"], ["space", "term"]).join(t["chunks"].select(*R.KEY, "text"), R.KEY)
    return x.select(*R.KEY, "term", "tf", "df", F.round("idf", 6).alias("idf"), "text")


@query("cosine_word", f"{_BASE}, {_WORD} SELECT qid, file, chunk_id, round(sim, 6) AS sim FROM w_s WHERE variant_no = 0")
def cosine_word(spark, d):
    s = R.cosines(asked(spark, d), chunks(spark, d), "word", word_terms)
    return s.select("qid", "file", "chunk_id", F.round("sim", 6).alias("sim"))


@query("cosine_char", f"{_BASE}, {_CHAR} SELECT qid, file, chunk_id, round(sim, 6) AS sim FROM c_s WHERE variant_no = 0")
def cosine_char(spark, d):
    s = R.cosines(asked(spark, d), chunks(spark, d), "char", I.char_terms)
    return s.select("qid", "file", "chunk_id", F.round("sim", 6).alias("sim"))


@query("token_overlap", f"{_BASE}, {_OVER} SELECT qid, file, chunk_id, round(overlap, 6) AS overlap FROM ov WHERE variant_no = 0")
def token_overlap(spark, d):
    # Letter by letter as in the SQL; a chunk's text in lower case has the same tokens.
    q = questions(spark, d).select("qid", T.normalize_query(T.lower(F.col("question"))).alias("q_aug"))
    c = chunks(spark, d).select(*R.KEY, T.lower(F.col("text")).alias("text"))
    return R.token_overlap(q, c).select("qid", "file", "chunk_id", F.round("overlap", 6).alias("overlap"))


@query("query_prior", f"{_BASE}, qs AS (SELECT qid, q FROM asks WHERE variant_no = 0) SELECT qid, file, chunk_id, round({s_prior()}, 6) AS prior FROM qs, chunks")
def query_prior(spark, d):
    q = asked(spark, d).select("qid", R.switched_on(F.col("q_aug"), PROFILES, SOP_SIGNALS).alias("bits"))
    parts = R.prior_parts(F.col("authority"), F.col("file"), F.col("text"), PROFILES, toc=TOC)
    once = chunks(spark, d).select("file", "chunk_id", parts.alias("parts"))  # below the join, so that a text is searched once and not once for every set of bits
    of_bits = once.crossJoin(F.broadcast(q.select("bits").distinct())).select("bits", "file", "chunk_id", F.round(R.prior_sum(F.col("bits"), F.col("parts"), PROFILES), 6).alias("prior"))
    return of_bits.join(F.broadcast(q), "bits").select("qid", "file", "chunk_id", "prior")


@query("requirement_hits", f"{_BASE} SELECT file, chunk_id, {s_hits('text')} AS hits FROM chunks")
def requirement_hits(spark, d):
    return chunks(spark, d).select("file", "chunk_id", R.requirement_hits(F.col("text"), SIGNALS).alias("hits"))


@query("requirement_boost", f"{_ALL} SELECT qid, file, chunk_id, hits, round(boost, 6) AS boost FROM fs")
def requirement_boost(spark, d):
    hits = R.requirement_hits(F.col("text"), SIGNALS)
    # Below the join and its own shuffle: generated code puts off a projection that a join consumes, and would count a chunk's signals for every question.
    once = chunks(spark, d).select("file", "chunk_id", hits.alias("hits")).withColumn("boost", F.round(R.requirement_boost(F.col("hits")), 6))
    once = I.dealt(once, ["file", "chunk_id"])
    q = asked(spark, d).select("qid", F.coalesce(broad(F.col("q_aug")), F.lit(False)).alias("broad"))
    by_question = lambda c, none: F.when(F.col("broad"), F.col(c)).otherwise(F.lit(none)).alias(c)
    return once.crossJoin(F.broadcast(q)).select("qid", "file", "chunk_id", by_question("hits", 0), by_question("boost", 0.0))


@query("scope_filter", f"{_BASE} SELECT qid, authority, count(*) AS n FROM questions, chunks WHERE {_ADMIT} GROUP BY qid, authority")
def scope_filter(spark, d):
    per = chunks(spark, d).groupBy("authority").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(asked(spark, d).select("qid", "scope"))).where(R.in_scope(F.col("scope"), F.col("authority"))).select("qid", "authority", "n")


@query("similarity_threshold", f"{_ALL} SELECT qid, count(*) FILTER (WHERE base >= 0.2) AS eligible, count(*) FILTER (WHERE final >= 0.2 AND base < 0.2) AS rescued_by_boost_only, count(*) AS total FROM fs GROUP BY qid")
def similarity_threshold(spark, d):
    reached = scored(spark, d).groupBy("qid").agg(F.count_if(F.col("base") >= 0.2).alias("eligible"), F.count_if((F.col("final") >= 0.2) & (F.col("base") < 0.2)).alias("rescued_by_boost_only"))
    total = chunks(spark, d).agg(F.count("*").alias("total"))
    return asked(spark, d).select("qid").join(reached, "qid", "left").crossJoin(F.broadcast(total)).fillna(0, ["eligible", "rescued_by_boost_only"])


@query("rank_topk", f"{_RANKED} SELECT qid, file, chunk_id, rank, round(final, 6) AS final FROM rk")
def rank_topk(spark, d):
    return ranked(spark, d).select("qid", "file", "chunk_id", "rank", F.round("final", 6).alias("final"))


def selected(spark, d, top_k=8, items=5):
    """Ranked rows that the diversity step chose, with mmr_pos."""
    r = kept(ranked(spark, d, top_k))
    return r.join(R.mmr(r, postings_of(spark, d, r), ["qid"], items, DEFAULT.mmr_lambda), ["qid", *R.KEY])


def s_mmr(p: str, rows: str, items: int) -> str:
    """CTE <p>m: the rows of <rows> (one search each, with rank and final) that the diversity step chose, with mmr_pos."""
    return f"""{p}t AS MATERIALIZED (SELECT qid, variant_no, rank, final, term, weight FROM {rows} JOIN w_d USING (file, pdf_index, chunk_id)),
{p}s AS MATERIALIZED (SELECT a.qid, a.variant_no, a.rank AS i, b.rank AS j, sum(a.weight * b.weight) AS sim FROM {p}t a JOIN {p}t b ON a.qid = b.qid AND a.variant_no = b.variant_no AND a.term = b.term AND a.rank <> b.rank GROUP BY ALL),
{p}g AS (SELECT qid, variant_no, 1 AS step, [1] AS chosen FROM {rows} WHERE rank = 1
UNION ALL SELECT g.qid, g.variant_no, g.step + 1, list_append(g.chosen, (SELECT x.rank FROM (SELECT r.rank, round(0.6 * r.final - 0.4 * max(coalesce(s.sim, 0)), 12) AS gain FROM {rows} r CROSS JOIN (SELECT unnest(g.chosen) AS j) u LEFT JOIN {p}s s ON s.qid = r.qid AND s.variant_no = r.variant_no AND s.i = r.rank AND s.j = u.j WHERE r.qid = g.qid AND r.variant_no = g.variant_no AND NOT list_contains(g.chosen, r.rank) GROUP BY r.rank, r.final) x ORDER BY gain DESC, rank LIMIT 1)) FROM {p}g g WHERE g.step < {items} AND g.step < (SELECT count(*) FROM {rows} WHERE qid = g.qid AND variant_no = g.variant_no)),
{p}f AS (SELECT qid, variant_no, arg_max(chosen, step) AS chosen FROM {p}g GROUP BY ALL),
{p}m AS (SELECT r.*, CAST(list_position(chosen, rank) AS INT) AS mmr_pos FROM {rows} r JOIN {p}f USING (qid, variant_no) WHERE list_contains(chosen, rank))"""


_MMR = f"{_RANKED}, {s_mmr('m', 'rk', 5)}"


@query("mmr_select", f"{_MMR} SELECT qid, file, chunk_id, mmr_pos FROM mm")
def mmr_select(spark, d):
    return selected(spark, d).select("qid", "file", "chunk_id", "mmr_pos")


@query("hybrid_search", f"{_MMR} SELECT qid, file, pdf_index, chunk_id, authority, round(base, 6) AS base, hits, round(final, 6) AS final, mmr_pos FROM mm")
def hybrid_search(spark, d):
    return selected(spark, d).select("qid", *R.KEY, "authority", F.round("base", 6).alias("base"), "hits", F.round("final", 6).alias("final"), "mmr_pos")


# Routing: profiles of documents against all forms of a question, topic rules and names.
_ROUTE = f"""{_BASE}, pf AS MATERIALIZED (SELECT lower(authority) || '/' || file AS doc, file || ' ' || left(arg_min(text, pdf_index * 100000 + seq), 500) AS profile FROM chunks GROUP BY file, authority),
r_tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({s_word_terms('profile')}) AS term FROM pf) GROUP BY ALL), r_v AS (SELECT term, ln((1 + (SELECT count(*) FROM pf)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM r_tf GROUP BY term),
r_d AS (SELECT doc, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc)) AS weight FROM r_tf JOIN r_v USING (term)),
r_qt AS (SELECT qid, variant_no, term, count(*) AS tf FROM (SELECT qid, variant_no, unnest({s_word_terms('q')}) AS term FROM asks) GROUP BY ALL), r_q AS (SELECT qid, variant_no, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid, variant_no)) AS weight FROM r_qt JOIN r_v USING (term)),
dsim AS (SELECT qid, doc, max(sim) AS sim FROM (SELECT qid, variant_no, doc, sum(q.weight * d.weight) AS sim FROM r_q q JOIN r_d d USING (term) GROUP BY ALL) GROUP BY ALL),
qall AS (SELECT qid, string_agg(q, ' ' ORDER BY variant_no) AS qtext FROM asks GROUP BY qid),
tm AS ({' UNION ALL '.join(f"SELECT qid, '{k}' AS topic FROM qall WHERE {s_count('qtext', words)} > 0" for k, (words, _) in TOPICS.items())}),
ru AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {quoted(r)})" for k, (_, rules) in TOPICS.items() for r in rules)}) AS v(topic, rule)),
th AS (SELECT qid, doc, count(*) AS hits FROM tm JOIN ru USING (topic) JOIN pf ON starts_with(doc, rule) OR (NOT ends_with(rule, '/') AND contains(doc, rule)) GROUP BY ALL),
wd AS (SELECT qid, qtext, {s_word('qtext', [BROAD['marker']])} AND qid IN (SELECT qid FROM tm WHERE topic = 'process_validation') AS wide FROM qall),
qtk AS (SELECT qid, list_filter(list_distinct(regexp_extract_all(lower(qtext), '[a-z0-9]{{2,}}')), lambda x: length(x) >= 3) AS qt FROM qall), dtk AS (SELECT doc, list_filter(list_distinct(regexp_extract_all(lower(doc), '[a-z0-9]{{2,}}')), lambda x: length(x) >= 3) AS dt FROM pf),
no AS (SELECT qid, doc, CAST(len(list_intersect(qt, dt)) AS DOUBLE) / len(qt) AS overlap FROM qtk, dtk WHERE len(list_intersect(qt, dt)) > 0),
tp AS (SELECT qid, doc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 12) DESC, doc) AS k FROM dsim WHERE sim > 0) JOIN wd USING (qid) WHERE k <= CASE WHEN wide THEN 8 ELSE 5 END UNION SELECT qid, doc FROM th),
rs AS (SELECT qid, doc, wide, 0.8 * coalesce(sim, 0) + 0.2 * coalesce(overlap, 0) + 0.15 * coalesce(hits, 0) + CASE WHEN wide THEN 0.12 * {s_count("regexp_replace(lower(doc), '[^a-z0-9]+', '', 'g')", C.DOC_HINTS)} ELSE 0 END AS score FROM tp LEFT JOIN dsim USING (qid, doc) LEFT JOIN no USING (qid, doc) LEFT JOIN th USING (qid, doc) JOIN wd USING (qid)),
rt AS MATERIALIZED (SELECT qid, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc) AS INT) AS rank FROM rs) WHERE rank <= CASE WHEN wide THEN 8 ELSE 5 END AND (score > 0 OR rank = 1)), al AS (SELECT DISTINCT qid, regexp_extract(doc, '[^/]*$') AS file FROM rt)"""


def routed(spark, d):
    return stored(spark, d, "routed", build_routed)


def build_routed(spark, d):
    q = asks(spark, d)
    path = F.concat(F.lower("authority"), F.lit("/"), F.col("file")).alias("doc")
    profiles = kept(K.profiles(chunks(spark, d)).select(path, "profile"))
    sim = kept(R.best_similarities(profiles, q, word_terms, "doc", *VARIANT, "profile", "q_aug"))
    whole = q.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.struct("variant_no", "q_aug")))["q_aug"], " ").alias("q"))
    hits = G.topic_hits(whole, profiles.select("doc", F.col("doc").alias("path")), TOPICS)
    overlap = G.name_overlap(whole, profiles.select("doc", F.col("doc").alias("name")), "qid", "q", "doc", "name").select("qid", "doc", "overlap")
    wide = G.match_topics(whole, TOPICS).where("topic = 'process_validation'").join(whole.where(F.col("q").rlike(T.any_word([BROAD["marker"]]))), "qid", "left_semi")
    plain = F.regexp_replace(F.lower("doc"), "[^a-z0-9]+", "")
    hints = profiles.select("doc", T.count_terms(plain, C.DOC_HINTS).alias("n")).where("n > 0")
    return G.route(sim, overlap, hits, wide, hints)


def allowed(spark, d):
    """(qid, file): file names, in lower case, of the documents that a question was routed to."""
    return routed(spark, d).select("qid", F.regexp_extract(F.lower(F.btrim("doc")), "[^/]*$", 0).alias("file")).distinct()


@query("route_docs", f"{_ROUTE} SELECT qid, doc, round(score, 6) AS score, rank FROM rt")
def route_docs(spark, d):
    return routed(spark, d).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


@query("allowed_docs_filter", f"{_ROUTE} SELECT qid, file, chunk_id FROM al JOIN chunks USING (file)")
def allowed_docs_filter(spark, d):
    return chunks(spark, d).join(F.broadcast(allowed(spark, d)), "file").select("qid", "file", "chunk_id")


_ALLOWED = f"{_ROUTE}, {_WORD}, {_CHAR}, {_SCORED}, fz AS MATERIALIZED (SELECT fa.*, al.file IS NOT NULL OR fa.qid NOT IN (SELECT qid FROM al) AS allowed FROM fa LEFT JOIN al USING (qid, file))"


@query("empty_retrieval_stats", f"{_ALLOWED} SELECT qid, count(*) AS total, count(*) FILTER (WHERE NOT admitted) AS scope_removed, count(*) FILTER (WHERE admitted AND NOT allowed) AS docs_removed, count(*) FILTER (WHERE admitted AND allowed AND base < 0.2) AS similarity_removed, count(*) FILTER (WHERE admitted AND allowed AND base >= 0.2) AS eligible FROM fz WHERE variant_no = 0 GROUP BY qid")
def empty_retrieval_stats(spark, d):
    c, q, mine = chunks(spark, d), asked(spark, d), allowed(spark, d)
    per = c.groupBy("authority").agg(F.count("*").alias("n"))
    admitted = R.in_scope(F.col("scope"), F.col("authority"))
    routed_n = c.groupBy("file", "authority").agg(F.count("*").alias("n")).join(F.broadcast(mine), "file").join(F.broadcast(q.select("qid", "scope")), "qid").where(admitted).groupBy("qid").agg(F.sum("n").alias("n_allowed"))
    eligible = searched(spark, d).where("variant_no = 0 and admitted and allowed and base >= 0.2").groupBy("qid").agg(F.count("*").alias("eligible"))
    return R.empty_totals(q.select("qid", "scope"), per, routed_n, mine.select("qid").distinct(), eligible, admitted)


# Phase A: every form of a question is searched, in its routed documents first; what each search selects is merged.
def s_pool(p: str, where: str, least: float) -> str:
    return f"""{p}k AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, variant_no ORDER BY round(final, 12) DESC, round(base, 12) DESC, file, pdf_index, chunk_id) AS INT) AS rank FROM fz WHERE {where} AND base >= {least}) WHERE rank <= 12),
{s_mmr(p, p + 'k', 8)}, {p} AS MATERIALIZED ({s_merge(f'SELECT qid, variant_no, file, pdf_index, chunk_id, authority, base, hits, final FROM {p}m')})"""


def s_merge(rows: str) -> str:
    return f"SELECT * FROM (SELECT * EXCLUDE (k), CAST(row_number() OVER (PARTITION BY qid ORDER BY round(final, 12) DESC, file, pdf_index, chunk_id) AS INT) AS pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, file, pdf_index, chunk_id ORDER BY round(final, 12) DESC, variant_no) AS k FROM ({rows})) WHERE k = 1) WHERE pool_rank <= 80"


RETRIED = ("computerized_systems", "data_integrity", "deviations")
_DOM = "dm AS (" + _s_domain().replace("WITH " + QUESTIONS_SQL + ",", "WITH", 1) + ")"
_POOL = f"{_ALLOWED}, {s_pool('ra', 'admitted AND allowed', 0.2)}"
_COLS = "qid, file, pdf_index, chunk_id, authority, base, hits, final"
_RETRY = f"""{_POOL}, {_DOM}, {s_pool('op', 'admitted', 0.2)}, thin AS (SELECT qid FROM dm LEFT JOIN (SELECT qid, count(*) AS n FROM ra GROUP BY qid) USING (qid) WHERE coalesce(n, 0) < 3 AND domain IN {RETRIED}),
r1 AS MATERIALIZED ({s_merge(f'SELECT variant_no, {_COLS} FROM ra UNION ALL SELECT variant_no + 1000, {_COLS} FROM op WHERE qid IN (SELECT qid FROM thin)')})"""


def searched(spark, d):
    """all_scored with `allowed`: whether the question was routed to the chunk's document, or to none."""
    return with_allowed(all_scored(spark, d), allowed(spark, d))


def with_allowed(rows, mine):
    x = rows.join(F.broadcast(mine.withColumn("_a", F.lit(True))), ["qid", "file"], "left")
    return x.join(F.broadcast(mine.select("qid").distinct().withColumn("_r", F.lit(True))), "qid", "left").withColumn("allowed", F.col("_a").isNotNull() | F.col("_r").isNull()).drop("_a", "_r")


def all_pools(spark, d):
    """The pools of all four kinds of search, with `pool`."""
    reached, lower = F.col("base") >= DEFAULT.min_similarity, F.col("base") >= DEFAULT.fallback_similarity
    within = F.col("admitted") & F.col("allowed")
    rules = {"routed": within & reached, "open": F.col("admitted") & reached, "mixed": reached, "fallback": within & lower}
    return stored(spark, d, "pools", lambda spark, d: R.pools(best_scored(spark, d), rules, lambda ranked: postings_of(spark, d, ranked), VARIANT))


def pool_of(spark, d, name):
    return all_pools(spark, d).where(F.col("pool") == name).drop("pool")


def pool(spark, d):
    return pool_of(spark, d, "routed")


def retried(spark, d):
    """The pool, joined by unrestricted rows where it is thin and the domain calls for it."""
    cols = [*VARIANT, *R.KEY, "authority", "base", "hits", "final"]
    build = lambda spark, d: R.relaxed_retry(pool(spark, d).select(cols), pool_of(spark, d, "open").select(cols), domains(spark, d), RETRIED)
    return stored(spark, d, "retried", build)


@query("merge_variants", f"{_POOL} SELECT qid, file, chunk_id, variant_no, round(final, 6) AS final, pool_rank FROM ra")
def merge_variants(spark, d):
    return pool(spark, d).select("qid", "file", "chunk_id", "variant_no", F.round("final", 6).alias("final"), "pool_rank")


def domains(spark, d):
    return questions(spark, d).select("qid", Q.domain(F.col("question"), LEXICON, out_of_spec=OOS, apr=APR, validation=VALID).alias("domain"))


@query("relaxed_retry", f"{_RETRY} SELECT qid, file, chunk_id, round(final, 6) AS final FROM r1")
def relaxed_retry(spark, d):
    return retried(spark, d).select("qid", "file", "chunk_id", F.round("final", 6).alias("final"))


def _s_lex(kind: str, relaxed=R.C.RELAXED_DOMAINS) -> str:
    out = []
    for name, lex in LEXICON.items():
        least = 2 if kind == "strict" else 1
        if kind == "loose" and name not in relaxed:
            least = 2
        s = s_collapsed("text")
        out.append(f"WHEN '{name}' THEN {s_count(s, lex.negative)} = 0 AND ({s_count(s, lex.strong)} >= 1 OR {s_count(s, lex.secondary)} >= {least})")
    return f"coalesce(CASE domain {' '.join(out)} END, false)"


def s_narrowed(p: str, rows: str) -> str:
    """CTE <p>: rows of a pool that the domain's filter keeps, with level."""
    return f"""{p}l AS (SELECT {_COLS}, pool_rank, {_s_lex('strict')} AS a, {_s_lex('loose')} AS b FROM {rows} JOIN dm USING (qid) JOIN (SELECT file, pdf_index, chunk_id, text FROM chunks) USING (file, pdf_index, chunk_id)),
{p}v AS (SELECT *, CASE WHEN count(*) FILTER (WHERE a) OVER (PARTITION BY qid) >= 2 THEN 1 WHEN count(*) FILTER (WHERE b) OVER (PARTITION BY qid) >= 2 THEN 2 ELSE 0 END AS level FROM {p}l), {p} AS MATERIALIZED (SELECT * FROM {p}v WHERE level = 0 OR (level = 1 AND a) OR (level = 2 AND b))"""


_NARROW = f"{_RETRY}, {s_narrowed('d1', 'r1')}"


def narrowed(spark, d, rows):
    x = R.domain_filter(with_text(spark, d, rows).join(domains(spark, d), "qid"), LEXICON)
    return x.select("qid", *R.KEY, "authority", "base", F.col("hits").cast("int").alias("hits"), "final", "pool_rank", "level")


@query("domain_chunk_filter", f"{_NARROW} SELECT qid, file, chunk_id, level FROM d1")
def domain_chunk_filter(spark, d):
    return narrowed(spark, d, retried(spark, d)).select("qid", "file", "chunk_id", "level")


_MIXED = f"{_NARROW}, {s_pool('mi', 'true', 0.2)}, {s_narrowed('d2', 'mi')}, sr AS MATERIALIZED (SELECT *, false AS retried FROM d1 UNION ALL SELECT *, true FROM d2 WHERE qid NOT IN (SELECT qid FROM d1))"


def mixed(spark, d):
    def build(spark, d):
        return R.scope_retry(narrowed(spark, d, retried(spark, d)), narrowed(spark, d, pool_of(spark, d, "mixed")), questions(spark, d))

    return stored(spark, d, "mixed", build)


@query("scope_retry", f"{_MIXED} SELECT qid, file, chunk_id, retried FROM sr")
def scope_retry(spark, d):
    return mixed(spark, d).select("qid", "file", "chunk_id", "retried")


_FB = "regexp_replace(lower(file), '[^a-z0-9]+', '', 'g')"
_FQ = f"list_filter(list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z]{{3,}}')), lambda t: NOT list_contains({sql_list(R.C.TOKEN_STOP)}, t)), lambda t: length(t) >= 4)"
_FALLBACK = f"{_MIXED}, {s_pool('fb', 'admitted AND allowed', 0.18)}, {s_narrowed('d3', 'fb')}, ft AS (SELECT *, coalesce(len(list_filter({_FQ}, lambda w: contains({_FB}, w))) > 0, false) AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pool_rank) AS k FROM d3) JOIN questions USING (qid) WHERE k = 1)"


def fallbacks(spark, d):
    """(rows, first): what searches with the lower threshold give, and each question's first of them with `accepted`."""
    from pyspark.sql import Window

    rows = narrowed(spark, d, pool_of(spark, d, "fallback"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("pool_rank"))).where("k = 1").drop("k")
    first = first.join(questions(spark, d), "qid").withColumn("accepted", (F.col("final") >= DEFAULT.fallback_similarity) & R.fallback_match(F.col("question"), F.col("file")))
    return rows, first


@query("fallback_accept", f"{_FALLBACK} SELECT qid, file, chunk_id, accepted FROM ft")
def fallback_accept(spark, d):
    return fallbacks(spark, d)[1].select("qid", "file", "chunk_id", "accepted")


# Balance. A row's place in the refill is the number of rows that go before it, which is the sorted order wherever that exists.
_BEFORE = "CASE WHEN round(abs(s.base - r.base), 12) <= 0.02 AND s.hits <> r.hits THEN s.hits > r.hits ELSE (-s.final, -s.base, s.file, s.pdf_index, s.chunk_id) < (-r.final, -r.base, r.file, r.pdf_index, r.chunk_id) END"
_BALANCE = f"""{_FALLBACK}, bi AS MATERIALIZED (SELECT qid, file, pdf_index, chunk_id, authority, round(base, 12) AS base, hits, round(final, 12) AS final, retried, false AS fallback FROM sr UNION ALL SELECT qid, file, pdf_index, chunk_id, authority, round(base, 12), hits, round(final, 12), false, true FROM d3 WHERE qid NOT IN (SELECT qid FROM sr) AND qid IN (SELECT qid FROM ft WHERE accepted)),
b1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, file, pdf_index, chunk_id) AS o, row_number() OVER (PARTITION BY qid, authority ORDER BY final DESC, file, pdf_index, chunk_id) AS slot, greatest(0.2, first_value(base) OVER (PARTITION BY qid ORDER BY final DESC, file, pdf_index, chunk_id) - 0.22) AS bar FROM bi),
b2 AS (SELECT *, first_value(base) OVER (PARTITION BY qid, authority ORDER BY slot) AS lead FROM b1), b3 AS (SELECT *, round(lead, 12) >= round(bar, 12) AS eligible FROM b2),
b4 AS MATERIALIZED (SELECT *, count(DISTINCT authority) FILTER (WHERE eligible) OVER (PARTITION BY qid) AS n_eligible, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN eligible AND slot <= 3 THEN slot ELSE 99 END, lead DESC, authority) AS turn FROM b3),
b5 AS (SELECT *, n_eligible >= 2 AND eligible AND slot <= 3 AND turn <= 8 AS seated FROM b4),
b6 AS (SELECT *, (SELECT count(*) FROM b4 s WHERE s.qid = r.qid AND {_BEFORE}) AS place FROM b5 r),
b7 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seated DESC, place) AS got FROM b6), bal AS MATERIALIZED (SELECT * FROM b7 WHERE CASE WHEN n_eligible < 2 THEN o <= 8 ELSE got <= 8 END)"""


def gathered(spark, d):
    """Phase A before its balance, with `retried` and `fallback`."""

    def build(spark, d):
        rows, first = fallbacks(spark, d)
        taken = rows.join(first.where("accepted").select("qid"), "qid", "left_semi").join(mixed(spark, d).select("qid").distinct(), "qid", "left_anti")
        return mixed(spark, d).withColumn("fallback", F.lit(False)).unionByName(taken.withColumn("retried", F.lit(False)).withColumn("fallback", F.lit(True)))

    return stored(spark, d, "gathered", build)


def balanced(spark, d):
    rows = gathered(spark, d).select("qid", *R.KEY, "authority", "base", "final", "hits")
    return stored(spark, d, "balanced", lambda spark, d: R.balance(rows, DEFAULT.max_context))


@query("authority_balance", f"{_BALANCE} SELECT qid, file, chunk_id, authority, round(final, 6) AS final FROM bal")
def authority_balance(spark, d):
    return balanced(spark, d).select("qid", "file", "chunk_id", "authority", F.round("final", 6).alias("final"))


_SLOTS = "SELECT qid, authority, CAST(count(*) FILTER (WHERE slot <= 3) AS BIGINT) AS slots, any_value(eligible) AS eligible FROM b4 GROUP BY qid, authority"


@query("authority_slots", f"{_BALANCE} {_SLOTS}")
def authority_slots(spark, d):
    return R.slots(gathered(spark, d))


@query("phase_a", f"""{_BALANCE} SELECT qid, coalesce(n1, 0) AS pool_size, qid IN (SELECT qid FROM thin) AS relaxed, coalesce(n2, 0) AS gathered, coalesce(retried, false) AS retried, coalesce(fallback, false) AS fallback, coalesce(n_facts, 0) AS n_facts, top_score, n_files, authorities FROM questions LEFT JOIN (SELECT qid, count(*) AS n1 FROM ra GROUP BY qid) USING (qid)
LEFT JOIN (SELECT qid, count(*) AS n2, bool_or(retried) AS retried, bool_or(fallback) AS fallback FROM bi GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS n_facts, round(max(final), 6) AS top_score, count(DISTINCT file) AS n_files, list_sort(list(DISTINCT authority)) AS authorities FROM bal GROUP BY qid) USING (qid)""")
def phase_a(spark, d):
    first = pool(spark, d).groupBy("qid").agg(F.count("*").alias("pool_size"))
    thin = R.thin(pool(spark, d), domains(spark, d), RETRIED).withColumn("relaxed", F.lit(True))
    second = gathered(spark, d).groupBy("qid").agg(F.count("*").alias("gathered"), F.bool_or("retried").alias("retried"), F.bool_or("fallback").alias("fallback"))
    last = balanced(spark, d).groupBy("qid").agg(F.count("*").alias("n_facts"), F.round(F.max("final"), 6).alias("top_score"), F.countDistinct("file").alias("n_files"), F.array_sort(F.collect_set("authority")).alias("authorities"))
    x = questions(spark, d).select("qid")
    for part in (first, thin, second, last):
        x = x.join(part, "qid", "left")
    return x.fillna(0, ["pool_size", "gathered", "n_facts"]).fillna(False, ["relaxed", "retried", "fallback"])
