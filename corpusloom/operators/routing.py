"""Document routing: topics, path rules, name overlap and the blended route."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T


def match_topics(questions: DataFrame, topics: Mapping[str, tuple] = C.TOPICS) -> DataFrame:
    """(qid, topic, score, rank) of the topics whose keywords a normalised question (qid, q) holds."""
    scored = F.array(*[F.struct(F.lit(k).alias("topic"), T.count_terms(F.col("q"), words).alias("score")) for k, (words, _) in topics.items()])
    rows = questions.select("qid", F.explode(scored).alias("x")).select("qid", "x.*").where("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "topic")))


def path_matches(path: Column, rule: Column) -> Column:
    """A rule matches as a prefix; one without a final slash anywhere."""
    return path.startswith(rule) | (~rule.endswith("/") & path.contains(rule))


def _name_tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0)), lambda x: F.length(x) >= 3)


def name_overlap(questions: DataFrame, names: DataFrame, q_key: str, q_text: str, d_key: str, d_text: str) -> DataFrame:
    """(q_key, d_key, shared, overlap): shared tokens over the question's tokens, by a join on tokens."""
    q = questions.select(q_key, F.explode(_name_tokens(F.col(q_text))).alias("token"))
    n = q.groupBy(q_key).agg(F.count("*").alias("n"))
    d = names.select(d_key, F.explode(_name_tokens(F.col(d_text))).alias("token"))
    shared = q.join(d, "token").groupBy(q_key, d_key).agg(F.count("*").alias("shared"))
    return shared.join(n, q_key).select(q_key, d_key, "shared", (F.col("shared") / F.col("n")).alias("overlap"))


def topic_hits(questions: DataFrame, paths: DataFrame, topics: Mapping[str, tuple] = C.TOPICS) -> DataFrame:
    """(qid, doc, hits): how many path rules of a question's topics match a document; questions (qid, q), paths (doc, path).

    Rules are a short fixed list, so each document meets them once, and questions meet documents by rule."""
    rules = [(t, p) for t, (_, own) in topics.items() for p in own]
    known = F.broadcast(questions.sparkSession.createDataFrame(rules or [("", "")], "topic string, rule string"))
    named = paths.join(known, path_matches(F.col("path"), F.col("rule"))).select("doc", "topic", "rule")
    return match_topics(questions, topics).select("qid", "topic").join(named, "topic").groupBy("qid", "doc").agg(F.count("*").cast("double").alias("hits"))


def route(similarity: DataFrame, overlap: DataFrame, topic_hits: DataFrame, wide: DataFrame | None = None, hints: DataFrame | None = None, w: C.Weights = C.DEFAULT) -> DataFrame:
    """(qid, doc, score, rank): the best documents per question.

    Candidates are the top documents by similarity (qid, doc, sim: the best over the question's forms) together with those that topic
    rules name (qid, doc, hits); the blended score adds name overlap (qid, doc, overlap). Questions in `wide` (qid) take more
    documents and add a bonus for each hint (doc, n) in a document's name. Ranks end at the first score that isn't positive, after one.
    """
    most = F.lit(w.top_docs)
    if wide is not None:
        flag = wide.select("qid").distinct().withColumn("_wide", F.lit(True))
        similarity, topic_hits = similarity.join(flag, "qid", "left"), topic_hits.join(flag.drop("_wide"), "qid", "left")
        most = F.when(F.col("_wide"), w.wide_docs).otherwise(w.top_docs)
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("sim", 12)), "doc")
    top = similarity.where("sim > 0").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= max(w.top_docs, w.wide_docs)).where(F.col("_k") <= most).select("qid", "doc")
    pool = top.union(topic_hits.select("qid", "doc")).distinct()
    for part in (similarity.select("qid", "doc", "sim"), overlap, topic_hits):
        pool = pool.join(part, ["qid", "doc"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = w.route_tfidf * zero("sim") + w.route_name * zero("overlap") + w.route_topic * zero("hits")
    if wide is not None:
        pool = pool.join(flag, "qid", "left")
        if hints is not None:
            pool = pool.join(hints.select("doc", "n"), "doc", "left")
            score = score + F.when(F.col("_wide"), w.route_hint * F.coalesce("n", F.lit(0))).otherwise(0.0)
    pool = pool.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), F.lower("doc")))
    return pool.withColumn("rank", rank).where((F.col("rank") <= most) & ((F.col("score") > 0) | (F.col("rank") == 1))).select("qid", "doc", "score", "rank")


def path_map(files: DataFrame) -> DataFrame:
    """(authority, name, path): of files (authority, folder, name, path) with the same authority and name, the first by folder, name and path, case aside."""
    order = F.struct(F.lower("folder"), F.lower("name"), "path")
    return files.groupBy("authority", "name").agg(F.min_by("path", order).alias("path"))
