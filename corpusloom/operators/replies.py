"""Checks of replies from an external rewriter: facts and sentences must trace back to given evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusloom.functions import text as T
from corpusloom.operators.evidence import topic_tokens
from corpusloom.operators.matching import above


def ask(rows: DataFrame, request: Callable[[str], str], prompt: str, schema: str) -> DataFrame:
    """rows with `reply`: request(prompt) per row, a batch at a time; a failed request is tried once more, then raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def once(p: str) -> str:
            try:
                return request(p)
            except Exception:
                return request(p)

        for b in batches:
            yield b.assign(reply=[once(p) for p in b[prompt]])

    return rows.mapInPandas(run, schema)


def validate_facts(reply: DataFrame, source: DataFrame) -> DataFrame:
    """Replied facts (qid, pdf, page, chunk_id) that name a source fact, once each, with the source's columns and score."""
    key = ["qid", "pdf", "pdf_index", "chunk_id"]
    named = reply.where("page is not null").withColumn("pdf_index", F.col("page").cast("int") - 1).select(*key).distinct()
    return source.dropDuplicates(key).join(named, key)


@F.pandas_udf(BooleanType())
def _dump(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([above(x, y, t) for x, y, t in zip(a, b, limit, strict=True)], dtype=bool)


def is_quote_dump(a: Column, b: Column, limit: float = 0.80) -> Column:
    """Whether a sentence repeats a quote: matching-block ratio of the lower-cased letters and digits above `limit`."""
    compact = lambda s: F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return _dump(compact(a), compact(b), F.lit(limit))


def validate_synthesis(reply: DataFrame, facts: DataFrame, most: int = 6, words: int = 30, least_keywords: int = 2) -> DataFrame:
    """Replied sentences (qid, n, sentence, pdf, page, chunk_id) that stand: of a known and yet unused fact, at most `words` long,
    no heading, no copy of the quote; the first `most`, and none where they name too few of the question's keywords."""
    key = ["qid", "pdf", "pdf_index", "chunk_id"]
    x = reply.withColumn("pdf_index", F.col("page").cast("int") - 1).join(facts.select(*key, "question", "quote"), key)
    s = F.col("sentence")
    count = F.size(T.words(s))
    x = x.where((count > 3) & (count <= words) & ~T.looks_like_heading(s) & ~is_quote_dump(s, F.col("quote")))
    x = x.withColumn("_u", F.row_number().over(Window.partitionBy(*key).orderBy("n"))).where("_u = 1")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy("n"))).where(F.col("_k") <= most)
    mine = F.array_intersect(topic_tokens(F.col("question")), F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]{3,}"), 0))
    hit = F.size(F.array_distinct(F.flatten(F.collect_list(mine).over(Window.partitionBy("qid")))))
    return x.withColumn("_h", hit).where(F.col("_h") >= least_keywords).drop("_u", "_k", "_h")


def normalize_confidence(value: Column) -> Column:
    """High or Medium where a reply says so in any case, else Low."""
    s = F.lower(F.btrim(F.coalesce(value, F.lit(""))))
    return F.when(s == "high", "High").when(s == "medium", "Medium").otherwise("Low")
