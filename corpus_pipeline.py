"""Corpus pipeline: score, deduplicate, mix and tokenise documents, each stage over all that the one before kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one the tokens. Decisions by stage:
  quality      drops documents that the additive classifier, trained on this input's labels, scores below 0.7
  near_copies  keeps the smallest doc_id of each component of documents at a Jaccard similarity of 0.8 or more on five words
  repeats      cuts windows of 13 words that a document of smaller doc_id has; a document left without words goes
  mix          repeats, drops and cuts documents until each source meets its target; a repeated document is a repeated row
  tokens       encodes each text and decodes it again: doc_id, n_tokens and the digests of ids and decoded text
Nulls, empty tables and extra columns follow the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, jaccard, mixing, quality, substring
from corpusloom.llm.common import materialize, table
from corpusloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.keep_good(docs.select(COLUMNS), quality.train(docs, labels))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs.select(COLUMNS), words=5, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(docs.select(COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs.select(COLUMNS), tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("substring dedup", repeats_stage),
    ("mixing sources to target weights", mix_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The classifier's decisions can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; every stage's rows are written as parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
