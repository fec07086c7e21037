"""One query opN_<name> per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, divergence, embeddings, html, jaccard, licenses, media, mixing, oracles, quality, substring, warc, whitening
from corpusloom.llm.common import sha256, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(rows.unionByName(extra))
    back = chat.read_back(made)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(whole).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        sha256(F.col("loss_text")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan_mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    component = (F.col("i") + 1).cast("int")
    return each.select("vec_id", component.alias("component"), "n", "deviation", "whitened", F.element_at("explained", component).alias("explained"), "identity_error")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_html_extraction": op9_html_extraction,
    "op10_media_columns": op10_media_columns,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = oracles.ORACLE_SQL
