"""Blocks, chunks and the index's document checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as T

CHUNK_ID = r"^p(-?[0-9]+)_c([0-9]+)$"


def build_blocks(lines: DataFrame, page: list[str], order: str, prefixes=C.SECTION_PREFIXES) -> DataFrame:
    """(page, block, section, text): paragraphs between empty lines, artifacts, headings and sentence ends.

    A block's section is the last heading above it on the page; heading lines themselves are left out.
    """
    w = Window.partitionBy(*page).orderBy(order)
    x = lines.select(*page, order, T.normalize_line(F.col("line")).alias("line"))
    x = x.withColumn("_gap", T.is_artifact(F.col("line")))
    x = x.withColumn("_head", ~F.col("_gap") & T.is_heading(F.col("line"), prefixes)).withColumn("_out", F.col("_gap") | F.col("_head"))
    brk = F.col("_out") | F.coalesce(F.lag("_out").over(w), F.lit(True)) | F.coalesce(F.lag("line").over(w).rlike("[.!?]$"), F.lit(False))
    x = x.withColumn("section", F.coalesce(F.last(F.when(F.col("_head"), F.col("line")), ignorenulls=True).over(w), F.lit("Unknown")))
    x = x.withColumn("_b", brk.cast("int"))
    x = x.withColumn("_g", F.sum("_b").over(w)).where("not _out")
    rows = x.groupBy(*page, "_g", "section").agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("_l"))
    rows = rows.withColumn("block", F.row_number().over(Window.partitionBy(*page).orderBy("_g")))
    return rows.select(*page, "block", "section", F.array_join(F.col("_l")["line"], " ").alias("text"))


def _fold(parts: Column, joined: str, most: int) -> Column:
    """Greedy packing of strings: joined with `joined` while they stay within `most` characters."""
    empty = F.array().cast("array<string>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(joined), s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, empty, step)


def pack(blocks: DataFrame, page: list[str], most: int = 1000) -> DataFrame:
    """(page, c, section, text): blocks packed greedily into chunks of at most `most` characters; an oversize block is first
    packed from its sentences, of which a long one stays whole. A chunk's section is its first part's."""
    parts = F.when(F.length("text") > most, _fold(T.split_sentences(F.col("text")), " ", most)).otherwise(F.array("text"))
    x = blocks.select(*page, "block", "section", F.posexplode(parts).alias("part", "text"))
    whole = x.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("block", "part", "section", "text"))).alias("_p"))
    kind = "array<struct<section:string,text:string>>"

    def step(acc, p):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last["text"]) + 1 + F.length(p["text"]) <= most)
        grown = F.struct(last["section"].alias("section"), F.concat(last["text"], F.lit("\n"), p["text"]).alias("text"))
        new = F.struct(p["section"].alias("section"), p["text"].alias("text"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    out = whole.select(*page, F.posexplode(F.aggregate("_p", F.array().cast(kind), step)).alias("c", "_k"))
    return out.select(*page, (F.col("c") + 1).alias("c"), "_k.section", "_k.text")


def merge_groups(packed: DataFrame, page: list[str], least: int = 220) -> DataFrame:
    """packed with g: chunks below `least` characters share the group of the chunk before them."""
    w = Window.partitionBy(*page).orderBy("c")
    return packed.withColumn("g", F.sum(F.when((F.col("c") == 1) | (F.length("text") >= least), 1).otherwise(0)).over(w).cast("int"))


def chunk(blocks: DataFrame, page: list[str], most: int = 1000, least: int = 220) -> DataFrame:
    """Addressable chunks: page columns, pdf_index, page, chunk_id, seq, section and text. page[-1] is the page's index."""
    grouped = merge_groups(pack(blocks, page, most), page, least)
    rows = grouped.groupBy(*page, "g").agg(F.array_sort(F.collect_list(F.struct("c", "section", "text"))).alias("_c"))
    index = F.col(page[-1])
    return rows.select(
        *page[:-1], index.alias("pdf_index"), (index + 1).alias("page"), F.format_string("p%d_c%d", index, F.col("g")).alias("chunk_id"),
        F.col("g").alias("seq"), F.col("_c")[0]["section"].alias("section"), F.array_join(F.col("_c")["text"], "\n").alias("text"),
    )


def _parts(chunk_id: str = "chunk_id") -> tuple[Column, Column]:
    return tuple(F.nullif(F.regexp_extract(chunk_id, CHUNK_ID, i), F.lit("")).cast("int") for i in (1, 2))


def migrate(chunks: DataFrame) -> DataFrame:
    """Rows repaired: index from the page where it is missing, clamped at 0; page, label and chunk_id follow it."""
    index = F.greatest(F.lit(0), F.coalesce("pdf_index", "page"))
    _, seq = _parts()
    fixed = chunks.withColumn("_i", index).withColumn("_s", F.greatest(F.lit(1), F.coalesce(seq, F.lit(1))))
    fixed = fixed.withColumn("pdf_index", F.col("_i")).withColumn("page", F.col("_i") + 1).withColumn("page_label", F.nullif(F.btrim("page_label"), F.lit("")))
    return fixed.withColumn("chunk_id", F.format_string("p%d_c%d", "_i", "_s")).drop("_i", "_s")


def audit_ids(chunks: DataFrame) -> DataFrame:
    """chunks with `consistent`: whether the chunk_id names the row's index."""
    page, _ = _parts()
    return chunks.withColumn("consistent", F.coalesce(page == F.greatest(F.lit(0), F.coalesce("pdf_index", "page")), F.lit(False)))


def content_hash(lines: DataFrame) -> DataFrame:
    """(content_hash): SHA-256 of the rows of `line` in order, a line break between them; nulls are left out.

    The rows are sorted by range, in as many tasks as the sort has, and written; a digest can only be taken from first to last, so one task reads the ranges in turn
    and hands its state on from batch to batch. It holds a batch at a time.
    """
    import hashlib

    import pyarrow as pa

    def digest(batches):
        state, first = hashlib.sha256(), True
        for batch in batches:
            for line in batch.column("line").to_pylist():
                state.update(line.encode() if first else b"\n" + line.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["content_hash"])

    found = lines.where("line is not null").select("line").orderBy("line").coalesce(1).mapInArrow(digest, "content_hash string")
    return found.agg(F.coalesce(F.max("content_hash"), F.lit(hashlib.sha256(b"").hexdigest())).alias("content_hash"))


def integrity_report(counts: DataFrame) -> DataFrame:
    """One row over (file, n): documents, chunks, documents without chunks, and a digest of the sorted counts."""
    totals = counts.agg(F.count("*").alias("total_docs"), F.sum("n").alias("total_chunks"), F.count_if(F.col("n") == 0).alias("zero_docs"))
    return totals.crossJoin(content_hash(counts.select(F.concat_ws(":", "file", "n").alias("line"))))  # a row each


def validated(counts: DataFrame) -> DataFrame:
    """integrity_report's row; no documents, or documents without chunks, end the job with an error that says how many."""
    report = integrity_report(counts)
    ok = F.when(F.col("total_docs") == 0, F.raise_error(F.lit("no documents expected")))
    ok = ok.when(F.col("zero_docs") > 0, F.raise_error(F.concat(F.col("zero_docs").cast("string"), F.lit(" documents without chunks"))))
    return report.withColumn("total_docs", ok.otherwise(F.col("total_docs")))


def profiles(chunks: DataFrame, most: int = 500) -> DataFrame:
    """(file, authority, profile): the name and the first chunk's beginning."""
    first = F.min_by(F.substring("text", 1, most), F.struct("pdf_index", "seq"))
    return chunks.groupBy("file", "authority").agg(F.concat_ws(" ", "file", first).alias("profile"))


def token_presence(chunks: DataFrame, tokens, examples: int = 5) -> DataFrame:
    """(token, n_chunks, examples) for each of a short list of tokens, found as substrings."""
    spark = chunks.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in tokens], "token string"))
    hits = chunks.join(wanted, F.lower("text").contains(F.col("token")))
    nth = F.row_number().over(Window.partitionBy("token").orderBy("doc_id", "pdf_index", "seq"))
    shown = F.struct("k", F.concat_ws(":", "file", "chunk_id").alias("at"))
    hits = hits.withColumn("k", nth).groupBy("token").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.when(F.col("k") <= examples, shown))).alias("_e"))
    out = wanted.join(hits, "token", "left")
    return out.select("token", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce(F.array_join(F.col("_e")["at"], ";"), F.lit("")).alias("examples"))
