"""Mixing sources to target weights, on DataFrame functions alone.

Every document gets a hash-random key; within a source, documents are ranked by that key. The key's range is cut
into equal intervals (the keys are uniform, so this is a range partitioning that needs no sampling and splits a hot
source as finely as wanted). Interval totals give distributed prefix sums; only the interval in which a source's
budget ends is sorted. The outcome of that sort is one cut per source, so the texts themselves never move.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, sorted last; documents
of equal key (repeated ids) are ordered by size; identical rows are interchangeable; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize, n_words

WEIGHTS = (3.0, 1.0, 2.0)
#: Rows that one interval of the key range holds on average.
INTERVAL_ROWS = 4096


def _key(doc_id: Column) -> Column:
    """A hash-random key in [0, 2**60): the first 15 hex digits of the id's MD5."""
    digits = F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target) from rows (source, size).

    Weights repeat over the sources in code point order, null last. All targets sum to `share` of all sizes; none
    passes `most` times its source's size: filling by weight, sources reach their cap in order of cap / weight, so the
    water level follows from running sums over that order.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("pos"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("pos", F.row_number().over(order) - 1).withColumn("weight", pick)
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(every))
    per = per.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    # Past the first source that stays below its cap, the level is that source's.
    per = per.withColumn("final", F.min(F.when(F.col("open"), F.struct("ratio", "pos", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return per.select("source", "n_docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, interval_rows: int = INTERVAL_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (words, repeats counted).

    A source's budget is its target rounded to words. Whole passes over the source come first; the last, partial pass
    takes documents in key order up to the budget, the last of them in part, so a source's taken words meet its budget.
    """
    sized = docs.select("doc_id", F.col("source"), n_words(F.col("text")).alias("size")).withColumn("key", _key(F.col("doc_id")))
    sized = materialize(sized)
    stats = materialize(source_targets(sized, weights, share, most))
    stats = stats.withColumn("budget", F.round("target").cast("long"))
    stats = stats.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    stats = stats.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    stats = stats.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(interval_rows))).cast("long"))

    unit = F.col("key") / F.lit(2.0**60)  # in [0, 1), monotone in key
    s = stats.alias("s")
    placed = sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("d.doc_id", "d.source", "d.size", "d.key", "s.rest", F.least(F.floor(unit * F.col("s.parts")), F.col("s.parts") - 1).alias("part"))
    totals = placed.groupBy("source", "part", "rest").agg(F.sum("size").alias("part_size"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0)))
    edge = totals.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("part_size") >= F.col("rest"))).select("source", "part", "before")
    edge = materialize(edge)
    e = edge.alias("e")
    inside = placed.alias("p").join(e, F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.part") == F.col("e.part")))
    inside = inside.select("p.source", "p.doc_id", "p.key", "p.size", "p.rest", "e.before")
    by_key = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    inside = inside.withColumn("nth", F.row_number().over(by_key)).withColumn("start", F.col("before") + F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    cut = inside.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") >= F.col("rest")))
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_doc"), F.col("size").alias("cut_size"), (F.col("rest") - F.col("start")).alias("cut_words"))
    c = cut.alias("c")
    bounds = materialize(stats.alias("s").join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.source", "s.source_size", "s.target", "s.passes", "s.rest", "cut_key", "cut_doc", "cut_size", "cut_words"))

    b = bounds.alias("b")
    rows = sized.alias("d").join(b, F.col("d.source").eqNullSafe(F.col("b.source")))
    here, there = F.struct("d.key", "d.doc_id", "d.size"), F.struct("b.cut_key", "b.cut_doc", "b.cut_size")
    partial = F.when(F.col("b.rest") <= 0, F.lit(0)).when(here < there, F.col("d.size")).when(here == there, F.col("b.cut_words")).otherwise(F.lit(0))
    taken = F.col("b.passes") * F.col("d.size") + F.coalesce(partial, F.lit(0))
    return rows.select("d.doc_id", "d.source", "d.size", F.col("b.source_size"), F.col("b.target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **plan) -> DataFrame:
    """The mixed rows: each document as often as whole passes take it, and its first words where a pass ends inside it.

    All columns are kept; `text` is cut and `n_chars`, where there is one, follows it. Documents of no words are left out. Rows of one doc_id, source and
    size are planned alike, so each gives as many words; rows of one doc_id and other sizes are planned on their own.
    """
    passes, size, words_taken = (fresh(docs, c) for c in ("pass", "size", "taken"))
    key = [F.col("doc_id"), F.col("source"), F.col("size").alias(size)]
    taken = plan_mix(docs, **plan).groupBy(*key).agg(F.max("taken").alias(words_taken)).where(F.col(words_taken) > 0)
    d, t = docs.withColumn(size, n_words(F.col("text"))).alias("d"), taken.alias("t")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source")]
    joined = d.join(t, same[0] & same[1] & (F.col(f"d.{size}") == F.col(f"t.{size}")))
    rows = joined.select("d.*", words_taken).withColumn(passes, F.explode(F.sequence(F.lit(1), F.ceil(F.col(words_taken) / F.col(size)).cast("int"))))
    left = F.col(words_taken) - (F.col(passes) - 1) * F.col(size)
    words = F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), left.cast("int"))
    cut = left < F.col(size)
    rows = rows.withColumn("text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
