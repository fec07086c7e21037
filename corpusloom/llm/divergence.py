"""Source divergence audit: how far the term frequencies of each source lie from every other source's and its language's.

A language keeps the terms that enough of its documents hold. A kept term's row is the list of its sources, in a fixed order, with what
the count there makes of the probability p; absent sources are left out. Rows enter a frequent-pattern tree: equal
rows are one path with a multiplicity, and rows that begin alike share the nodes of that beginning.

The divergence of two sources sums f(p, q) over all kept terms. Written as the value for two absent sources, times all terms,
plus a correction for each term that only one of both holds, plus one for each term that both hold:

* what a term adds where one side is absent depends on that side's (source, p) alone, so it is summed over a histogram of these;
* what two present sources add to it is summed over the tree: each node with each of its ancestors, once, times the terms that
  pass through the node.

The tree is never whole anywhere. Rows are range-partitioned in path order, and each Arrow batch is a run of neighbouring
paths; a node that a boundary cuts in two is two nodes with a part of the multiplicity each, which sums to the same.

Defined cases: null text, lang and source are ''; words are runs of letters and non-ASCII characters, only A-Z lower-cased; a row is a document,
so repeated rows count each time; a language without kept terms has pairs of value 0 and no terms; a source alone in its language
has no pairs; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize
from corpusloom.llm.words import as_bytes, slices

MIN_DOCS = 3
TOP_TERMS = 200
#: Probabilities are stated in units of 1 / UNIT.
UNIT = 1_000_000_000
#: Terms that a task holds before it sends their counts on.
HELD = 200_000
#: Node-ancestor combinations that are worked on at a time.
COMBINATIONS = 1 << 20
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count_terms(batches):
    """(lang, source, term, count, docs) of what a task has read, summed up in tables of bounded size."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (count, docs) in held.items():
            n = len(count)
            terms = pa.array(list(count), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(count.values(), pa.int64()), pa.array(map(docs.__getitem__, count), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
        held.clear()

    for part in slices(batches):
        for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), as_bytes(part.column("text")), strict=True):
            terms = text.translate(_LETTERS).split()
            if not terms:
                continue
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(count)
            count.update(terms)
            docs.update(set(terms))
            size += len(count)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def _p(count: Column, words: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (words + terms)), exact for any count; null without terms."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    over = F.when(terms > 0, words + terms).cast("decimal(20,0)")
    return F.call_function("div", whole, over) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _nodes(m: np.ndarray, size: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, multiplicity) of the tree's nodes below another one, of paths in order: `size` elements long, occurring `m` times and
    sharing `lcp` elements with the path before. A node ends where a path shares less than its depth."""
    total = np.r_[0, np.cumsum(m)]
    rows, depths, many = [], [], []
    for depth in range(1, int(size.max(initial=0))):
        cuts = np.flatnonzero(lcp <= depth)
        until = np.r_[cuts[1:], len(m)]
        has = size[cuts] > depth
        rows.append(cuts[has])
        depths.append(np.full(has.sum(), depth))
        many.append((total[until] - total[cuts])[has])
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (rows, depths, many))


def _tree_corrections(batches):
    """(lang, a, b, ab, ba): what terms in both sources add to the divergence of a from b and of b from a."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        code = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        lang = np.array([code[x] for x in langs], np.int64)
        m = batch.column("m").to_numpy().astype(np.int64)
        paths = batch.column("path")
        size = paths.value_lengths().to_numpy().astype(np.int64)
        no, p, p0 = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in paths.flatten().flatten())
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        depth = np.arange(len(row)) - first[row]
        # An element is shared if the path before has the same one there; the first that isn't ends the common beginning.
        there = (row > 0) & (depth < size[row - 1]) & (lang[row] == lang[row - 1])
        at = np.where(there, first[row - 1] + depth, 0)
        shared = there & (no == no[at]) & (p == p[at])
        lcp = np.minimum.reduceat(np.where(shared, size[row], depth), first) if len(row) else size
        rows, depths, many = _nodes(m, size, lcp)
        keys, both = [], []
        edges = np.searchsorted(np.cumsum(depths), np.arange(COMBINATIONS, depths.sum() + COMBINATIONS, COMBINATIONS), side="right") if len(depths) else []
        began = 0
        for end in [*dict.fromkeys(int(e) for e in edges), len(depths)]:
            some = slice(began, max(end, min(began + 1, len(depths))))
            began = some.stop
            d = depths[some]
            node = np.repeat(first[rows[some]] + d, d)
            above = np.repeat(first[rows[some]], d) + np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d)
            weight = np.repeat(many[some], d)
            pa_, qa, pb, qb = p[above], p0[above], p[node], p0[node]
            ab = _divergence(pa_, pb) - _divergence(pa_, qb) - _divergence(qa, pb) + _divergence(qa, qb)
            ba = _divergence(pb, pa_) - _divergence(pb, qa) - _divergence(qb, pa_) + _divergence(qb, qa)
            key = np.stack((lang[row[node]], no[above], no[node]), 1)
            key, of = np.unique(key, axis=0, return_inverse=True)
            sums = np.zeros((len(key), 2), np.int64)
            np.add.at(sums, of.ravel(), np.stack((ab * weight, ba * weight), 1))
            keys.append(key)
            both.append(sums)
        if keys and (key := np.concatenate(keys)).size:
            names, sums = list(code), np.concatenate(both)
            columns = [pa.array([names[i] for i in key[:, 0]], pa.string()), *(pa.array(x, pa.int64()) for x in (key[:, 1], key[:, 2], sums[:, 0], sums[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "ab", "ba"])


def term_rows(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, held array<struct<source, count>>) of the terms that at least min_docs documents of the language hold."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count_terms, "lang string, source string, term string, count long, docs long")
    per = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    rows = per.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("held"))
    return rows.where(F.col("docs") >= min_docs).select("lang", "term", "total", "held")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for every two sources of a language, part `term` for a source's
    most overrepresented terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialize(term_rows(docs, min_docs))
    words = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.count").alias("words"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_words"))
    groups = docs.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["words", "terms", "lang_words"])
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("words").desc(), "source"))
    groups = materialize(groups.withColumn("no", numbered).withColumn("p0", _p(F.lit(0), F.col("words"), F.col("terms"))))

    held = kept.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "term", "total", "h.source", "h.count").join(groups, ["lang", "source"])
    p, q = _p(F.col("count"), F.col("words"), F.col("terms")), _p(F.col("total"), F.col("lang_words"), F.col("terms"))
    held = materialize(held.select("lang", "source", "term", "no", "p0", p.alias("p"), q.alias("q")))

    paths = held.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("no", "p", "p0"))).alias("path"))
    paths = materialize(paths.groupBy("lang", "path").agg(F.count("*").alias("m")))
    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    in_both = ordered.mapInArrow(_tree_corrections, "lang string, a long, b long, ab long, ba long")

    one = held.groupBy("lang", F.col("no").alias("a"), "p").agg(F.count("*").alias("m"), F.first("p0").alias("p0"))
    other = groups.select("lang", F.col("no").alias("b"), F.col("p0").alias("r"))
    in_one = one.join(other, "lang").where("a <> b")
    p, p0, r, m = (F.col(c) for c in ("p", "p0", "r", "m"))
    in_one = in_one.select("lang", F.col("a").cast("long"), F.col("b").cast("long"), (m * (_f(p, r) - _f(p0, r))).alias("ab"), (m * (_f(r, p) - _f(r, p0))).alias("ba"))
    # Either direction is summed on its own, as f isn't symmetric.
    sums = in_both.unionByName(in_one).groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    sums = sums.select("lang", F.explode(F.array(F.struct("a", "b", F.col("ab").alias("more")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("more")))).alias("s"))
    sums = sums.select("lang", "s.*").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))

    left = groups.select("lang", "source", "terms", F.col("no").cast("long").alias("a"), F.col("p0").alias("pa"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("no").cast("long").alias("b"), F.col("p0").alias("pb"))
    pairs = left.join(right, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("terms") * _f(F.col("pa"), F.col("pb")), F.lit(0)) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    terms = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top_terms))
