"""License scan by diagonal voting.

1. Every run of three words of every document, as a hash, is joined in Spark with the positions that it has in the templates: a small table of fixed
   size, so it is broadcast and no text is shuffled.
2. A hit at word i of a document and word j of a template votes for the diagonal i - j: words inserted or left out move
   later hits to a neighbouring one. Votes are summed up by document, template and diagonal.
3. Phrases and short notices must match word by word, so each of their full diagonals is a candidate. Of longer templates, diagonals of two
   votes or more that lie within MERGE words of each other are merged, and what could cover LEAST of the template is a candidate.
4. Candidates go to their documents and are verified on the words themselves: the phrase stands there, or three-word runs of equal
   words on the merged diagonals cover so much of the template. ACCEPT of a long template gives its label.

The score is the largest share of a template that is covered, 1 for phrases and notices; shares below LEAST count as 0.

Defined cases: null text is empty; documents without a word or a license keep their row, with null places, empty labels and score 0; very long texts
are cut into pieces for hashing alone, which overlap so that no run is lost; repeated rows give repeated results; rows of one doc_id and different texts
are separate; a null doc_id keeps its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize
from corpusloom.llm.words import as_bytes, hash_words, rolling, slices

GRAM = 3
#: Diagonals of a long template that are this close belong together.
MERGE = 8
LEAST = 0.3
ACCEPT = 0.7
#: Templates of fewer words must match word by word.
LONG = 20
#: Run hashes in one row.
PIECE = 1 << 16
#: Candidates are broadcast to the texts up to this many; beyond, texts are shuffled to them.
BROADCAST_ROWS = 200_000

# License phrases and notices, with the label that each stands for.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "the mit license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("apache-2", "http www apache org licenses license 2 0"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "creative commons zero"),
]
TEXTS = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "apache-2",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies.""",
    ),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE.""",
    ),
]

#: Upper to lower case, and a blank for what is neither a digit nor a letter nor beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    """The text with its words lower-cased and blanks between them."""
    return text.translate(_FOLD)


def templates() -> list[tuple[str, bool, tuple[bytes, ...]]]:
    """(label, whether a base phrase, words) of each template; its number is its place."""
    rows = [(label, base, tuple(fold(text.encode()).split())) for base, group in ((True, PHRASES), (False, [*NOTICES, *TEXTS])) for label, text in group]
    if any(len(words) < GRAM for _, _, words in rows):
        raise ValueError("a template has at least three words")
    return rows


def template_positions(spark: SparkSession, rows) -> DataFrame:
    """(h, template, at, size): each run of GRAM words of each template."""
    out = []
    for number, (_, _, words) in enumerate(rows):
        g = rolling(hash_words([b" ".join(words)])[0], GRAM).view(np.int64)
        out += [(int(h), number, at, len(words)) for at, h in enumerate(g)]
    return spark.createDataFrame(out, "h long, template int, at int, size int")


def _runs(batches):
    """(key, start, h): hashes of all runs of GRAM words of a document, PIECE of them in a row."""
    for part in slices(batches):
        keys = part.column("key").to_numpy()
        h, doc = hash_words([fold(t) for t in as_bytes(part.column("text"))])
        g = rolling(h, GRAM).view(np.int64)
        inside = np.flatnonzero(doc[: len(g)] == doc[GRAM - 1 :]) if len(g) else np.empty(0, np.int64)
        d = doc[inside]
        at = inside - np.searchsorted(doc, d)
        cut = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (at[1:] % PIECE == 0)]) if len(d) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(np.r_[cut, len(d)].astype(np.int32), pa.array(g[inside]))
        yield pa.RecordBatch.from_arrays([pa.array(keys[d[cut]]), pa.array(at[cut]), lists], ["key", "start", "h"])


def diagonals(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """(key, template, size, diagonal, lo, hi): the hits of a document on a diagonal, from word lo to word hi."""
    runs = docs.select("key", "text").mapInArrow(_runs, "key long, start long, h array<long>")
    each = runs.select("key", "start", F.posexplode("h").alias("i", "h")).select("key", (F.col("start") + F.col("i")).alias("pos"), "h")
    hits = each.join(F.broadcast(positions), "h")
    return hits.groupBy("key", "template", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def candidates(found: DataFrame) -> DataFrame:
    """(key, spans array<struct<template, first, last>>): merged diagonals that may hold a template."""
    full = (F.col("lo") == F.col("diagonal")) & (F.col("hi") == F.col("diagonal") + F.col("size") - GRAM)
    short = found.where((F.col("size") < LONG) & full).select("key", "template", F.col("diagonal").alias("first"), F.col("diagonal").alias("last"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    long = found.where((F.col("size") >= LONG) & (F.col("lo") < F.col("hi")))
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > MERGE, F.lit(True))
    long = long.withColumn("new", new.cast("int")).withColumn("block", F.sum("new").over(order))
    long = long.groupBy("key", "template", "size", "block").agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum(F.col("hi") - F.col("lo") + GRAM).alias("most"))
    long = long.where(F.col("most") >= F.floor(F.col("size") * F.lit(LEAST))).select("key", "template", "first", "last")
    return short.unionByName(long).groupBy("key").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))


def covered(words: list[bytes], template: tuple[bytes, ...], first: int, last: int) -> int:
    """Words of the template in runs of GRAM equal words on diagonals first to last that have two such runs."""
    spots: dict[tuple[bytes, ...], list[int]] = {}
    for at in range(len(template) - GRAM + 1):
        spots.setdefault(template[at : at + GRAM], []).append(at)
    hits: dict[int, list[int]] = {}
    for i in range(max(0, first), min(len(words), last + len(template)) - GRAM + 1):
        for at in spots.get(tuple(words[i : i + GRAM]), ()):
            if first <= i - at <= last:
                hits.setdefault(i - at, []).append(at)
    return len({at + k for own in hits.values() if len(own) > 1 for at in own for k in range(GRAM)})


def verify(words: list[bytes], spans, rows) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """(places of base phrases, first and last of them, base labels, all labels, score) of a document's candidates."""
    places, base, labels, score = [], set(), set(), 0.0
    for s in spans:
        label, is_base, template = rows[s["template"]]
        first, last = s["first"], s["last"]
        if len(template) < LONG:
            if tuple(words[first : first + len(template)]) == template:
                labels.add(label)
                score = 1.0
                if is_base:
                    base.add(label)
                    places.append(first)
        elif (share := covered(words, template, first, last) / len(template)) >= LEAST:
            score = max(score, share)
            if share >= ACCEPT:
                labels.add(label)
    return len(places), min(places, default=None), max(places, default=None), base, labels, score


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    rows = templates()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    found = materialize(diagonals(keyed, template_positions(docs.sparkSession, rows)))
    spans = materialize(candidates(found))
    n = spans.select(F.sum(F.size("spans"))).first()[0] or 0
    # Keys may collide: a document then verifies the other one's candidates too, in vain.
    joined = keyed.join(F.broadcast(spans) if n <= BROADCAST_ROWS else spans, "key", "left")

    def run(batches):
        for part in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for text, own in zip(as_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                words = fold(text).split()
                n_base, first, last, base, labels, score = verify(words, own or (), rows)
                for column, v in zip(out, (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)


def label_documents(docs: DataFrame) -> DataFrame:
    """docs with the license labels and the score of each row, in columns of free names."""
    labels, score = fresh(docs, "licenses"), fresh(docs, "license_score")
    found = scan(docs).select("doc_id", F.split(F.when(F.col("labels") != "", F.col("labels")), ",").alias(labels), F.col("score").alias(score))
    best = found.groupBy("doc_id").agg(F.max(F.struct(score, labels)).alias("best"))
    d = docs.alias("d").join(best.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    return d.select("d.*", F.col("b.best")[labels].alias(labels), F.col("b.best")[score].alias(score))
