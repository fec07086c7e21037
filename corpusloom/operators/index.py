"""TF-IDF index tables and similarities as joins over postings.

Spaces: `word` (words of two characters or more, stop words removed, then one- and two-word terms) and `char` (three- to
five-character windows of each blank-padded word). idf = ln((1 + n) / (1 + df)) + 1; a document's weights have unit length.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import let
from corpusloom.operators import blocks as B

#: Rows of a term table (a string and two numbers) that are broadcast; larger ones are joined by sorting.
BROADCAST_ROWS = 1_000_000
WORDS = r"[\p{L}\p{N}_]{2,}"


def word_terms(text: Column, stop: Sequence[str] = ()) -> Column:
    """Array of the word space's terms, repeats kept."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)
    if stop:
        w = F.filter(w, lambda x: ~x.isin(*stop))
    return let(w, _with_pairs)


def _with_pairs(w: Column) -> Column:
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_terms(text: Column, shortest: int = 3, longest: int = 5) -> Column:
    """Array of the char space's terms: windows of each word padded with a blank on both sides; a padded word that is shorter
    than a window is its own term once."""
    none = F.array().cast("array<string>")

    def of_size(p, size):
        fits = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - size + 1)), lambda i: F.substring(p, i, F.lit(size)))
        return F.when(F.length(p) >= size, fits).otherwise(F.array(p) if size == shortest else none)

    def windows(word):
        p = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[of_size(p, size) for size in range(shortest, longest + 1)])

    return F.flatten(F.transform(char_words(text), windows))


def char_words(text: Column) -> Column:
    """Array of the words whose windows are the char space's terms."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+"), lambda x: x != "")


def char_windows(word: str) -> list[str]:
    """The terms that char_terms makes of one word."""
    p = f" {word} "
    return [p[at : at + size] for size in (3, 4, 5) for at in range(len(p) - size + 1)]


#: Where terms are counted in Arrow, the windows of a word are made once a block instead of once a place.
char_terms.made_of = (char_words, char_windows)
#: And how a block makes a space's terms of its words (`blocks`).
char_terms.in_blocks = B.windows
word_terms.in_blocks = B.pairs()


def dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key in as many tasks as shuffles have: their texts are small, but what is made of them is not, so none are merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def counts(rows: DataFrame, key: list[str], terms: Column) -> DataFrame:
    """(key, term, tf). Rows are dealt by key first, so that their many terms are counted where they are."""
    return dealt(rows, key).select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def space_counts(rows: DataFrame, key: list[str], spaces: Mapping[str, Callable[[Column], Column]], text: str) -> DataFrame:
    """(key, space, term, tf) of several spaces at once, each a function of a text column."""
    each = F.array(*[F.struct(F.lit(name).alias("space"), terms(F.col(text)).alias("terms")) for name, terms in spaces.items()])
    x = dealt(rows, key).select(*key, F.inline(each)).select(*key, "space", F.explode("terms").alias("term"))
    return x.groupBy(*key, "space", "term").agg(F.count("*").alias("tf"))


#: Rows whose terms are counted together in Arrow.
BLOCK = 4096


def term_sources(spaces: Mapping[str, Callable[[Column], Column]], text: str) -> tuple[list[Column], list]:
    """(columns, windows) of spaces: an array column each, of terms, or of the words that the space's windows make terms of."""
    made = [getattr(terms, "made_of", (terms, None)) for terms in spaces.values()]
    return [column(F.col(text)).alias(name) for name, (column, _) in zip(spaces, made, strict=True)], [windows for _, windows in made]


def block_terms(lists, windows=None):
    """(terms, row, no, tf) of an Arrow array of lists: the distinct terms, and for each list and each term in it the list's row, the term's number and count."""
    from itertools import chain

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    terms, no, row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    if windows is not None:
        key, times = np.unique(row * max(1, len(terms)) + no, return_counts=True)
        row, no = np.divmod(key, max(1, len(terms)))
        made = [windows(w) for w in terms.to_pylist()]
        ends = np.r_[0, np.cumsum([len(m) for m in made])].astype(np.int64)
        coded = pa.array(chain.from_iterable(made), pa.string()).dictionary_encode()
        many = ends[no + 1] - ends[no]
        at = np.repeat(ends[no] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        terms, row, no = coded.dictionary, np.repeat(row, many), coded.indices.to_numpy(zero_copy_only=False)[at]
        # Counts ride in the low bits of the sorted numbers, so that no order of places has to be kept.
        bits = int(times.max(initial=0)).bit_length()
        places = np.sort((row * max(1, len(terms)) + no) << bits | np.repeat(times, many))
        key = places >> bits
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, tf = key[first], np.add.reduceat(places & ((1 << bits) - 1), first) if len(key) else key
    else:
        key, tf = np.unique(row * max(1, len(terms)) + no, return_counts=True)
    row, no = np.divmod(key, max(1, len(terms)))
    return terms, row, no, tf


def counted_vocabulary(rows: DataFrame, key: list[str], spaces: Mapping[str, Callable[[Column], Column]], text: str) -> DataFrame:
    """(space, term, df, idf) over all rows, as space_vocabulary has it of space_counts. Rows are counted by block, so that a block's term is a row and not each of its places."""
    columns, windows = term_sources(spaces, text)
    names = list(spaces)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for i, name in enumerate(names):
                    terms, _, no, _ = block_terms(part.column(i), windows[i])
                    df = pa.array(np.bincount(no, minlength=len(terms)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(terms), pa.string()), terms, df], ["space", "term", "df"])

    df = dealt(rows.select(*key, text), key).select(*columns).mapInArrow(count, "space string, term string, df long").groupBy("space", "term").agg(F.sum("df").alias("df"))
    n_docs = rows.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n_docs)).select("space", "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def space_vocabulary(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(space, term, df, idf); n_docs has one row, one column n."""
    df = tf.groupBy("space", "term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("space", "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def frequent(vocab: DataFrame, most: int = BROADCAST_ROWS) -> int | None:
    """The document frequency from which on at most `most` terms remain, or None where all do."""
    per = vocab.groupBy("df").agg(F.count("*").alias("n"))
    over = per.select("df", F.sum("n").over(Window.orderBy(F.desc("df"))).alias("upto")).where(F.col("upto") > most)  # a row per frequency
    highest = over.agg(F.max("df")).first()[0]
    return None if highest is None else highest + 1


def sized(side: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A join side of `rows` rows: broadcast up to `most`, merged beyond."""
    return F.broadcast(side) if rows <= most else side.hint("merge")


def vocabulary(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf); n_docs has one row, one column n."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def weights(tf: DataFrame, vocab: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, weight): tf * idf scaled to unit length per key; terms outside the vocabulary drop out first."""
    raw = tf.join(vocab.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))
    return raw.select(*key, "term", (F.col("w") / norm).alias("weight"))


def similarities(queries: DataFrame, documents: DataFrame, q_key: list[str], d_key: list[str]) -> DataFrame:
    """(q_key, d_key, sim): dot products of unit weights over shared terms; pairs without one are absent (0).

    The queries' terms meet the documents' where those are while they are few; documents dealt by d_key then need no further shuffle.
    """
    from corpusloom.sources.index_store import kept

    q = kept(queries.select(*q_key, "term", F.col("weight").alias("qw")))
    q = sized(q, q.count())
    d = documents.select(*d_key, "term", F.col("weight").alias("dw"))
    return d.join(q, "term").groupBy(*q_key, *d_key).agg(F.sum(F.col("qw") * F.col("dw")).alias("sim"))


def search_space(chunks: DataFrame, questions: DataFrame, terms, d_key: list[str], q_key: list[str], text: str, q_text: str) -> DataFrame:
    """Similarities of every question with every chunk in one space; terms is the space's function of a text column.

    Document weights are computed over all terms and cut to the questions' terms before the join: only shared terms count.
    """
    from corpusloom.sources.index_store import kept

    tf = counts(chunks, d_key, terms(F.col(text)))
    vocab = kept(vocabulary(tf, chunks.agg(F.count("*").alias("n"))))
    q = kept(weights(counts(questions, q_key, terms(F.col(q_text))), vocab, q_key))
    known = vocab.join(q.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left")
    raw = F.col("tf") * F.col("idf")
    docs = tf.join(known, "term").repartition(*d_key).groupBy(*d_key).agg(F.sqrt(F.sum(raw * raw)).alias("norm"), F.collect_list(F.when(F.col("asked"), F.struct("term", raw.alias("w")))).alias("ts"))
    docs = docs.select(*d_key, "norm", F.inline("ts")).select(*d_key, "term", (F.col("w") / F.col("norm")).alias("weight"))
    return similarities(q, docs, q_key, d_key)
