"""Hybrid retrieval over questions x chunks: blend, priors, boosts, filters, ranking, diversity, retries and balance.

Chunks are keyed by (file, pdf_index, chunk_id); every window has a total order. Rows of a question and a chunk carry `base`
(blend and priors) and `final` (base and requirement boost).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import query as Q
from corpusloom.functions import text as T
from corpusloom.operators import blocks as B
from corpusloom.operators import index as I

KEY = ["file", "pdf_index", "chunk_id"]


def search_tokens(text: Column) -> Column:
    return T.tokens(text, C.SEARCH_STOP)


def token_overlap(questions: DataFrame, chunks: DataFrame, q_text: str = "q_aug", text: str = "text", by: Sequence[str] = ("qid",)) -> DataFrame:
    """(by, KEY, overlap): shared distinct tokens over the question's, by a join on tokens; pairs sharing none are absent."""
    q = questions.select(*by, search_tokens(F.col(q_text)).alias("_t")).withColumn("_n", F.size("_t"))
    q = q.select(*by, "_n", F.explode("_t").alias("token"))
    # A chunk's tokens are dealt out by its key, so that no pair is shuffled where the questions' tokens are small enough to be sent to every task.
    c = chunks.select(*KEY, search_tokens(F.col(text)).alias("_c")).repartition(*KEY).select(*KEY, F.explode("_c").alias("token"))
    return q.join(c, "token").groupBy(*by, *KEY).agg((F.count("*") / F.first("_n")).alias("overlap"))


def requirement_hits(text: Column, signals=C.REQUIREMENT_SIGNALS, cap: int = 3) -> Column:
    """Word-bounded occurrences of the signals, at most `cap`."""
    s = T.collapsed(text)
    total = F.lit(0)
    for signal in signals:
        total = total + F.regexp_count(s, F.lit(rf"\b{signal}\b"))
    return F.least(F.lit(cap), total)


def requirement_boost(hits: Column, w: C.Weights = C.DEFAULT) -> Column:
    return F.when(hits > 0, F.least(F.lit(w.max_boost), hits * w.boost_per_hit)).otherwise(F.lit(0.0))


def prior(q: Column, authority: Column, file: Column, text: Column, profiles: Sequence[Mapping] = C.PROFILES, sop_signals=("internal sop", "our sop", "sop", "internal procedure", "work instruction"), toc: str = "table of contents") -> Column:
    """Query-aware priors: boosts of every profile that the question's signals switch on, and small fixed ones."""
    return switched_prior(switched_on(q, profiles, sop_signals), authority, file, text, profiles, toc)


def switched_on(q: Column, profiles: Sequence[Mapping], sop_signals: Sequence[str]) -> Column:
    """The question's side of the priors: a bit per profile that its signals switch on, the last for the SOP signals."""
    bits = F.lit(0)
    for i, signals in enumerate([*(p["signals"] for p in profiles), sop_signals]):
        bits = bits + F.when(T.contains_any(F.lower(q), signals), 1 << i).otherwise(0)
    return bits


def prior_parts(authority: Column, file: Column, text: Column, profiles: Sequence[Mapping], toc: str = "table of contents") -> Column:
    """The chunk's side of the priors: what each bit of switched_on adds, and at the end what every question gets."""
    f, t = F.lower(file), F.lower(text)
    parts = []
    for p in profiles:
        part = F.lit(0.0)
        for a, boost in p.get("authority", {}).items():
            part = part + F.when(authority == a, boost).otherwise(0.0)
        for pattern, boost in p.get("file", ()):
            part = part + F.when(f.contains(pattern), boost).otherwise(0.0)
        for pattern, boost in p.get("text", ()):
            part = part + F.when(t.contains(pattern), boost).otherwise(0.0)
        parts.append(part)
    parts.append(F.when(authority == "SOP", 0.22).otherwise(0.0))
    always = -F.when(f.contains("aide-memoire") | t.contains("aide-memoire"), 0.06).otherwise(0.0)
    always = always - F.when(f.contains("manual-"), 0.04).otherwise(0.0) - F.when(t.contains(toc), 0.06).otherwise(0.0)
    always = always - F.when(t.rlike(T.DIAGRAM), 0.10).otherwise(0.0) - F.when(F.length(t) < 80, 0.03).otherwise(0.0)
    return F.array(*parts, always)


def switched_prior(bits: Column, authority: Column, file: Column, text: Column, profiles: Sequence[Mapping], toc: str = "table of contents") -> Column:
    """The prior of a chunk for questions with these bits of switched_on."""
    return prior_sum(bits, prior_parts(authority, file, text, profiles, toc), profiles)


def prior_sum(bits: Column, parts: Column, profiles: Sequence[Mapping]) -> Column:
    """The prior from a chunk's prior_parts."""
    score = parts[len(profiles) + 1]
    for i in range(len(profiles) + 1):
        score = score + F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, parts[i]).otherwise(0.0)
    return score


def in_scope(scope: Column, authority: Column, scopes: Mapping[str, Sequence[str]] = C.SCOPES) -> Column:
    """Whether the scope admits the authority; an unknown scope admits all that the mixed one does."""
    s = F.upper(F.btrim(F.coalesce(scope, F.lit("MIXED"))))
    admitted = F.lit(False)
    known = F.lit(False)
    for name, names in scopes.items():
        admitted = admitted | ((s == name) & authority.isin(*names))
        known = known | (s == name)
    return admitted | (~known & authority.isin(*scopes["MIXED"]))


def admitted_authorities(scope: Column, scopes: Mapping[str, Sequence[str]] = C.SCOPES) -> Column:
    """Array of the authorities that in_scope admits."""
    names = dict.fromkeys(a for own in scopes.values() for a in own)
    return F.array_compact(F.array(*[F.when(in_scope(scope, F.lit(a), scopes), F.lit(a)) for a in names]))


def score_pairs(pairs: DataFrame, word: DataFrame, char: DataFrame, overlap: DataFrame, by: Sequence[str], prior_column: Column, hits: Column, broad: Column, w: C.Weights = C.DEFAULT) -> DataFrame:
    """pairs with sim_word, sim_char, overlap, base, hits, boost and final; an absent similarity is 0."""
    keys = [*by, *KEY]
    x = pairs.join(word.withColumnRenamed("sim", "sim_word"), keys, "left").join(char.withColumnRenamed("sim", "sim_char"), keys, "left").join(overlap, keys, "left")
    x = x.fillna(0.0, ["sim_word", "sim_char", "overlap"])
    x = x.withColumn("base", w.word * F.col("sim_word") + w.char * F.col("sim_char") + w.overlap * F.col("overlap") + prior_column)
    x = x.withColumn("hits", F.when(broad, hits).otherwise(F.lit(0)))
    return x.withColumn("boost", requirement_boost(F.col("hits"), w)).withColumn("final", F.col("base") + F.col("boost"))


def _packed(t) -> bytes:
    """An Arrow table as bytes."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(blob).read_all().combine_chunks()


#: Spaces by their number; a term's number in asked_terms says its space, too.
SPACE = {"word": 0, "char": 1, "token": 2}


def asked_terms(questions: DataFrame, spaces: Mapping, by: Sequence[str] = ("qid",)) -> DataFrame:
    """(space, term, tid) of the questions' terms and tokens; to be kept, as the numbers differ from run to run."""
    terms = I.space_counts(questions, [*by], {**spaces, "token": search_tokens}, "q_aug").select("space", "term").distinct()
    kind = F.element_at(F.create_map(*[F.lit(x) for item in SPACE.items() for x in item]), F.col("space"))
    return terms.withColumn("tid", F.monotonically_increasing_id() * 4 + kind)


def blocks_of(chunks: DataFrame) -> tuple[int, int]:
    """(chunks, blocks): blocks of up to about I.BLOCK chunks, small tables in as many as there are tasks at once."""
    n = chunks.count()
    return n, max(1, -(-n // I.BLOCK), min(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-n // 512)))


def block_tasks(blocks: int) -> int:
    """Tasks that blocks are dealt to by hash: of a few blocks, hardly two meet in one."""
    return max(blocks, min(8 * blocks, 400))


def _dealt_blocks(chunks: DataFrame, blocks: int, carried: Sequence[Column], spaces: Mapping) -> tuple[DataFrame, list]:
    """(rows, windows): the chunks dealt to their blocks, with `_block`, `_order` and a list column a space, made where the block is."""
    columns, windows = I.term_sources({**spaces, "token": search_tokens}, "text")
    block = F.pmod(F.xxhash64(*KEY), F.lit(blocks)).cast("int")
    rows = chunks.withColumn("_block", block).repartition(block_tasks(blocks), "_block")
    return rows.select("_block", F.xxhash64("text").alias("_order"), *carried, *columns), windows


def _block_terms(part, names: Sequence[str], windows: Sequence):
    """(rows, [(terms, row, no, tf)]) of a block, the same whenever it is read: its rows in order, and I.block_terms of each space."""
    import pyarrow.compute as pc

    part = part.combine_chunks()
    part = part.take(pc.sort_indices(part.select([*KEY, "_order"]), [(k, "ascending") for k in (*KEY, "_order")])).combine_chunks()
    column = lambda name: part.column(name).chunk(0) if part.num_rows else part.column(name).combine_chunks()
    return part, [I.block_terms(column(name), made) for name, made in zip(names, windows, strict=True)]


def counted_blocks(chunks: DataFrame, blocks: int, asked: DataFrame, spaces: Mapping, vocab: DataFrame | None = None) -> DataFrame:
    """(_block, kind, no, df, tid, term): what a block can't know of its own terms, to be sent back to it.

    A row is a term of a block, by its number there, that is asked for or that other blocks hold, too; any other has the frequency that its block counts. The word
    space's terms of two chunks and more are named, once each. Frequencies are counted over all blocks, or looked up in vocab (space, term, df).
    """
    names = [*spaces, "token"]
    rows, windows = _dealt_blocks(chunks, blocks, [F.col(k) for k in KEY], spaces)

    def count(part):
        import pyarrow as pa

        block = part.column("_block")[0].as_py()
        out = []
        for name, (terms, _, no, _) in zip(names, _block_terms(part, names, windows)[1], strict=True):
            n = len(terms)
            here = np.bincount(no, minlength=n).astype(np.int64)
            out.append(pa.table([pa.array(np.full(n, SPACE[name], np.int8)), terms.cast(pa.string()), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(here)], names=["kind", "term", "_block", "no", "here"]))
        return pa.concat_tables(out).combine_chunks()

    found = rows.groupBy("_block").applyInArrow(count, "kind byte, term string, _block int, no int, here long")
    kind = F.element_at(F.create_map(*[F.lit(x) for item in SPACE.items() for x in item]), F.col("space")).cast("byte").alias("kind")
    # By a hash first: terms begin alike, and a sort that can tell rows by their first bytes needs not compare them whole.
    found = found.withColumn("_hash", F.xxhash64("kind", "term"))
    w = Window.partitionBy("_hash", "kind", "term")
    if vocab is None:
        found = found.withColumn("df", F.sum("here").over(w))
    else:
        found = found.join(vocab.select(kind, "term", "df"), ["kind", "term"], "left").withColumn("df", F.coalesce("df", "here"))
    found = found.withColumn("_first", F.min("_block").over(w) == F.col("_block"))
    found = found.join(I.sized(asked.select(kind, "term", "tid"), asked.count()), ["kind", "term"], "left")
    named = (F.col("kind") == SPACE["word"]) & F.col("_first") & (F.col("df") > 1)
    shared = (F.col("kind") != SPACE["token"]) & (F.col("df") != F.col("here"))
    return found.where(F.col("tid").isNotNull() | shared | named).select("_block", "kind", "no", "df", "tid", F.when(named, F.col("term")).alias("term"))


def word_vocabulary(counted: DataFrame) -> DataFrame:
    """(term, df) of the word space's terms that more than one chunk holds, from counted_blocks."""
    return counted.where("term is not null").select("term", "df")


def asked_keys(terms: DataFrame) -> DataFrame:
    """(space, term, tid) of the distinct terms of term_rows, numbered without gaps; to be kept, as the numbers differ from run to run."""
    kind = F.element_at(F.create_map(*[F.lit(x) for item in SPACE.items() for x in item]), F.col("space"))
    return terms.select("space", "term").distinct().coalesce(1).withColumn("tid", F.monotonically_increasing_id() * 4 + kind)


def question_terms(questions: DataFrame, spaces: Mapping, by: Sequence[str] = ("qid",)) -> DataFrame:
    """(by, space, term, tf) of the questions' terms and tokens, by their keys."""
    return B.term_rows(questions, [*by], _made(spaces), "q_aug")


def _made(spaces: Mapping) -> dict:
    return B.makers(spaces) | {"token": B.letter_tokens(C.SEARCH_STOP)}


def _block_rows(chunks: DataFrame, blocks: int, *carried: Column) -> DataFrame:
    block = F.pmod(F.xxhash64(*KEY), F.lit(blocks)).cast("int")
    rows = chunks.withColumn("_block", block).repartition(block_tasks(blocks), "_block")
    return rows.select("_block", *carried, B.lowered(F.col("text")).alias("_low"))


def told(chunks: DataFrame, blocks: int, asked: DataFrame, spaces: Mapping) -> DataFrame:
    """told_blocks of the chunks; to be kept."""
    return B.told_blocks(_block_rows(chunks, blocks), asked, _made(spaces), max(8, blocks), SPACE)


def _told_frequencies(found: B.Terms, every: Sequence, blocks: int, told, k: int, spaces: int) -> tuple[np.ndarray, np.ndarray]:
    """(df, tid) of a block's terms of its k-th space: over all blocks, and -1 where a term isn't asked for."""
    other, dfs, use, tids = B.told_numbers(found, max(8, blocks), told.column("part").to_pylist(), told.column("told").to_pylist(), k, spaces)
    tid = np.full(len(found.keys), -1, np.int64)
    tid[use] = tids
    df = sum((np.bincount(no, minlength=len(found.keys)) for _, no, _ in every), np.zeros(len(found.keys), np.int64))
    df[other] = dfs
    return df, tid


def _told_weights(n: int, blocks: int, make: Mapping, carried: Sequence[str], block: int, key: Sequence[str] = ()):
    """Arrow function over a block's rows and its rows of `told`: (chunks), packed tables of the rows with the lengths of their vectors over all terms (word, char)
    and the counts of the asked terms (terms_0, terms_1, terms_2: tid, w), whose idf the questions' weights hold."""
    import pyarrow as pa

    def run(part, told):
        part = part.combine_chunks()
        words, keys = B.Words(part.column("_low").combine_chunks()), B.rows_of_keys(part, key) if key else None
        table = part.select(list(carried))
        table = table if keys is None else table.take(pa.array(keys[1]))
        rows = table.num_rows
        for k, (name, terms) in enumerate(make.items()):
            found = B.merged(terms(words), keys)
            every = list(found.slices())
            df, tid = _told_frequencies(found, every, blocks, told, k, len(make))
            idf = np.ones(len(df)) if name == "token" else np.log((1 + n) / (1 + df)) + 1
            square, asked = np.zeros(rows), []
            for row, no, tf in every:
                raw = tf * idf[no]
                square += np.bincount(row, weights=raw * raw, minlength=rows)
                hit = np.flatnonzero(tid[no] >= 0)
                asked.append((row[hit], tid[no[hit]], tf[hit].astype(np.int32)))
            row, ids, tf = (np.concatenate(x) for x in zip(*asked, strict=True)) if asked else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
            ids = ids.astype(np.int32) if ids.max(initial=0) < 1 << 31 else ids
            if name != "token":
                table = table.append_column(name, pa.array(np.sqrt(square)))
            table = table.append_column(f"terms_{SPACE[name]}", _lists(row, rows, pa.StructArray.from_arrays([pa.array(ids), pa.array(tf)], ["tid", "w"])))
        return pa.table({"chunks": pa.array([_packed(table.slice(at, block).combine_chunks()) for at in range(0, rows, block)], pa.binary())})

    return run


def _weighted(n: int, names: Sequence[str], windows: Sequence, carried: Sequence[str], block: int):
    """Arrow function over a block's rows and its rows of counted_blocks: (chunks), packed tables of the rows with the lengths of their vectors over all terms (word,
    char) and their weights in the asked terms (terms: tid, w)."""
    import pyarrow as pa

    def run(part, counted):
        part, spaces = _block_terms(part, names, windows)
        rows = part.num_rows
        kinds, numbers, dfs = (counted.column(c).to_numpy() for c in ("kind", "no", "df"))
        tids = counted.column("tid").fill_null(-1).to_numpy()
        table = part.select(list(carried))
        asked = []
        for name, (terms, row, no, tf) in zip(names, spaces, strict=True):
            mine = kinds == SPACE[name]
            tid = np.full(len(terms), -1, np.int64)
            tid[numbers[mine]] = tids[mine]
            raw = np.ones(len(row))
            if name != "token":
                df = np.bincount(no, minlength=len(terms))
                df[numbers[mine]] = dfs[mine]
                raw = tf * (np.log((1 + n) / (1 + df)) + 1)[no]
                table = table.append_column(name, pa.array(np.sqrt(np.bincount(row, weights=raw * raw, minlength=rows)), pa.float64()))
            use = tid[no] >= 0
            asked.append((row[use], tid[no][use], raw[use]))
        row, tid, raw = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.argsort(row, kind="stable")
        table = table.append_column("terms", _lists(row, rows, pa.StructArray.from_arrays([pa.array(tid[order]), pa.array(raw[order])], ["tid", "w"])))
        return pa.table({"chunks": pa.array([_packed(table.slice(at, block).combine_chunks()) for at in range(0, rows, block)], pa.binary())})

    return run


def _lists(row: np.ndarray, n: int, values):
    """A list a row of values that are sorted by row."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)), values)


def score_reaching(
    questions: DataFrame, chunks: DataFrame, spaces: Mapping, vocab: DataFrame | None, least: float, parts: Column, hits: Column, broad: Column, by: Sequence[str] = ("qid",), w: C.Weights = C.DEFAULT,
    block: int = 1024, kept=None, counted: tuple[DataFrame, DataFrame] | None = None, best: tuple[int, Sequence[tuple]] | None = None,
) -> DataFrame:
    """Rows (questions' columns but q_aug and bits, KEY, authority, sim_word, sim_char, overlap, base, hits, boost, final) of every question with every
    chunk whose base score reaches `least`.

    questions (by, q_aug, bits ...) are a stated set, and chunks are many. Both become tables of blocks, a row each, and every two blocks are one
    product, so that no pair below `least` leaves its task. A block of chunks counts its terms twice, once to tell them to all and once to weigh them, so that no
    posting is shuffled: what comes back to it is a number and a frequency a term. Questions are
    never on the driver: their blocks are broadcast while they are few and read by every task beyond. chunks are read twice and must be the same both times. spaces has
    the term functions of `word` and `char`, which say how blocks make them; counted has what was kept of asked_keys and told; kept writes a table and reads it
    back. With vocab, their (space, term, df), frequencies are looked up by the terms themselves.

    best (k, rules) leaves out rows that can't be among a question's k best by final score under any rule: (admitted, allowed, least), whether a rule asks for an
    authority in the question's array column `_scope`, for a file in its `_files` (null: any), and for which base score. The rows that stay hold all of the best, and others.
    """
    import pyarrow as pa

    if kept is None:
        from corpusloom.sources.index_store import kept
    n_chunks, blocks = blocks_of(chunks)
    asks = questions.withColumn("_broad", broad)
    if vocab is None:
        terms = kept(question_terms(questions, spaces, by))
        if counted is None:
            asked = kept(asked_keys(terms))
            counted = asked, kept(told(chunks, blocks, asked, spaces))
        asked, counted = counted
        dfs = B.asked_frequencies(counted, len(SPACE))
        tokens = terms.where("space = 'token'").withColumn("w", F.col("tf") / F.count("*").over(Window.partitionBy(*by)))
    else:
        terms = I.space_counts(questions, [*by], spaces, "q_aug")
        asked = kept(asked_terms(questions, spaces, by))
        counted = kept(counted_blocks(chunks, blocks, asked, spaces, vocab))
        dfs = counted.where("tid is not null").groupBy("tid").agg(F.first("df").alias("df"))
        tokens = asks.select(*by, search_tokens(F.col("q_aug")).alias("_t")).select(*by, F.lit("token").alias("space"), F.explode("_t").alias("term"), (F.lit(1.0) / F.size("_t")).alias("w"))
    found = asked.where("space <> 'token'").join(dfs, "tid").select("space", "term", "tid", I.idf(F.lit(n_chunks), F.col("df")).alias("idf"))
    weighted = terms.join(found, ["space", "term"]).select(*by, "space", "tid", (F.col("tf") * F.col("idf")).alias("w"), F.col("idf") if vocab is None else F.lit(1.0).alias("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, "space")))
    tokens = tokens.join(asked, ["space", "term"])
    mine = weighted.select(*by, "tid", (F.col("w") / norm * F.col("idf")).alias("w")).unionByName(tokens.select(*by, "tid", "w"))
    mine = mine.groupBy(*by).agg(F.collect_list(F.struct("tid", "w")).alias("terms"))
    q = asks.join(mine, [*by], "left")
    n = asks.count()
    q_count = max(1, -(-n // block))
    q = q.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(q_count)).cast("int")).drop("q_aug")

    q_blocks = kept(q.groupBy("_block").applyInArrow(lambda t: pa.table({"no": t.column("_block").slice(0, 1), "asks": pa.array([_packed(t)], pa.large_binary() if t.nbytes > 1 << 30 else pa.binary())}), "no int, asks binary"))
    carried = [*map(F.col, KEY), F.col("authority"), parts.alias("parts"), hits.cast("int").alias("hits")]
    names = [*KEY, "authority", "parts", "hits"]
    if vocab is None:
        rows = _block_rows(chunks, blocks, *carried)
        weigh = _told_weights(n_chunks, blocks, _made(spaces), names, block)
        sent = counted.where("_block >= 0")
    else:
        rows, windows = _dealt_blocks(chunks, blocks, carried, spaces)
        weigh = _weighted(n_chunks, [*spaces, "token"], windows, names, block)
        sent = counted.select("_block", "kind", "no", "df", "tid")
    c_blocks = rows.groupBy("_block").cogroup(sent.repartition(block_tasks(blocks), "_block").groupBy("_block")).applyInArrow(weigh, "chunks binary")
    few = n * 4096 <= BROADCAST_BYTES
    pairs = c_blocks.crossJoin(F.broadcast(q_blocks) if few else q_blocks)  # a row for every two blocks
    named = [f for f in questions.schema if f.name not in ("q_aug", "bits", "_scope", "_files")]
    fields = [*named, *[chunks.schema[c] for c in (*KEY, "authority")]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sim_word double, sim_char double, overlap double, base double, hits int, boost double, final double"
    return pairs.mapInArrow(_scorer([f.name for f in named], least, w, best), schema)


def best_similarities(documents: DataFrame, questions: DataFrame, terms, d_key: str, q_key: str, form: str, text: str, q_text: str, block: int = 1024) -> DataFrame:
    """(q_key, d_key, sim): for a question and a document, the highest similarity over the question's forms (q_key, form) in one space, where it is above 0.

    What search_space has of all forms, as products of blocks of questions, a question's forms together, with the documents' terms where those are.
    """
    import pyarrow as pa

    from corpusloom.sources.index_store import kept

    by = [q_key, form]
    tf = kept(I.counts(documents, [d_key], terms(F.col(text))))
    vocab = kept(I.vocabulary(tf, documents.agg(F.count("*").alias("n"))))
    q = kept(I.weights(I.counts(questions, by, terms(F.col(q_text))), vocab, by))
    asked = kept(q.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    raw = F.col("tf") * F.col("idf")
    n_terms = vocab.count()
    known = vocab.select("term", "idf").join(asked, "term", "left")
    held = tf.join(I.sized(known, n_terms), "term").groupBy(d_key).agg(F.sqrt(F.sum(raw * raw)).alias("norm"), F.collect_list(F.when(F.col("tid").isNotNull(), F.struct("tid", raw.alias("w")))).alias("terms"))
    mine = q.join(asked, "term").groupBy(*by).agg(F.collect_list(F.struct("tid", F.col("weight").alias("w"))).alias("terms"))
    n = mine.count()
    mine = mine.select(q_key, "terms", F.lit(0).alias("bits"), F.lit(False).alias("_broad"), F.pmod(F.xxhash64(q_key), F.lit(max(1, -(-n // block)))).cast("int").alias("no"))
    blocks = kept(mine.groupBy("no").applyInArrow(lambda t: pa.table({"no": t.column("no").slice(0, 1), "asks": pa.array([_packed(t.sort_by(q_key))], pa.binary())}), "no int, asks binary"))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                yield pa.RecordBatch.from_arrays([pa.array([_packed(pa.Table.from_batches([batch.slice(at, block)]))], pa.binary())], ["chunks"])

    def best(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for no, asks, blob in zip(batch.column("no").to_pylist(), batch.column("asks"), batch.column("chunks"), strict=True):
                if no not in held:
                    if len(held) == 4:
                        held.pop(next(iter(held)))
                    found = _Asks(asks.as_py())
                    ids = found.table.column(q_key).to_numpy()
                    held[no] = found, np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                found, first = held[no]
                part = _unpacked(blob.as_py())
                row, tid, value = _flat(part.column("terms"))
                sims = found.products(part.num_rows, row, tid, value) / part.column("norm").to_numpy()[:, None]
                sims = np.maximum.reduceat(sims, first, axis=1)
                i, j = np.nonzero(sims > 0)
                yield from pa.table([found.table.column(q_key).take(_indices(first[j])), part.column(d_key).take(_indices(i)), pa.array(sims[i, j])], names=[q_key, d_key, "sim"]).combine_chunks().to_batches()

    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    pairs = held.mapInArrow(pack, "chunks binary").crossJoin(F.broadcast(blocks) if n * 4096 <= BROADCAST_BYTES else blocks)
    return pairs.mapInArrow(best, f"{kind(questions, q_key)}, {kind(documents, d_key)}, sim double")


def _told_of(chunks: DataFrame, blocks: int, asked: DataFrame, space: str, terms) -> DataFrame:
    """told of one space, rows of one KEY taken together; to be kept."""
    return B.told_blocks(_block_rows(chunks, blocks, *map(F.col, KEY)), asked, {space: terms.in_blocks}, max(8, blocks), {space: SPACE[space]}, key=KEY)


def cosines(questions: DataFrame, chunks: DataFrame, space: str, terms, by: Sequence[str] = ("qid",), block: int = 1024) -> DataFrame:
    """(by, KEY, sim): similarities of every question (by, q_aug) with every chunk in one space, where they share a term; rows of one key are one text.

    What I.search_space has, as products of blocks that weigh their own terms: no posting and no pair is shuffled.
    """
    import pyarrow as pa

    from corpusloom.sources.index_store import kept

    n_chunks, blocks = blocks_of(chunks)
    make = {space: terms.in_blocks}
    held = kept(B.term_rows(questions, by, make, "q_aug"))
    asked = kept(asked_keys(held))
    told = kept(_told_of(chunks, blocks, asked, space, terms))
    found = asked.join(B.asked_frequencies(told, 1), "tid").select("term", "tid", I.idf(F.lit(n_chunks), F.col("df")).alias("idf"))
    raw = held.join(found, "term").select(*by, "tid", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by)))
    mine = raw.select(*by, "tid", (F.col("w") / norm * F.col("idf")).alias("w")).groupBy(*by).agg(F.collect_list(F.struct("tid", "w")).alias("terms"))
    n = mine.count()
    mine = mine.select(*by, "terms", F.lit(0).alias("bits"), F.lit(False).alias("_broad"), F.pmod(F.xxhash64(*by), F.lit(max(1, -(-n // block)))).cast("int").alias("no"))
    asks = kept(mine.groupBy("no").applyInArrow(lambda t: pa.table({"no": t.column("no").slice(0, 1), "asks": pa.array([_packed(t)], pa.binary())}), "no int, asks binary"))
    rows = _block_rows(chunks, blocks, *map(F.col, KEY))
    sent = told.where("_block >= 0").repartition(block_tasks(blocks), "_block")
    held_blocks = rows.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(_told_weights(n_chunks, blocks, make, KEY, block, KEY), "chunks binary")

    def pairs(batches):
        known: dict[int, _Asks] = {}
        for batch in batches:
            for no, blob, chunk in zip(batch.column("no").to_pylist(), batch.column("asks"), batch.column("chunks"), strict=True):
                if no not in known:
                    if len(known) == 4:
                        known.pop(next(iter(known)))
                    known[no] = _Asks(blob.as_py())
                whole = _unpacked(chunk.as_py())
                for at in range(0, whole.num_rows, 512):
                    part = whole.slice(at, 512)
                    length = part.column(space).to_numpy()
                    sims = known[no].products(part.num_rows, *_flat(part.column(f"terms_{SPACE[space]}"))) / np.where(length > 0, length, 1.0)[:, None]
                    i, j = np.nonzero(sims > 0)
                    columns = [known[no].table.column(c).take(_indices(j)) for c in by] + [part.column(c).take(_indices(i)) for c in KEY]
                    yield from pa.table([*columns, pa.array(sims[i, j])], names=[*by, *KEY, "sim"]).combine_chunks().to_batches()

    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([*[kind(questions, c) for c in by], *[kind(chunks, c) for c in KEY], "sim double"])
    return held_blocks.crossJoin(F.broadcast(asks) if n * 4096 <= BROADCAST_BYTES else asks).mapInArrow(pairs, schema)


def block_postings(chunks: DataFrame, space: str, terms) -> DataFrame:
    """(KEY, term, weight): the postings of one space, weighed in the blocks that hold them, as I.weights has them; rows of one key are one text."""
    import pyarrow as pa

    from corpusloom.sources.index_store import kept

    n, blocks = blocks_of(chunks)
    none = chunks.sparkSession.createDataFrame([], "space string, term long, tid long")
    told = kept(_told_of(chunks, blocks, none, space, terms))

    def weigh(part, told):
        part = part.combine_chunks()
        keys = B.rows_of_keys(part, KEY)
        table = part.select(KEY) if keys is None else part.select(KEY).take(pa.array(keys[1]))
        found = B.merged(terms.in_blocks(B.Words(part.column("_low").combine_chunks())), keys)
        every = list(found.slices())
        idf = np.log((1 + n) / (1 + _told_frequencies(found, every, blocks, told, 0, 1)[0])) + 1
        row, no, tf = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *every, strict=True))
        raw = tf * idf[no]
        weight = raw / np.sqrt(np.bincount(row, weights=raw * raw, minlength=table.num_rows))[row]
        names = found.spell(np.arange(len(found.keys))).cast(pa.string())
        return pa.table([*[table.column(k).take(_indices(row)) for k in KEY], names.take(_indices(no)), pa.array(weight)], names=[*KEY, "term", "weight"])

    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in KEY)
    sent = told.where("_block >= 0").repartition(block_tasks(blocks), "_block")
    return _block_rows(chunks, blocks, *map(F.col, KEY)).groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(weigh, f"{kinds}, term string, weight double")


def block_vocabulary(chunks: DataFrame, terms) -> DataFrame:
    """(term, df, idf) of one space, counted by blocks; rows of one key are one text."""
    n, blocks = blocks_of(chunks)
    df = B.block_frequencies(_block_rows(chunks, blocks, *map(F.col, KEY)), KEY, terms.in_blocks)
    return df.select("term", "df", I.idf(F.lit(n), F.col("df")).alias("idf"))


def _indices(at: np.ndarray):
    import pyarrow as pa

    return pa.array(at.astype(np.int64))


#: Blocks of questions, at about 4 KB a question, are broadcast up to this size.
BROADCAST_BYTES = 64 << 20


#: Terms of a slab in the product of two blocks; a term with fewer pairs of a place and a question than one in RARELY of all is summed place by place instead.
SLAB = 2048
RARELY = 128


class _Asks:
    """A block of questions as postings: the questions and weights of each term."""

    def __init__(self, blob: bytes):
        import pyarrow as pa

        self.table = pa.ipc.open_stream(blob).read_all().combine_chunks()
        n = self.table.num_rows
        row, tid, weight = _flat(self.table.column("terms"))
        order = np.argsort(tid, kind="stable")
        self.n, self.ask, self.weight = n, row[order], weight[order]
        self.ids, first = np.unique(tid[order], return_index=True)
        self.ends = np.r_[first, len(tid)]
        self.place = np.full(self.ids[-1] + 2, -1, np.int32) if len(self.ids) and self.ids[-1] < 1 << 24 else None  # of each number, where they are dense
        if self.place is not None:
            self.place[self.ids] = np.arange(len(self.ids))
        bits = self.table.column("bits").to_numpy()
        self.bits = np.array([bits >> i & 1 for i in range(32)], float)
        self.broad = np.array([bool(x) for x in self.table.column("_broad").to_pylist()], bool)

    def products(self, rows: int, row: np.ndarray, tid: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Dot products of the chunks' and the questions' vectors over the given terms."""
        if self.place is not None:
            at = self.place[np.minimum(tid, len(self.place) - 1)].astype(np.int64)
            hit = np.flatnonzero(at >= 0)
        else:
            at = np.searchsorted(self.ids, tid)
            hit = np.flatnonzero(at < len(self.ids))
            hit = hit[self.ids[at[hit]] == tid[hit]]
        row, at, value = row[hit], at[hit], value[hit]
        sizes = np.diff(self.ends)
        rare = (np.bincount(at, minlength=len(sizes)) * sizes * RARELY < rows * self.n)[at]
        many = sizes[at[rare]]
        place = np.repeat(self.ends[at[rare]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        sums = np.bincount(np.repeat(row[rare], many) * self.n + self.ask[place], weights=np.repeat(value[rare], many) * self.weight[place], minlength=rows * self.n)
        out = sums.astype(float).reshape(rows, self.n)  # empty sums come as whole numbers
        # The others by slabs of terms, so that neither side is dense as a whole.
        row, at, value = row[~rare], at[~rare], value[~rare]
        often = np.flatnonzero(np.bincount(at, minlength=1))
        for low in range(0, len(often), SLAB):
            slab = often[low : low + SLAB]
            no = np.searchsorted(slab, at)
            mine = np.flatnonzero(no < len(slab))
            mine = mine[slab[no[mine]] == at[mine]]
            asked = np.zeros((len(slab), self.n))
            many = sizes[slab]
            place = np.repeat(self.ends[slab] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            asked[np.repeat(np.arange(len(slab)), many), self.ask[place]] = self.weight[place]
            held = np.zeros((rows, len(slab)))
            held[row[mine], no[mine]] = value[mine]
            out += held @ asked
        return out


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tid, weight) of a column of lists of (tid, w)."""
    import pyarrow.compute as pc

    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    tid, weight = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
    return np.repeat(np.arange(len(sizes)), sizes), tid.astype(np.int64), weight.astype(float)


def _scorer(named: Sequence[str], least: float, w: C.Weights, best: tuple[int, Sequence[tuple]] | None = None):
    """Arrow function: the pairs of two blocks whose base score reaches `least`, less those that can't be among the best."""
    import pyarrow as pa

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for no, asks, blob in zip(batch.column("no").to_pylist(), batch.column("asks"), batch.column("chunks"), strict=True):
                if no not in held:
                    if len(held) == 4:
                        held.pop(next(iter(held)))
                    q = _Asks(asks.as_py())
                    held[no] = q, best and _Best(q, *best)
                whole = pa.ipc.open_stream(blob.as_py()).read_all().combine_chunks()
                for at in range(0, whole.num_rows, 512):
                    yield from _product(*held[no], whole.slice(at, 512), named, least, w)

    return run


class _Best:
    """The best final scores that a task has seen of each question of a block, for each rule."""

    def __init__(self, q: _Asks, k: int, rules: Sequence[tuple]):
        self.k, self.rules = k, rules
        self.top = [np.full((q.n, k), -np.inf) for _ in rules]
        self.scopes = [set(x) for x in q.table.column("_scope").to_pylist()]
        files = q.table.column("_files").to_pylist()
        self.anywhere = np.array([x is None for x in files], bool)
        self.of_file: dict[str, list[int]] = {}
        for i, names in enumerate(files):
            for name in set(names or ()):
                self.of_file.setdefault(name, []).append(i)

    def among(self, part, base: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Which pairs may be among the best, of these and of those seen before."""
        coded = part.column("authority").combine_chunks().dictionary_encode(null_encoding="encode")
        admits = np.array([[a in s for s in self.scopes] for a in coded.dictionary.to_pylist()], bool).reshape(-1, base.shape[1])
        admitted = admits[coded.indices.to_numpy(zero_copy_only=False)]
        allowed = np.repeat(self.anywhere[None], len(base), axis=0)
        for i, name in enumerate(part.column("file").to_pylist()):
            if name in self.of_file:
                allowed[i, self.of_file[name]] = True
        out = np.zeros(base.shape, bool)
        for top, (scoped, filed, least) in zip(self.top, self.rules, strict=True):
            may = (base >= least) & (final >= top[:, 0] - 1e-11)  # scores are ranked by twelve digits
            if scoped:
                may &= admitted
            if filed:
                may &= allowed
            j, i = np.nonzero(may.T)
            if not len(i):
                continue
            value = final[i, j]
            order = np.lexsort((-value, j))
            j, value = j[order], value[order]
            nth = np.arange(len(j)) - np.searchsorted(j, j)
            new = np.full(top.shape, -np.inf)
            few = nth < self.k
            new[j[few], nth[few]] = value[few]
            top[:] = np.sort(np.concatenate([top, new], axis=1), axis=1)[:, self.k :]
            out |= may & (final >= top[:, 0] - 1e-11)
        return out


def _product(q: _Asks, best: _Best | None, part, named: Sequence[str], least: float, w: C.Weights):
    import pyarrow as pa

    n = part.num_rows
    if "terms" in part.column_names:
        row, tid, value = _flat(part.column("terms"))
        each = [(row[use], tid[use], value[use]) for use in (tid % 4 == kind for kind in range(3))]
    else:
        each = [_flat(part.column(f"terms_{kind}")) for kind in range(3)]
    sims = []
    for kind, name in enumerate(("word", "char")):
        length = np.array([x or 1.0 for x in part.column(name).to_pylist()])
        sims.append(q.products(n, *each[kind]) / length[:, None])
    overlap = q.products(n, *each[2])
    parts = np.array(part.column("parts").to_pylist(), float)
    prior = parts[:, :-1] @ q.bits[: parts.shape[1] - 1] + parts[:, -1:]
    base = w.word * sims[0] + w.char * sims[1] + w.overlap * overlap + prior
    few = base >= least
    if best:
        held = np.where(q.broad, part.column("hits").to_numpy()[:, None], 0)
        few &= best.among(part, base, base + np.where(held > 0, np.minimum(w.max_boost, held * w.boost_per_hit), 0.0))
    i, j = np.nonzero(few)
    if not len(i):
        return
    hits = np.where(q.broad[j], part.column("hits").to_numpy()[i], 0).astype(np.int32)
    boost = np.where(hits > 0, np.minimum(w.max_boost, hits * w.boost_per_hit), 0.0)
    columns = [q.table.column(c).take(pa.array(j)) for c in named] + [part.column(c).take(pa.array(i)) for c in (*KEY, "authority")]
    numbers = [sims[0][i, j], sims[1][i, j], overlap[i, j], base[i, j], hits, boost, base[i, j] + boost]
    names = [*named, *KEY, "authority", "sim_word", "sim_char", "overlap", "base", "hits", "boost", "final"]
    yield from pa.table([*columns, *map(pa.array, numbers)], names=names).combine_chunks().to_batches()


def ranking(by: Sequence[str]):
    """Final score, then base score, then the key; scores count to twelve digits."""
    return Window.partitionBy(*by).orderBy(F.desc(F.round("final", 12)), F.desc(F.round("base", 12)), *KEY)


def promising(scored: DataFrame, by: Sequence[str], top_k: int, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with `_rules`: the names of the rules that admit them and among whose rows of a group they may be in the best top_k by final score; others go.

    A group's scores are counted by hundredths, and rows below the one that holds the last of the best can't be ranked, so few rows are left to sort. Reads the rows twice.
    """
    from corpusloom.sources.index_store import kept

    step = F.floor(F.round("final", 12) * 100)
    per = scored.groupBy(*by, step.alias("_step")).agg(*[F.count_if(rule).alias(f"_n_{name}") for name, rule in rules.items()])
    down = Window.partitionBy(*by).orderBy(F.desc("_step"))
    upto = per.select(*by, "_step", *[F.sum(f"_n_{name}").over(down).alias(f"_n_{name}") for name in rules])
    least = kept(upto.groupBy(*by).agg(*[F.max(F.when(F.col(f"_n_{name}") >= top_k, F.col("_step"))).alias(f"_least_{name}") for name in rules]))
    x = scored.join(I.sized(least, least.count()), [*by], "left")
    near = [F.when(rule & F.coalesce(step >= F.col(f"_least_{name}"), F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return x.select(*scored.columns, F.array_compact(F.array(*near)).alias("_rules")).where(F.size("_rules") > 0)


def rank(scored: DataFrame, by: Sequence[str], top_k: int, least: float | None = None) -> DataFrame:
    """The best top_k rows per question with `rank`; eligibility is by base, before any boost."""
    x = promising(scored if least is None else scored.where(F.col("base") >= least), by, top_k, {"all": F.lit(True)}).drop("_rules")
    return x.withColumn("rank", F.row_number().over(ranking(by))).where(F.col("rank") <= top_k)


def mmr(ranked: DataFrame, postings: DataFrame, by: Sequence[str], items: int, lam: float = 0.60) -> DataFrame:
    """(by, KEY, mmr_pos): greedy choice of items by lam * final - (1 - lam) * largest cosine to those chosen.

    ranked holds at most top_k rows per question with rank (from 1, without gaps) and final; postings (KEY, term, weight) is the word space. A
    search's few rows are one array, and the choice is a fold over it; ties go to the smaller rank.
    """
    few = ranked.select(*by, *KEY, "rank", "final")
    terms = few.join(postings, KEY).select(*by, "rank", "term", "weight")
    other = terms.select(*by, F.col("rank").alias("other"), "term", F.col("weight").alias("w2"))
    pairs = terms.join(other, [*by, "term"]).where("rank < other").groupBy(*by, "rank", "other").agg(F.sum(F.col("weight") * F.col("w2")).alias("sim"))
    both = pairs.unionByName(pairs.select(*by, F.col("other").alias("rank"), F.col("rank").alias("other"), "sim"))
    near = both.groupBy(*by, "rank").agg(F.collect_list(F.struct("other", "sim")).alias("near"))
    rows = few.join(near, [*by, "rank"], "left")
    found = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "final", "near", F.struct(*KEY).alias("key")))).alias("found"))

    def pick(chosen: Column) -> Column:
        def gain(r: Column) -> Column:
            sims = F.transform(F.filter(r["near"], lambda x: F.array_contains(chosen, x["other"])), lambda x: x["sim"])
            far = lam * r["final"] - (1 - lam) * F.coalesce(F.array_max(sims), F.lit(0.0))
            return F.round(F.when(F.size(chosen) == 0, r["final"]).otherwise(far), 12)

        left = F.filter("found", lambda r: ~F.array_contains(chosen, r["rank"]))
        return -F.array_max(F.transform(left, lambda r: F.struct(gain(r).alias("gain"), (-r["rank"]).alias("at"))))["at"]

    steps = F.sequence(F.lit(1), F.least(F.lit(items), F.size("found")))
    chosen = F.aggregate(steps, F.array().cast("array<int>"), lambda acc, _: F.concat(acc, F.array(pick(acc))))
    out = found.select(*by, "found", F.posexplode(chosen).alias("at", "rank")).select(*by, F.element_at("found", F.col("rank"))["key"].alias("key"), (F.col("at") + 1).alias("mmr_pos"))
    return out.select(*by, "key.*", "mmr_pos")


def empty_totals(questions: DataFrame, per: DataFrame, routed: DataFrame, restricted: DataFrame, eligible: DataFrame, admitted: Column) -> DataFrame:
    """Counts per question of what scope, documents and similarity removed of all chunks.

    per (authority, n) counts chunks, routed (qid, n_allowed) the admitted ones of allowed documents, restricted (qid) names the questions
    that have such documents (others allow all), eligible (qid, eligible) what reached the threshold.
    """
    n = F.col("n")
    x = per.crossJoin(F.broadcast(questions)).groupBy("qid").agg(F.sum("n").alias("total"), F.sum(F.when(~admitted, n).otherwise(0)).alias("scope_removed"))
    x = x.join(routed, "qid", "left").join(restricted.withColumn("_r", F.lit(True)), "qid", "left").join(eligible, "qid", "left")
    left = F.col("total") - F.col("scope_removed")
    kept = F.when(F.col("_r"), F.coalesce("n_allowed", F.lit(0))).otherwise(left)
    found = F.coalesce("eligible", F.lit(0).cast("long"))
    return x.select("qid", "total", "scope_removed", (left - kept).alias("docs_removed"), (kept - found).alias("similarity_removed"), found.alias("eligible"))


def merge_variants(found: DataFrame, cap: int = 80, by: Sequence[str] = ("qid",)) -> DataFrame:
    """Best row per question and chunk over all variants, the first variant on ties; at most `cap` rows per question."""
    best = Window.partitionBy(*by, *KEY).orderBy(F.desc(F.round("final", 12)), "variant_no")
    x = found.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    return x.withColumn("pool_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("final", 12)), *KEY))).where(F.col("pool_rank") <= cap)


def pools(found: DataFrame, rules: Mapping[str, Column], postings: Callable[[DataFrame], DataFrame], by: Sequence[str], w: C.Weights = C.DEFAULT) -> DataFrame:
    """What every search selects of its best rows, merged over a question's forms, for several rules at once: the rows with `pool`, a rule's name.

    found (by, KEY, base, final ...) holds a row once however many rules admit it; `by` ends in the form's number. postings gives the word space's
    (KEY, term, weight) of the rows' chunks; it is asked for those of the ranked rows alone.
    """
    from corpusloom.sources.index_store import kept

    each = promising(found, by, w.pipeline_top_k, rules).withColumn("pool", F.explode("_rules")).drop("_rules")
    ranked = kept(each.withColumn("rank", F.row_number().over(ranking(["pool", *by]))).where(F.col("rank") <= w.pipeline_top_k))
    chosen = mmr(ranked, postings(ranked), ["pool", *by], w.max_context, w.mmr_lambda)
    return merge_variants(ranked.join(chosen, ["pool", *by, *KEY]), w.pool, ["pool", *by[:-1]])


def thin(pool: DataFrame, domains: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """(qid) of the questions of such a domain with fewer than `least` rows."""
    sizes = pool.groupBy("qid").agg(F.count("*").alias("_n"))
    return domains.join(sizes, "qid", "left").where((F.coalesce("_n", F.lit(0)) < least) & F.col("domain").isin(*keys)).select("qid")


def relaxed_retry(restricted: DataFrame, unrestricted: DataFrame, domains: DataFrame, keys: Sequence[str] = ("computerized_systems", "data_integrity"), least: int = 3, cap: int = 80) -> DataFrame:
    """Pools of restricted search; where a question of such a domain has fewer than `least` rows, unrestricted ones join in."""
    thin_ones = thin(restricted, domains, keys, least)
    extra = unrestricted.join(thin_ones, "qid", "left_semi").withColumn("variant_no", F.col("variant_no") + 1000)
    return merge_variants(restricted.drop("pool_rank").unionByName(extra.drop("pool_rank"), allowMissingColumns=True), cap)


def _levels(pool: DataFrame, lexicon: Mapping[str, C.Lexicon], relaxed: Sequence[str], least: int) -> DataFrame:
    """pool (qid, domain, text ...) with _a and _b, whether the strict and the relaxed rule keep a row, and the `level` in force."""
    strict = loose = F.lit(False)
    for name, lex in lexicon.items():
        strong, secondary, negative = Q.lexicon_flags(F.col("text"), lex)
        mine = (F.col("domain") == name) & (negative == 0) & (T.collapsed(F.col("text")) != "")
        strict = strict | (mine & ((strong >= 1) | (secondary >= 2)))
        loose = loose | (mine & ((strong >= 1) | (secondary >= 1)) & F.lit(name in relaxed))
    x = pool.withColumn("_a", F.coalesce(strict, F.lit(False))).withColumn("_b", F.coalesce(strict | loose, F.lit(False)))
    w = Window.partitionBy("qid")
    level = F.when(F.sum(F.col("_a").cast("int")).over(w) >= least, 1).when(F.sum(F.col("_b").cast("int")).over(w) >= least, 2).otherwise(0)
    return x.withColumn("level", level)


def domain_filter(pool: DataFrame, lexicon: Mapping[str, C.Lexicon] = C.LEXICONS, relaxed: Sequence[str] = C.RELAXED_DOMAINS, least: int = 2) -> DataFrame:
    """pool (qid, domain, text ...) with `level`: 1 strict rows where enough survive, else 2 relaxed ones, else 0 for all rows."""
    x = _levels(pool, lexicon, relaxed, least)
    return x.where((F.col("level") == 0) | ((F.col("level") == 1) & F.col("_a")) | ((F.col("level") == 2) & F.col("_b"))).drop("_a", "_b")


def filter_counts(pool: DataFrame, lexicon: Mapping[str, C.Lexicon] = C.LEXICONS, relaxed: Sequence[str] = C.RELAXED_DOMAINS, least: int = 2) -> DataFrame:
    """(qid, level, chunks_before, after_level1, after_level2): what domain_filter does to each question's pool."""
    x = _levels(pool, lexicon, relaxed, least)
    return x.groupBy("qid").agg(F.max("level").alias("level"), F.count("*").alias("chunks_before"), F.count_if("_a").alias("after_level1"), F.count_if("_b").alias("after_level2"))


def scope_retry(first: DataFrame, second: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of `first`; questions without any get those of `second` (the mixed scope), marked `retried`."""
    empty = questions.select("qid").join(first.select("qid").distinct(), "qid", "left_anti")
    return first.withColumn("retried", F.lit(False)).unionByName(second.join(empty, "qid", "left_semi").withColumn("retried", F.lit(True)))


def fallback_match(question: Column, file: Column) -> Column:
    """Whether a question's longer words or document hints occur in a file's name."""
    name = F.regexp_replace(F.lower(file), "[^a-z0-9]+", "")
    words = F.filter(T.tokens(question), lambda t: F.length(t) >= 4)
    return F.exists(F.concat(words, Q.doc_hints(question)), lambda k: name.contains(k))


def slots(pool: DataFrame, w: C.Weights = C.DEFAULT) -> DataFrame:
    """(qid, authority, slots, eligible): rows that an authority may seat, and whether its leader reaches the floor."""
    order = [F.desc(F.round("final", 12)), *KEY]
    mine, every = Window.partitionBy("qid", "authority").orderBy(*order), Window.partitionBy("qid").orderBy(*order)
    bar = F.round(F.greatest(F.lit(w.min_similarity), F.first("base").over(every) - w.floor_delta), 12)
    x = pool.withColumn("_slot", F.row_number().over(mine)).withColumn("_lead", F.round(F.first("base").over(mine), 12)).withColumn("_bar", bar)
    return x.groupBy("qid", "authority").agg(F.count_if(F.col("_slot") <= w.per_authority).alias("slots"), F.first(F.col("_lead") >= F.col("_bar")).alias("eligible"))


def balance(pool: DataFrame, target: int = 8, w: C.Weights = C.DEFAULT) -> DataFrame:
    """Rows of pool (qid, KEY, authority, base, final, hits) kept: up to per_authority rows of each authority whose leader
    reaches the floor, slot by slot; then refilled to `target`, with near-equal base scores ordered by requirement hits.

    The refill order isn't transitive, so a comparator can't sort by it (Java's sort may refuse to). A row's place in it is the number of rows of its question
    that go before it, the sorted order wherever one exists; ties by score and key. A question's pool, an array here, has a cap.
    """
    mine = F.struct(*KEY, "authority", F.round("base", 12).alias("base"), F.round("final", 12).alias("final"), "hits")
    every = pool.groupBy("qid").agg(F.collect_list(mine).alias("rows"))
    behind = lambda r: F.struct(-r["final"], -r["base"], *[r[k] for k in KEY])

    def before(s: Column, r: Column) -> Column:
        near = (F.round(F.abs(s["base"] - r["base"]), 12) <= w.refill_gap) & (s["hits"] != r["hits"])
        return F.when(near, s["hits"] > r["hits"]).otherwise(behind(s) < behind(r))

    placed = F.transform("rows", lambda r: F.struct(r.alias("row"), F.size(F.filter("rows", lambda s: before(s, r))).alias("place")))
    x = every.select("qid", F.inline(placed)).select("qid", "row.*", "place")
    order = [F.desc("final"), *KEY]
    of_question, of_authority = Window.partitionBy("qid"), Window.partitionBy("qid", "authority").orderBy(*order)
    x = x.withColumn("_slot", F.row_number().over(of_authority)).withColumn("_lead", F.first("base").over(of_authority))
    x = x.withColumn("_nth", F.row_number().over(of_question.orderBy(*order)))
    bar = F.round(F.greatest(F.lit(w.min_similarity), F.first("base").over(of_question.orderBy(*order)) - w.floor_delta), 12)
    x = x.withColumn("_able", F.round("_lead", 12) >= bar)
    x = x.withColumn("_ables", F.size(F.collect_set(F.when(F.col("_able"), F.col("authority"))).over(of_question)))
    seat = F.when(F.col("_able") & (F.col("_slot") <= w.per_authority), F.col("_slot"))
    turn = F.row_number().over(of_question.orderBy(F.asc_nulls_last(seat), F.desc("_lead"), "authority"))
    x = x.withColumn("_seated", (seat.isNotNull() & (turn <= target)).cast("int"))
    got = F.row_number().over(of_question.orderBy(F.desc("_seated"), "place", *order))
    x = x.withColumn("_got", F.when(F.col("_ables") < 2, F.col("_nth")).otherwise(got)).where(F.col("_got") <= target)
    return x.select(*[F.col(f.name).cast(f.dataType) for f in pool.schema])
