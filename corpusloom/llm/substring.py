"""Substring dedup: documents are streamed through suffix automata of reference shards.

A word is removed when a window of 13 words that covers it also starts in a document with a smaller doc_id. A corpus
has no bounded reference, and streaming every document through every shard of it would cost the square of the corpus;
so shards are made of what can match, and a document visits only these:

1. Every window has an anchor, the five words inside it of the smallest hash; equal windows have equal anchors. Rows
   (anchor, document) meet by anchor, and anchors within one document alone are dropped.
2. Documents cut out the context of each shared anchor: the words of the windows anchored there. A context that its task has
   sent from a smaller document is decided.
3. A shard holds the contexts of its anchors. In order of doc_id, each context is streamed through the automaton of all
   contexts of smaller documents (its matching statistics), then appended to it. Where the match reaches 13 words, the
   window's words go. All copies of a window meet in the shard of its anchor, so no match is lost.

Hot passages: five-word runs that a bounded sample of documents shows to be common take the last rank, so that a window
is anchored at them only if all of it is common; of such windows, a task sends on the first document's, the others being
decided there and then (the first one is smaller). The sample changes the work, never the result.

Defined cases: null and empty texts have no words; texts below 13 words are kept; rows of a null doc_id are kept whole and
remove nothing; rows of one doc_id don't remove from each other; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh
from corpusloom.llm.words import as_bytes, common_runs, hash_words, member, mix, rolling, slices

WINDOW = 13
ANCHOR = 5
SIDE = WINDOW - ANCHOR
_LAST = np.uint64(1 << 63)
#: Contexts that a task remembers to have sent; copies of these are decided on the spot.
MEMO = 200_000
#: Longest run that one row states.
MOST = 1 << 20


class SuffixAutomaton:
    """Online suffix automaton over word sequences; appending another sequence starts again at the root."""

    __slots__ = ("link", "longest", "next")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.longest = [-1], [0]

    def _clone(self, p: int, q: int, w) -> int:
        nxt, link, longest = self.next, self.link, self.longest
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def append(self, words) -> None:
        nxt, link, longest = self.next, self.link, self.longest
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if longest[q] == longest[p] + 1 else self._clone(p, q, w)
            last = cur

    def statistics(self, words) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        nxt, link, longest = self.next, self.link, self.longest
        state = size = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = longest[state]
            to = nxt[state].get(w)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def merged(spans) -> list[list[int]]:
    """(start, end) spans joined where they touch or overlap, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def matched_spans(statistics: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal (start, end) spans covered by matches of at least `least` words."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(statistics, 1):
        if size >= least:
            if spans and spans[-1][1] >= end - least:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - least, end))
    return spans


def _spread(ids: np.ndarray) -> np.ndarray:
    """Partition keys of rows that are decided: by document, evenly."""
    return mix(ids.view(np.uint64)).view(np.int64)


def pack(pos, n, k):
    """A position (28 bits), an extent (-MOST to MOST) and a row's k (15 bits) in one long; positions order the values."""
    return (pos << 36) + ((n + MOST) << 15) + k


def unpack(at: int) -> tuple[int, int, int]:
    return at >> 36, (at >> 15 & 0x1FFFFF) - MOST, at & 0x7FFF


def _pieces(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, start, size) of runs cut into pieces of at most MOST."""
    many = -(-size // MOST)
    of = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return of, start[of] + nth * MOST, np.minimum(MOST, size[of] - nth * MOST)


def _anchors(keyed: DataFrame, common: np.ndarray) -> DataFrame:
    """(h, doc_id, at): `at` packs a position, an extent and k. Anchors: the first of the windows anchored there, and their
    number, negative; else windows that are decided already. h takes 48 bits: a collision only adds a candidate."""

    def run(batches):
        for part in slices(batches):
            part = part.filter(pa.compute.is_valid(part.column("doc_id"))).sort_by("doc_id")
            ids, keys = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "k"))
            h, doc = hash_words(as_bytes(part.column("text")))
            m = len(h) - WINDOW + 1
            if m <= 0:
                continue
            g = rolling(h, ANCHOR)
            rank = mix(g) >> np.uint64(1)
            rank = np.where(member(common, g), rank | _LAST, rank)
            best, off = rank[:m].copy(), np.zeros(m, np.int64)
            for j in range(1, SIDE + 1):
                less = rank[j : j + m] < best
                best[less] = rank[j : j + m][less]
                off[less] = j
            inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
            if not len(inside):
                continue
            undecided = inside
            hot = inside[best[inside] >= _LAST]
            if len(hot):
                _, first, of = np.unique(rolling(h, WINDOW)[hot], return_index=True, return_inverse=True)
                later = ids[doc[hot]] > ids[doc[hot[first]]][of]
                done = hot[later]
                undecided = np.setdiff1d(inside, done, assume_unique=True)
                if len(done):
                    cut = np.r_[True, (np.diff(done) != 1) | (np.diff(doc[done]) != 0)]
                    start, size = done[cut], np.diff(np.r_[np.flatnonzero(cut), len(done)])
                    d = doc[start]
                    of, at, part_size = _pieces(start - np.searchsorted(doc, d), size)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (_spread(ids[d])[of], ids[d][of], pack(at, part_size, keys[d][of]))], ["h", "doc_id", "at"])
            spot, first, many = np.unique(undecided + off[undecided], return_index=True, return_counts=True)
            start, last = undecided[first], undecided[first + many - 1]  # anchors move forward with the windows
            d = doc[spot]
            base = np.searchsorted(doc, d)
            rows = ((g[spot] >> np.uint64(16)).view(np.int64), ids[d], pack(start - base, start - last - 1, keys[d]))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], ["h", "doc_id", "at"])

    return keyed.select("doc_id", "k", "text").mapInArrow(run, "h long, doc_id long, at long")


def _shared(anchors: DataFrame) -> DataFrame:
    """Anchors that occur in at least two documents, and all that is decided."""
    same = Window.partitionBy("h")
    decided = F.shiftright("at", 15).bitwiseAND(F.lit(0x1FFFFF)) > MOST
    # The window's argument would be made before its exchange and travel along; dealt first, it is made after it.
    marked = anchors.repartition("h").withColumn("d", F.when(~decided, F.col("doc_id")))
    marked = marked.select("*", F.min("d").over(same).alias("lo"), F.max("d").over(same).alias("hi"))
    return marked.where(decided | (F.col("lo") < F.col("hi"))).drop("d", "lo", "hi")


def _contexts(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """(h, doc_id, at, words): the windows of each shared anchor as words from `at` on; words decided here have none."""
    spots_of = fresh(keyed, "spots")
    per_doc = shared.withColumn("k", F.col("at").bitwiseAND(F.lit(0x7FFF))).groupBy("doc_id", "k").agg(F.collect_list(F.struct("h", "at")).alias(spots_of))
    # All columns of `keyed` go along, so that this exchange of the texts is the one that takes the spans later.
    joined = keyed.join(per_doc, ["doc_id", "k"], "left")

    def run(batches):
        sent: dict[bytes, int] = {}  # contexts that this task has sent, and their smallest doc_id; bounded
        for part in slices(batches):
            out: list[list] = [[], [], [], []]
            ids = part.column("doc_id").to_pylist()
            by_doc = _spread(np.array([0 if i is None else i for i in ids], np.int64)).tolist()
            for doc_id, own, k, text, spots in zip(ids, by_doc, part.column("k").to_pylist(), as_bytes(part.column("text")), part.column(spots_of).to_pylist(), strict=True):
                words = text.split() if spots else ()
                decided = []
                for s in spots or ():
                    start, n, _ = unpack(s["at"])
                    end = start + abs(n) + WINDOW - 1
                    if n < 0:
                        ctx = b" ".join(words[start:end])
                        first = sent.get(ctx)
                        if first is None or first >= doc_id:
                            if first is not None or len(sent) < MEMO:
                                sent[ctx] = doc_id
                            for column, v in zip(out, (s["h"], doc_id, pack(start, 0, k), ctx), strict=True):
                                column.append(v)
                            continue
                    decided.append((start, end))
                for start, end in merged(decided):
                    for piece in range(start, end, MOST):
                        for column, v in zip(out, (own, doc_id, pack(piece, min(MOST, end - piece), k), b""), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["h", "doc_id", "at", "words"])

    return joined.mapInArrow(run, "h long, doc_id long, at long, words binary")


def _spans(contexts: DataFrame) -> DataFrame:
    """(doc_id, k, start, size): word spans to remove."""
    shards = contexts.repartition("h").sortWithinPartitions("h", "doc_id", "at")

    def run(batches):
        shard = doc = None
        automaton, built, refs, known, waiting = None, 0, [], set(), []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("h", "doc_id", "at", "words"))
            for h, doc_id, at, ctx in zip(*columns, strict=True):
                start, n, k = unpack(at)
                if not ctx:
                    spans = [(0, n)]
                else:
                    if h != shard:
                        shard, doc, automaton, built, refs, known, waiting = h, doc_id, SuffixAutomaton(), 0, [], set(), []
                    elif doc_id != doc:
                        refs += waiting
                        known.update(waiting)
                        doc, waiting = doc_id, []
                    if ctx in known:  # the automaton holds all of it
                        spans = [(0, ctx.count(b" ") + 1)]
                    else:
                        spans = []
                        if refs:
                            for r in refs[built:]:
                                automaton.append(r.split(b" "))
                            built = len(refs)
                            spans = matched_spans(automaton.statistics(ctx.split(b" ")), WINDOW)
                        waiting.append(ctx)
                for a, b in spans:
                    for column, v in zip(out, (doc_id, k, start + a, b - a), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "k", "start", "size"])

    return shards.mapInArrow(run, "doc_id long, k long, start long, size long")


def find_repeats(docs: DataFrame) -> DataFrame:
    """docs with `k` (15 bits of the text's hash, which tell rows of one doc_id apart) and `spans`: the repeated (start, size) in words, null where there are none."""
    more = [c for c in docs.columns if c not in ("doc_id", "text", "k", "spans")]
    whole = docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(1 << 15)).alias("k"), "text", *more)
    anchors = _anchors(whole, common_runs(docs.select("doc_id", "text"), ANCHOR))
    spans = _spans(_contexts(whole, _shared(anchors)))
    per_doc = spans.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    return whole.join(per_doc, ["doc_id", "k"], "left").select("doc_id", "k", "text", *more, "spans")


def _kept(text: bytes, spans: list | None) -> tuple[list[bytes], list[dict], int]:
    """(kept words, merged spans, number of words) of one text."""
    words = text.split()
    gone = merged((s["start"], s["start"] + s["size"]) for s in spans or ())
    at, kept = 0, []
    for a, b in gone:
        kept += words[at:a]
        at = b
    return kept + words[at:] if gone else words, [{"start": a, "size": b - a} for a, b in gone], len(words)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (start, size in words) and kept_sha256, the digest of the
    kept words joined by one space."""

    def run(batches):
        for part in slices(batches):
            rows = []
            for text, found in zip(as_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                kept, spans, n = _kept(text, found)
                rows.append((n, n - len(kept), spans, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, spans, digest = zip(*rows, strict=True)
            span = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])

    return find_repeats(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,size:long>>, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text, lang, source, n_chars) with their repeats cut out: texts that lose words become the kept
    words joined by one space, others stay as they are; a document whose words all go is dropped."""
    found = find_repeats(docs)

    def run(batches):
        for part in slices(batches):
            texts, sizes, stay = [], [], []
            for text, found, n in zip(as_bytes(part.column("text")), part.column("spans").to_pylist(), part.column("n_chars").to_pylist(), strict=True):
                kept, spans, _ = _kept(text, found) if found else ([], [], 0)
                texts.append(b" ".join(kept).decode() if spans else text.decode())
                sizes.append(len(texts[-1]) if spans else n)
                stay.append(bool(kept) or not spans)
            out = [part.column("doc_id"), pa.array(texts, pa.string()), part.column("lang"), part.column("source"), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text", "lang", "source", "n_chars"]).filter(pa.array(stay))

    return found.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
