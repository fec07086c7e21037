"""BPE encoding by a bounded-lookahead streaming transducer, decoding by an incremental state machine.

A merge list has a sufficient lookahead: whether a merge happens at some place can only be changed by symbols further
right through a chain of ever stronger merges, each of which begins inside the one before and ends beyond it. The
longest such chain, found by one pass over the merges in rank order, bounds how many symbols past a token's end must
be seen before that token is stable. Most places need far less: where no merge of the list joins a token that ends with this symbol
to one that begins with the next, a single symbol of lookahead settles all that is buffered. The transducer reads a block at a time and emits at each such place; where none comes, it
buffers the list's lookahead plus a block, merges, emits the stable tokens and goes on behind the last of them, so its memory doesn't depend on the run's length.

Text is cut at white space first (no token crosses it), a block of text at a time; every piece goes through the transducer, and repeated short ones are
answered from a bounded memo in front of it. Ids leave in chunks that digests and decoder take as they come, so beside the text itself (and, of a run without white space, its
words) nothing grows with it. A buffer is merged from a heap, so time grows with n log n of what is buffered.

Defined cases: null text is an empty text with no tokens; added tokens in a text become their ids; a symbol that the
vocabulary lacks is dropped, as the library does where no unknown token is set; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame


#: Unicode White_Space, spelled out because Python's \s also takes the separators 0x1C-0x1F.
_SPACE = "\t-\r \x85\xa0  -     　"
_BLOCK = 256
_MEMO = 400_000
#: Characters of text that are cut into pieces at a time, and ids that a chunk is sent from on.
_TEXT = 1 << 13
_CHUNK = 4096
#: Stands for a symbol outside the vocabulary; no merge has it.
UNKNOWN = (1 << 20) - 1


def byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary, merge ranks and the sufficient lookahead of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank of a pair of ids; the id that each rank makes; symbols of each id.
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.length = {self.vocab[a + b]: len(self._symbols(a + b)) for a, b in pairs}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lower, self.nfc = "Lowercase" in kinds, "NFC" in kinds
        self.decoder = (spec.get("decoder") or {}).get("type")
        #: Pairs of symbols that some merge joins a token's end with the next one's beginning at.
        self.crossed = {self.vocab[self._symbols(a)[-1]] << 20 | self.vocab[self._symbols(b)[0]] for a, b in pairs}
        self.lookahead = self._lookahead(pairs)
        #: Symbols that stay in the transducer's buffer when it emits.
        self.held = _BLOCK + self.lookahead

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1:] + self.suffix)
        return tuple(token)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Longest reach, in symbols, of a chain of stronger merges that start inside a token and pass its end."""
        beyond: dict[tuple[str, ...], int] = {}  # prefix of an earlier token -> how far it and its chain reach past it
        most = 0
        for left, right in pairs:
            s = self._symbols(left + right)
            reach = max((beyond.get(s[i:], 0) for i in range(1, len(s))), default=0)
            most = max(most, reach)
            for i in range(1, len(s)):
                far = len(s) - i + reach
                if beyond.get(s[:i], 0) < far:
                    beyond[s[:i]] = far
        return most + 1

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a buffer of ids: always the strongest pair, leftmost first, from a heap of (rank, place)."""
        n, rank, made = len(ids), self.rank.get, self.made
        heap = [r << 20 | i for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-1)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFF
            j = after[i]
            if ids[i] < 0 or ids[j] < 0 or rank(ids[i] << 20 | ids[j]) != top >> 20:
                continue  # one side has been merged since
            ids[i], ids[j] = made[top >> 20], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, r << 20 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, r << 20 | h)
        return [t for t in ids if t >= 0]

    def stream(self, ids: Iterable[int]) -> Iterator[list[int]]:
        """Tokens of one run of symbols, in lists, each emitted as soon as no later symbol can change it."""
        buffer: list[int] = []
        crossed, held = self.crossed, self.held
        for some in batched(ids, _BLOCK):
            fresh, at = max(1, len(buffer)), 0
            buffer += some
            if len(some) < _BLOCK:
                break  # the run ends here: what is buffered is its last flush
            for i in [i for i in range(fresh, len(buffer)) if buffer[i - 1] << 20 | buffer[i] not in crossed]:
                yield self.merge(buffer[at:i])
                at = i
            if at:
                del buffer[:at]
            if len(buffer) >= 2 * held:
                stable, done, tokens = len(buffer) - self.lookahead, 0, []
                for token in self.merge(list(buffer)):
                    n = self.length.get(token, 1)
                    if done + n > stable:
                        break
                    tokens.append(token)
                    done += n
                yield tokens
                buffer = buffer[done:]
        if buffer:
            yield self.merge(buffer)


class Encoder:
    """Text to ids under a MergeTable, with a bounded memo for short pieces."""

    def __init__(self, table: MergeTable):
        import regex

        self.t = table
        of = byte_alphabet()
        self.chars = [table.vocab.get(of[b], UNKNOWN) for b in range(256)]
        self.last = [table.vocab.get(of[b] + table.suffix, UNKNOWN) for b in range(256)]
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.special = regex.compile("|".join(regex.escape(x) for x in table.added)) if table.added else None
        self.odd = regex.compile("[\x1c-\x1f]")
        self.blank = regex.compile(f"[{_SPACE}]+")
        self.memo: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}
        self.gap = regex.compile(f"[{_SPACE}]")

    def word(self, piece: str) -> Iterable[list[int]]:
        """Ids of a word, in lists."""
        known = self.words.get(piece)
        if known is not None:
            return (known,)
        raw = piece.encode()
        chars = self.chars
        symbols = [chars[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        lists = self.t.stream(symbols)
        if UNKNOWN in symbols:
            lists = ([i for i in ids if i != UNKNOWN] for ids in lists)
        if len(piece) >= 32:
            return lists
        ids = [i for some in lists for i in some]
        if len(self.words) < _MEMO:
            self.words[piece] = ids
        return (ids,)

    def piece(self, text: str) -> Iterable[list[int]]:
        """Ids of a piece of text without white space, in lists."""
        low = unicodedata.normalize("NFC", text) if self.t.nfc else text
        if self.t.lower:
            low = low.replace("Σ", "σ").lower()  # by character, without the final sigma
        if len(text) >= 32:
            return (ids for m in self.cut.finditer(low) for ids in self.word(m[0]))
        ids: list[int] = []
        for w in self.cut.findall(low):
            for some in self.word(w):
                ids += some
        if len(self.memo) < _MEMO:
            self.memo[text] = ids
        return (ids,)

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that end before white space."""
        at = 0
        while len(text) - at > _TEXT and (m := self.gap.search(text, at + _TEXT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def plain(self, text: str) -> Iterator[list[int]]:
        memo, piece = self.memo.get, self.piece
        ids: list[int] = []
        for block in self.blocks(text):
            for p in self.blank.split(block) if self.odd.search(block) else block.split():
                known = memo(p)
                if known is not None:
                    ids += known
                    continue
                for some in piece(p):
                    ids += some
                    if len(ids) >= _CHUNK:
                        yield ids
                        ids = []
            if len(ids) >= _CHUNK:
                yield ids
                ids = []
        if ids:
            yield ids

    def chunks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in chunks that come while it is read."""
        at = 0
        if self.special is not None and "<|" in text:
            for m in self.special.finditer(text):
                yield from self.plain(text[at : m.start()])
                yield [self.t.added[m[0]]]
                at = m.end()
        yield from self.plain(text[at:] if at else text)

    def __call__(self, text: str) -> list[int]:
        return [i for ids in self.chunks(text) for i in ids]


class Decoder:
    """Ids to text, a chunk at a time.

    Without a decoder in the tokenizer's file, the pieces themselves are joined by one space, as the library does; with
    a byte-level one, pieces are turned into bytes and an incomplete UTF-8 sequence is held until its rest arrives.
    """

    def __init__(self, table: MergeTable):
        import codecs

        self.pieces, self.bytes = table.pieces, table.decoder == "ByteLevel"
        self.of = {c: b for b, c in byte_alphabet().items()}
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        get = self.pieces.get
        if self.bytes:
            return self.utf8.decode(bytes(self.of[c] for i in ids for c in get(i, "")))
        out = " ".join([p for i in ids if (p := get(i)) is not None])
        joined = " " + out if self.begun and out else out
        self.begun |= bool(out)
        return joined

    def finish(self) -> str:
        self.begun = False
        return self.utf8.decode(b"", final=True) if self.bytes else ""


@lru_cache(maxsize=2)
def _table(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(_table(path))


def encode(docs: DataFrame, path: str, rows_at_once: int = 256) -> DataFrame:
    """(doc_id, ids array<int>) of every document; `path` is the tokenizer's file, present on every machine."""

    def run(batches):
        enc = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                ids = [enc(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, rows_at_once: int = 256, ids_at_once: int = 4096) -> DataFrame:
    """(doc_id, ids, decoded string) of every row of ids."""

    def run(batches):
        dec = Decoder(_table(path))
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                out = []
                for ids in part.column("ids").to_pylist():
                    out.append("".join([dec.feed(ids[i : i + ids_at_once]) for i in range(0, len(ids), ids_at_once)]) + dec.finish())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, rows_at_once: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, decoded again and digested.

    Both machines run in one Python worker, chunk by chunk, so neither ids nor decoded texts are ever whole; `encode` and `decode` return them.
    """

    def run(batches):
        enc, dec = _encoder(path), Decoder(_table(path))
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                rows = []
                for text in part.column("text").to_pylist():
                    n, ids_seen, seen = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in enc.chunks(text or ""):
                        if not ids:
                            continue
                        ids_seen.update(((" " if n else "") + " ".join(map(str, ids))).encode())
                        seen.update(dec.feed(ids).encode())
                        n += len(ids)
                    seen.update(dec.finish().encode())
                    rows.append((n, ids_seen.hexdigest(), seen.hexdigest()))
                many, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(many, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
