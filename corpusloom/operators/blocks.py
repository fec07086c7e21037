"""Terms of a block of texts, counted in numpy, and frequencies that blocks tell each other by their terms' keys.

A block's texts are cut into words between white space; what a space makes of a word (windows, runs of letters and digits, tokens) is made once for each
distinct word of the block. A term is known by a 64-bit key, a hash that is the same in every block, so no term travels as a string.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose terms are counted at once.
SLICE = 1024
_BLANKS = [chr(c).encode() for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_TO_BLANK = np.arange(256, dtype=np.uint8)
_TO_BLANK[[9, 10, 11, 12, 13]] = 32


def lowered(text: Column) -> Column:
    """What blocks are made of."""
    return F.lower(F.coalesce(text, F.lit("")))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_keys(chars: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of strings of `size` characters, which stand one after another in chars."""
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    at = (np.arange(len(chars)) - np.repeat(first, size)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(mixed(at + np.uint64(1)) + chars), first))


def string_keys(terms: Sequence[str]) -> np.ndarray:
    """The keys of some strings."""
    chars = np.frombuffer("".join(terms).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return _run_keys(chars, np.array([len(t) for t in terms], np.int64))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, the number of each place's key)."""
    import pyarrow as pa

    coded = pa.array(keys).dictionary_encode()
    no, held = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(held)
    rank = np.empty(len(held), np.int64)
    rank[order] = np.arange(len(held))
    place = np.empty(len(held), np.int64)
    place[no] = np.arange(len(no))
    return held[order], place[order], rank[no]


def _strings(n: int, offsets: np.ndarray, data: np.ndarray):
    """An Arrow array of n strings."""
    import pyarrow as pa

    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first, first + 1 ... of every span, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Words:
    """The distinct words of an Arrow array of lower-case texts: places (row, no) in order, and each word's characters between blanks."""

    def __init__(self, texts):
        import pyarrow as pa

        texts = texts.cast(pa.large_string())
        self.rows = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.rows + 1] if self.rows else np.zeros(1, np.int64)
        raw = (texts.buffers()[2] or b"") if self.rows else b""
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data = _TO_BLANK[data]
        whole = data.tobytes()
        for blank in _BLANKS:  # of two and three bytes, each of which becomes a blank
            at = whole.find(blank)
            while at >= 0:
                data[at : at + len(blank)] = 32
                at = whole.find(blank, at + len(blank))
        inside = data != 32
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        start[bounds] |= inside[bounds]
        first = np.flatnonzero(start)
        kept = np.cumsum(inside)
        size = np.diff(np.r_[kept[first] - 1, kept[-1] if len(kept) else 0]) if len(first) else np.zeros(0, np.int64)
        self.row = np.searchsorted(offsets, first, side="right") - 1
        coded = _strings(len(first), np.r_[0, np.cumsum(size)], data[inside]).dictionary_encode()
        self.no, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.n = len(words)
        at = np.frombuffer(words.buffers()[1], np.int64)[: self.n + 1] if self.n else np.zeros(1, np.int64)
        held = np.frombuffer(words.buffers()[2], np.uint8)[: at[-1]] if self.n else np.zeros(0, np.uint8)
        padded = np.full(len(held) + 2 * self.n, 32, np.uint8)
        padded[np.arange(len(held)) + np.repeat(2 * np.arange(self.n) + 1, np.diff(at))] = held
        self.data = padded
        self.byte = np.flatnonzero((padded & 0xC0) != 0x80)  # where each character begins
        self.chars = np.frombuffer(padded.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.first = np.searchsorted(self.byte, at[:-1] + 2 * np.arange(self.n))
        self.size = np.diff(np.r_[self.first, len(self.chars)])
        self.byte = np.r_[self.byte, len(padded)]

    def spelled(self, at: np.ndarray, size: np.ndarray):
        """The strings of `size` characters from `at` on."""
        low, high = self.byte[at], self.byte[at + size]
        return _strings(len(at), np.r_[0, np.cumsum(high - low)], self.data[_spans(low, high - low)])

    def runs(self, inside: np.ndarray, least: int, stop: Sequence[str]):
        """(keys, at, size, row, no): the distinct runs of such characters but `stop`, a place of each among the characters, and rows and numbers of all places in order."""
        start, stops = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        at = np.flatnonzero(start)
        size = np.flatnonzero(stops) - at + 1
        at, size = at[size >= least], size[size >= least]
        keys = _run_keys(self.chars[_spans(at, size)].astype(np.uint64), size)
        stays = ~np.isin(keys, string_keys(stop))
        at, size = at[stays], size[stays]
        keys, place, no = _numbered(keys[stays])
        ends = np.searchsorted(at, np.r_[self.first, len(self.chars)])
        many = ends[self.no + 1] - ends[self.no]
        return keys, at[place], size[place], np.repeat(self.row, many), no[_spans(ends[self.no], many)]

class Terms:
    """Distinct terms of a block: keys in order, how they are spelled, and slices of (row, no, tf)."""

    def __init__(self, keys: np.ndarray, rows: int, slices: Callable, spell: Callable):
        self.keys, self.rows, self.slices, self.spell = keys, rows, slices, spell

    def frequencies(self) -> np.ndarray:
        """The rows that hold each term."""
        df = np.zeros(len(self.keys), np.int64)
        for _, no, _ in self.slices():
            df += np.bincount(no, minlength=len(self.keys))
        return df


def rows_of_keys(part, key: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """(number of each row's key, first row of each key) where a key comes more than once."""
    number = np.zeros(part.num_rows, np.int64)
    for name in key:
        coded = part.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        number = np.unique(number * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    found, first = np.unique(number, return_index=True)
    return (number, first) if len(found) < part.num_rows else None


def merged(terms: Terms, keys: tuple[np.ndarray, np.ndarray] | None) -> Terms:
    """Terms of rows of one key taken together."""
    if keys is None:
        return terms
    number, first = keys
    n = max(1, len(terms.keys))

    def slices():
        row, no, tf = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *terms.slices(), strict=True))
        every, at = np.unique(number[row] * n + no, return_inverse=True)
        yield *np.divmod(every, n), np.bincount(at, weights=tf, minlength=len(every)).astype(np.int64)

    return Terms(terms.keys, len(first), slices, terms.spell)


def _tally(row: np.ndarray, no: np.ndarray, n: int, low: int, distinct: bool = False):
    """(row, no, tf) of places of rows from `low` on, sorted."""
    bits = max(1, int(n - 1).bit_length()) if n else 1
    wide = np.uint32 if int(row[-1] - low + 1 if len(row) else 1).bit_length() + bits <= 32 else np.uint64
    key = np.sort((row - low).astype(wide) << wide(bits) | no.astype(wide))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> wide(bits)).astype(np.int64) + low, (key & wide((1 << bits) - 1)).astype(np.int64), np.minimum(tf, 1) if distinct else tf


def _sliced(row: np.ndarray, no: np.ndarray, n: int, distinct: bool = False):
    def slices():
        for low in range(0, int(row[-1]) + 1 if len(row) else 0, SLICE):
            a, b = np.searchsorted(row, [low, low + SLICE])
            yield _tally(row[a:b], no[a:b], n, low, distinct)

    return slices


def windows(words: Words) -> Terms:
    """The char space: windows of three to five characters of each word between blanks."""
    c = words.chars.astype(np.uint64)
    left = np.repeat(words.first + words.size, words.size) - np.arange(len(c))  # characters from here to the end of the word
    many = np.clip(left - 2, 0, 3)
    at = np.repeat(np.arange(len(c)), many)
    size = _spans(np.full(len(c), 3), many)
    end = np.r_[c, np.zeros(4, np.uint64)]
    shift = np.uint64(21)
    low = mixed(end[:-4] | end[1:-3] << shift | end[2:-2] << (shift + shift))[at]
    end += np.uint64(1)
    more = np.where(size > 3, end[at + 3] | np.where(size > 4, end[at + 4] << shift, np.uint64(0)), np.uint64(0))
    keys, first, no = _numbered(mixed(low + more))
    ends = np.searchsorted(at, np.r_[words.first, len(c)])

    def slices():
        for low in range(0, words.rows, SLICE):
            a, b = np.searchsorted(words.row, [low, low + SLICE])
            w = words.no[a:b]
            many = ends[w + 1] - ends[w]
            yield _tally(np.repeat(words.row[a:b], many), no[_spans(ends[w], many)], len(keys), low)

    return Terms(keys, words.rows, slices, lambda mine: words.spelled(at[first[mine]], size[first[mine]]))


def _letters(chars: np.ndarray) -> np.ndarray:
    """Whether each character is a letter, a number or an underscore."""
    found, no = np.unique(chars, return_inverse=True)
    return np.array([c == 95 or unicodedata.category(chr(c))[0] in "LN" for c in found.tolist()], bool)[no]


def pairs(stop: Sequence[str] = ()) -> Callable[[Words], Terms]:
    """The word space: runs of two letters or digits and more, stop words left out, and pairs of neighbours."""

    def terms(words: Words) -> Terms:
        import pyarrow as pa
        import pyarrow.compute as pc

        single, at, size, row, no = words.runs(_letters(words.chars), 2, stop)
        n = len(single)
        near = np.flatnonzero(row[1:] == row[:-1])
        two, _, both = _numbered(no[near] * max(1, n) + no[near + 1])
        a, b = np.divmod(two, max(1, n))
        every = np.r_[single, mixed(mixed(single[a]) + single[b])]
        order = np.argsort(every)
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every))
        rows, nos = np.r_[row, row[near]], np.r_[rank[no], rank[n:][both]]
        by_row = np.argsort(rows, kind="stable")

        def spell(mine):
            mine = order[mine]
            first = np.r_[np.arange(n), a][mine]
            one, two = (words.spelled(at[x], size[x]) for x in (first, np.r_[np.arange(n), b][mine]))
            return pc.if_else(pa.array(mine < n), one, pc.binary_join_element_wise(one, two, pa.scalar(" ", one.type)))

        return Terms(every[order], words.rows, _sliced(rows[by_row], nos[by_row], len(every)), spell)

    return terms


def letter_tokens(stop: Sequence[str] = ()) -> Callable[[Words], Terms]:
    """Runs of three letters a-z and more, less stop words, each once a row."""

    def terms(words: Words) -> Terms:
        keys, at, size, row, no = words.runs((words.chars >= 97) & (words.chars <= 122), 3, stop)
        return Terms(keys, words.rows, _sliced(row, no, len(keys), True), lambda mine: words.spelled(at[mine], size[mine]))

    return terms


def makers(spaces: Mapping) -> dict[str, Callable[[Words], Terms]]:
    """A function of Words for each space, as its term function names it (`in_blocks`)."""
    return {name: terms.in_blocks for name, terms in spaces.items()}


def block_frequencies(rows: DataFrame, key: Sequence[str], terms: Callable[[Words], Terms]) -> DataFrame:
    """(term, df): the keys whose rows (_block, key, _low) hold a term; a row a term of a block is shuffled."""
    import pyarrow as pa

    def count(part):
        found = merged(terms(Words(part.column("_low").combine_chunks())), rows_of_keys(part, key))
        return pa.table([found.spell(np.arange(len(found.keys))).cast(pa.string()), pa.array(found.frequencies())], names=["term", "df"])

    return rows.groupBy("_block").applyInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


# What blocks tell each other.

#: Rows of told_blocks that go to no block: the frequencies of asked terms, and the word space's terms that more than one row holds.
ASKED, SHARED = -1, -2


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that a key is dealt to; parts are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(part_of(keys, parts), np.arange(parts + 1))


def _joined(arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays as bytes, their lengths in front."""
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[a.tobytes() for a in arrays]])


def _parted(blob: bytes, kinds: Sequence) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def term_rows(rows: DataFrame, key: Sequence[str], make: Mapping[str, Callable[[Words], Terms]], text: str) -> DataFrame:
    """(key, space, term, tf): the terms of each row's text, by their keys."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            words = Words(batch.column("_low"))
            for name, terms in make.items():
                found = terms(words)
                ids = found.keys.view(np.int64)
                for row, no, tf in found.slices():
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in key], pa.array([name] * len(row), pa.string()), pa.array(ids[no]), pa.array(tf.astype(np.int64))], [*key, "space", "term", "tf"])

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    x = rows.select(*key, lowered(F.col(text)).alias("_low")).mapInArrow(count, f"{schema}, space string, term long, tf long")
    return x.groupBy(*key, "space", "term").agg(F.sum("tf").alias("tf"))


def told_blocks(rows: DataFrame, asked: DataFrame, make: Mapping[str, Callable[[Words], Terms]], parts: int, kind_of: Mapping[str, int], counted: Sequence[str] = ("word", "char"), key: Sequence[str] = ()) -> DataFrame:
    """(_block, part, told): for each block and range of keys, the frequencies over all blocks where they differ from the block's own, and the numbers of asked terms.

    rows (_block, _low) are texts dealt to their blocks, those of one key taken together where key is given; asked (space, term, tid) the terms asked for. A block tells its keys in order, so that the answer needs only places.
    Rows of _block ASKED hold (tid, df) of asked terms that any block holds, those of SHARED the keys and frequencies of the word space's terms of more than one row.
    """
    import pyarrow as pa

    names = list(make)
    table = lambda no, part, blobs: pa.table([pa.array(no, pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["_block", "part", "told"])

    def count(part):
        words, keys = Words(part.column("_low").combine_chunks()), rows_of_keys(part, key) if key else None
        of = []
        for name in names:
            found = merged(make[name](words), keys)
            here = found.frequencies() if name in counted else np.ones(len(found.keys), np.int64)
            of.append((found.keys, here.astype(np.int32), _bounds(found.keys, parts)))
        blobs = [_joined([x for keys, here, at in of for x in (keys[at[p] : at[p + 1]], here[at[p] : at[p + 1]])]) for p in range(parts)]
        return table([part.column("_block")[0].as_py()] * parts, range(parts), blobs)

    def ask(part):
        kinds, keys, tids = (part.column(c).to_numpy() for c in ("kind", "term", "tid"))
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        mine = [order[kinds[order] == kind_of[name]] for name in names]
        return table([ASKED], [part.column("part")[0].as_py()], [_joined([x for m in mine for x in (keys[m], tids[m])])])

    def merge(part):
        blocks, blobs = part.column("_block").to_pylist(), part.column("told").to_pylist()
        told: list[list[np.ndarray]] = [[] for _ in blocks]
        shared = [np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        found = [_parted(b, [np.uint64, np.int64 if no == ASKED else np.int32] * len(names)) for no, b in zip(blocks, blobs, strict=True)]
        held = [i for i, no in enumerate(blocks) if no != ASKED]
        for k, name in enumerate(names):
            sizes = np.array([len(found[i][2 * k]) for i in held], np.int64)
            keys = np.concatenate([found[i][2 * k] for i in held]) if held else np.zeros(0, np.uint64)
            here = np.concatenate([found[i][2 * k + 1] for i in held]) if held else np.zeros(0, np.int32)
            order = np.argsort(keys)
            ordered = keys[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            distinct = ordered[first]
            total = np.add.reduceat(here[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            group = np.empty(len(keys), np.int64)
            group[order] = np.cumsum(new) - 1
            number = np.full(len(distinct), -1, np.int64)
            for i, no in enumerate(blocks):
                if no == ASKED:
                    wanted, tids = found[i][2 * k], found[i][2 * k + 1]
                    at = np.searchsorted(distinct, wanted)
                    hit = np.flatnonzero(at < len(distinct))
                    hit = hit[distinct[at[hit]] == wanted[hit]]
                    number[at[hit]] = tids[hit]
                    told[i] += [tids[hit], total[at[hit]].astype(np.int32)]
            for i, low, high in zip(held, (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
                mine = group[low:high]
                df, tid = total[mine], number[mine]
                other, use = np.flatnonzero(df != here[low:high]) if name in counted else np.zeros(0, np.int64), np.flatnonzero(tid >= 0)
                told[i] += [other.astype(np.int32), df[other].astype(np.int32), use.astype(np.int32), tid[use]]
            if name == "word":
                shared = [distinct[total > 1], total[total > 1].astype(np.int32)]
        at = part.column("part")[0].as_py()
        return table([*blocks, SHARED], [at] * (len(blocks) + 1), [*map(_joined, told), _joined(shared)])

    schema = "_block int, part int, told binary"
    from_blocks = rows.groupBy("_block").applyInArrow(count, schema)
    kind = F.element_at(F.create_map(*[F.lit(x) for item in kind_of.items() for x in item]), F.col("space")).alias("kind")
    of_part = F.shiftright(F.shiftrightunsigned("term", 32) * parts, 32).cast("int").alias("part")
    from_asked = asked.select(kind, "term", "tid", of_part).groupBy("part").applyInArrow(ask, schema)
    return from_blocks.unionByName(from_asked).groupBy("part").applyInArrow(merge, schema)


def asked_frequencies(told: DataFrame, spaces: int) -> DataFrame:
    """(tid, df) of the asked terms that any block holds."""
    return _rows(told, ASKED, [np.int64, np.int32] * spaces, "tid long, df int")


def shared_terms(told: DataFrame) -> DataFrame:
    """(term, df): keys of the word space's terms that more than one row holds."""
    return _rows(told, SHARED, [np.uint64, np.int32], "term long, df int")


def _rows(told: DataFrame, block: int, kinds: Sequence, schema: str) -> DataFrame:
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for blob in batch.column("told").to_pylist():
                arrays = _parted(blob, kinds)
                for at in range(0, len(arrays), 2):
                    yield pa.RecordBatch.from_arrays([pa.array(arrays[at].view(np.int64)), pa.array(arrays[at + 1])], names)

    return told.where(F.col("_block") == block).select("told").mapInArrow(run, schema)


def told_numbers(terms: Terms, parts: int, part: Sequence[int], told: Sequence[bytes], k: int, spaces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, frequencies, places, tids) of a block's k-th space, from its rows of told_blocks."""
    at = _bounds(terms.keys, parts)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for p, blob in zip(part, told, strict=True):
        mine = _parted(blob, [np.int32, np.int32, np.int32, np.int64] * spaces)[4 * k : 4 * k + 4]
        for into, x, base in zip(out, mine, (at[p], 0, at[p], 0), strict=True):
            into.append(x.astype(np.int64) + base)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
